"""Queries on catalogs, clients and orders of items."""

from pyspark.sql import functions as F

from ..operators import catalog
from ..registry import query, table


def models(spark, sf_dir):
    """Parts as models of three catalogs."""
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("cover_image_url"))
    kinds = F.array(*map(F.lit, [*catalog.CATEGORIES, "training", "vision"]))
    b = p.where("p_partkey % 3 = 1").select(F.col("p_partkey").cast("string").alias("endpoint_id"), F.col("p_name").alias("display_name"), F.col("p_type").alias("description"), F.element_at(kinds, (F.col("p_size") % 12 + 1).cast("int")).alias("category"), F.lit(None).cast("string").alias("thumbnail_url"))
    c = p.where("p_partkey % 3 = 2").select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("model_id"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "Video of a photo").otherwise("plain").alias("description"), F.col("p_retailprice").alias("amount"))
    return catalog.union_catalogs(catalog.normalize_catalog(a, "owned", "one"), catalog.normalize_catalog(b, "endpoint", "two"), catalog.normalize_catalog(c, "loose", "three"))


KINDS_SQL = str([*catalog.CATEGORIES, "training", "vision"])


def holds(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def kind_sql(text: str, variant: str) -> str:
    w = catalog.KEYWORDS[variant]
    return f"CASE WHEN {holds(text, w['3d'])} THEN CASE WHEN {holds(text, catalog.IMAGE_WORDS)} THEN 'image-to-3d' ELSE 'text-to-3d' END WHEN {holds(text, w['audio'])} THEN 'text-to-audio' WHEN {holds(text, w['video'])} THEN CASE WHEN {holds(text, catalog.STILL_WORDS)} THEN 'image-to-video' ELSE 'text-to-video' END ELSE 'text-to-image' || CASE WHEN {holds(text, w['edit'])} THEN ',image-to-image' ELSE '' END END"


@query(f"""WITH k AS (SELECT *, {KINDS_SQL}[p_size % 12 + 1] AS kind, lower(p_name || ' ' || p_type) AS t1, lower(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ' ' || p_name || ' ' || CASE WHEN p_size % 3 = 0 THEN 'Video of a photo' ELSE 'plain' END || ' ') AS t2 FROM part)
SELECT 0 AS source_ord, p_brand || '/' || p_name AS id, p_name AS name, 'one' AS provider, {kind_sql('t1', 'short')} AS kinds, NULL::DOUBLE AS price FROM k WHERE p_partkey % 3 = 0 UNION ALL
SELECT 1, p_partkey::VARCHAR, p_name, 'two', CASE WHEN kind IN ('text-to-speech', 'text-to-music', 'text-to-sound-effects') THEN 'text-to-audio' ELSE kind END, NULL FROM k WHERE p_partkey % 3 = 1 AND kind NOT IN ('training', 'vision') UNION ALL
SELECT 2, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_partkey::VARCHAR END, p_name, 'three', {kind_sql('t2', 'long')}, p_retailprice FROM k WHERE p_partkey % 3 = 2""")
def catalog_union(spark, sf_dir):
    m = models(spark, sf_dir)
    return m.select("source_ord", "id", "name", "provider", F.array_join("capabilities", ",").alias("kinds"), "price")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed') OR contains(lower(p_type), 'brass')")
def catalog_search(spark, sf_dir):
    found = catalog.matches("ED", ["p_name"]) | catalog.matches("brass", ["p_type"])
    return table(spark, sf_dir, "part").where(found).select("p_partkey", "p_name")


@query("SELECT p_partkey, 'f' || (p_size % 5) AS facet FROM part WHERE CASE p_size % 5 WHEN 0 THEN p_partkey % 8 IN (0, 1) WHEN 1 THEN p_partkey % 8 IN (2, 3, 4) WHEN 2 THEN p_partkey % 8 IN (5, 6) ELSE p_partkey % 8 = 7 END")
def facet_filter(spark, sf_dir):
    kinds = ["text-to-image", "image-to-image", "text-to-video", "image-to-video", "audio-to-video", "text-to-3d", "image-to-3d", "text-to-audio"]
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("f"), F.array(F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("capabilities"))
    parts = [catalog.filter_any(p.where(F.col("f") == i), "capabilities", catalog.expand_facet(name)) for i, name in enumerate(("image", "video", "3d", "audio", "other"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select("p_partkey", F.concat(F.lit("f"), "f").alias("facet"))


@query("SELECT p_partkey, p_partkey % 2 = 1 AS is_community FROM part WHERE p_partkey % 2 = 0 AND p_brand = 'Brand#11' OR p_partkey % 2 = 1")
def template_categories(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("category", F.col("p_brand"))
    a, b = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1").drop("category")
    shown = catalog.filter_category(a, b, "Brand#11").unionByName(catalog.filter_category(a, b, "community"))
    return shown.select("p_partkey", "is_community")


@query("SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS tag FROM part UNION SELECT DISTINCT lang FROM documents")
def all_tags(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.split(F.lower("p_type"), " ").alias("tags"))
    return catalog.union_tags(a, table(spark, sf_dir, "documents").select(F.array("lang").alias("tags")))


@query("SELECT p_partkey, len(string_split(p_type, ' '))::INT AS node_count FROM part")
def template_sizes(spark, sf_dir):
    return catalog.template_stats(table(spark, sf_dir, "part").withColumn("nodes", F.split("p_type", " "))).select("p_partkey", "node_count")


@query("SELECT p_brand, count(*) FILTER (p_size % 7 <> 0) > 0 AS success, coalesce(sum(p_size) FILTER (p_size % 7 <> 0), 0)::BIGINT AS count, bool_and(p_size % 2 = 0) AS cached, CASE WHEN bool_or(p_size % 7 = 0) THEN 'failed' END AS error, false AS all_failed FROM part GROUP BY 1")
def provider_summary(spark, sf_dir):
    f = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("long").alias("count"), (F.col("p_size") % 2 == 0).alias("cached"), F.when(F.col("p_size") % 7 == 0, "failed").alias("error"))
    return catalog.source_summary(f, "p_brand")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Active' ELSE 'Other' END AS status FROM customer")
def client_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", "Active").otherwise("Other"))
    return catalog.order_clients(c, "status", "c_name").select("c_custkey", "status")


@query("SELECT c_custkey, c_custkey % 2 = 0 AS is_new FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 OR c_custkey % 3 = 0 AND c_custkey % 2 = 1 UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey % 6 = 0")
def appended_clients(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return catalog.append_new(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0").union(c.where("c_custkey % 4 = 0")), "c_custkey", "c_custkey")


@query("SELECT lower(n.n_name) AS asked, s_suppkey FROM (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def suppliers_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return catalog.find_by_name(s, "n_name", n.select(F.lower("n_name").alias("name")), "s_suppkey").select("asked", "s_suppkey")


@query("""SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos NULLS LAST, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_partkey % 5 END, l_partkey) AS place FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l
LEFT JOIN (SELECT l_orderkey AS o, max(l_partkey) AS p, 0 AS pos FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) x ON x.o = l.l_orderkey AND x.p = l.l_partkey""")
def ordered_lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().withColumn("created", F.col("l_partkey") % 5)
    order = items.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.max("l_partkey").alias("m")).select("l_orderkey", F.array("m", F.lit(-1).cast("long")).alias("ids"))
    return catalog.user_order(items, "l_orderkey", "l_partkey", order, "l_partkey", "created").select("l_orderkey", "l_partkey", "place")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE '%BRASS' THEN 0 ELSE 1 END, p_type || '#' || lpad(p_partkey::VARCHAR, 9, '0')) AS place FROM part WHERE p_type LIKE '%BRASS' UNION ALL SELECT p_brand, p_partkey, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND q.p_type LIKE '%BRASS') + row_number() OVER (PARTITION BY p_brand ORDER BY p_type || '#' || lpad(p_partkey::VARCHAR, 9, '0')) FROM part p WHERE p_type NOT LIKE '%BRASS'")
def ordered_inputs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws("#", "p_type", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"), F.lit("text").alias("type"), F.col("p_type").endswith("BRASS").alias("required"))
    return catalog.order_inputs(p, "p_brand").select("p_brand", "p_partkey", "place")


@query("SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN name IN ('seed', 'steps') THEN 0 ELSE 1 END, name) AS place FROM (SELECT DISTINCT p_brand, ['alpha', 'seed', 'steps', 'width'][p_size % 4 + 1] AS name FROM part)")
def ordered_params(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.element_at(F.array(*map(F.lit, ["alpha", "seed", "steps", "width"])), (F.col("p_size") % 4 + 1).cast("int")).alias("name")).distinct()
    return catalog.order_params(p, "p_brand", ["seed", "steps"]).select("p_brand", "name", "place")


@query("""SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 2 WHEN last >= 0 THEN (last + 1) % 6 ELSE n % 6 END::INT AS item_index FROM (SELECT o_custkey, count(*) AS n, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey % 10 END, o_orderkey) AS last FROM orders GROUP BY 1)""")
def next_item(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    arrays = o.select(F.col("o_custkey").alias("node_id")).distinct().select("node_id", F.when(F.col("node_id") % 4 == 0, 2).otherwise(7).alias("selected"), F.lit(6).alias("n_items"))
    edges = o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_orderkey") % 10).alias("item_index"))
    return catalog.round_robin(arrays, edges).select(F.col("node_id").alias("o_custkey"), "item_index")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Active' ELSE 'plain' END AS status, CASE WHEN c_custkey % 3 = 0 THEN '#111' WHEN c_custkey % 5 = 0 THEN '' ELSE '#abc' END AS primary_color, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'warm, dry' END AS tone_tags,
'Brand: ' || c_name || chr(10) || 'Website: ' || chr(10) || 'Logo: —' AS head FROM customer""")
def client_brands(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    json = F.when(F.col("c_custkey") % 5 != 0, '{"colors":[{"hex":"#abc"}],"tones":["warm","dry"]}').otherwise("not json")
    clients = c.select("c_custkey", F.col("c_name").alias("name"), F.lit("").alias("website"), F.lit(None).cast("string").alias("logo_url"), F.when(F.col("c_custkey") % 2 == 0, '{"id":1,"name":"Active"}').otherwise("plain").alias("status"), json.alias("brand_json"))
    none = ["logo", "secondary_color", "accent_color", "dark_color", "display_font", "body_font", "tagline", "tone_tags"]
    brands = c.where("c_custkey % 3 = 0").select(F.upper("c_name").alias("name"), F.col("c_custkey").alias("ord"), F.lit("#111").alias("primary_color"), *[F.lit(None).cast("string").alias(x) for x in none])
    merged = catalog.merge_client_brand(clients, brands)
    return merged.select("c_custkey", "status", "primary_color", "tone_tags", F.substring_index(catalog.brand_context(), "\n", 3).alias("head"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0")
def unviewed_comments(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("comment", F.when(F.col("c_custkey") % 3 == 0, " \t ").otherwise("see this"))
    return catalog.unviewed(c, c.where("c_custkey % 4 = 0"), "c_custkey").select("c_custkey")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Path must be absolute' WHEN 2 THEN 'Path contains traversal sequences' WHEN 3 THEN 'Access to /var/run is not allowed' END AS error FROM pages")
def path_check(spark, sf_dir):
    i = F.col("page_id")
    path = F.when(i % 5 == 0, F.concat(F.lit("/home/user/f"), i)).when(i % 5 == 1, F.concat(F.lit("home/"), i)).when(i % 5 == 2, F.concat(F.lit("/home/../"), i)).when(i % 5 == 3, F.concat(F.lit("/var/run/"), i)).otherwise(F.concat(F.lit("/etcetera/"), i))
    return table(spark, sf_dir, "pages").select("page_id", catalog.validate_path(path)["error"].alias("error"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://given.test/' || p_partkey WHEN p_brand = 'Brand#11' THEN 'https://one.test/' || p_partkey WHEN p_brand = 'Brand#12' THEN 'https://two.test' END AS url FROM part")
def model_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    url = catalog.model_url("p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(":v1")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("https://given.test/"), "p_partkey")), {"Brand#11": "https://one.test/{id}", "Brand#12": "https://two.test"})
    return p.select("p_partkey", url.alias("url"))
