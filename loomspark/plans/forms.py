"""Queries on cells in other forms: blobs, contexts, citations, prompts, media, costs of nodes, sets."""

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..operators import catalog, cost, dedup, forms, visibility
from ..registry import query, table
from ..sources import documents
from ..streaming import jobs


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[image: 4x3, ' || floor(length(text) * 3 / 4 / 1024 + 0.5)::BIGINT || 'KB]' WHEN doc_id % 3 = 1 THEN '[2 image(s)]' END AS image, doc_id % 3 = 1 AND doc_id % 2 = 0 AS no_images, 'kept' AS note FROM documents""")
def stripped_blobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "llmGenerate").otherwise("imageInput").alias("type"), F.regexp_replace("text", r"(?s).", "x").alias("blob"))
    note = F.lit("kept").alias("note")
    data = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("blob").alias("image"), F.expr("named_struct('width', 4, 'height', 3)").alias("dimensions"), F.lit("old").alias("imageRef"), note)))
    data = data.when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("inputImages"), F.when(F.col("doc_id") % 2 == 0, F.lit("x")).alias("extra"), note))).otherwise(F.to_json(F.struct(note)))
    s = forms.strip_blobs(d.withColumn("data", data))
    cell = F.col("data")
    return s.select("doc_id", F.coalesce(cell["image"], cell["inputImages"]).alias("image"), F.coalesce(cell["extra"] == "x", F.lit(False)).alias("no_images"), cell["note"].alias("note"))


@query("SELECT doc_id, length(t) > 200 AS was_cut, CASE WHEN length(t) > 200 THEN left(t, 200) || '...[truncated]' ELSE t END AS prompt, CASE WHEN doc_id % 2 = 0 THEN '{\"format\":\"png\",\"sizeKB\":0,\"isDataURI\":true}' ELSE 'plain' END AS image FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t FROM documents)")
def private_contexts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^a-zA-Z ]", "").alias("t"))
    inner = F.struct(F.col("t").alias("prompt"), F.when(F.col("doc_id") % 2 == 0, "data:image/png;base64,AAAA").otherwise("plain").alias("image"))
    safe = forms.sanitize_context(F.to_json(F.struct(F.lit(1).alias("n"), inner.alias("request"))))
    request = F.from_json(safe["request"], "map<string,string>")
    return d.select("doc_id", (F.length("t") > 200).alias("was_cut"), request["prompt"].alias("prompt"), request["image"].alias("image"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'own' WHEN p_size % 2 = 0 THEN 'even' END AS model, CASE WHEN p_size % 2 = 0 THEN '1K' END AS resolution FROM part")
def filled_defaults(spark, sf_dir):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2).cast("string").alias("type"), F.when(F.col("p_partkey") % 2 == 0, m("model", "own")).alias("data"))
    defaults = spark.range(1).select(F.lit("0").alias("type"), m("model", "even", "resolution", "1K").alias("data"))
    out = forms.merge_defaults(p, defaults)
    return out.select("p_partkey", F.try_element_at("data", F.lit("model")).alias("model"), F.try_element_at("data", F.lit("resolution")).alias("resolution"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '|T' WHEN 1 THEN url || '|,https://b.test|' ELSE url || '|W' END AS citations FROM pages")
def page_citations(spark, sf_dir):
    p, u = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url")
    q = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    a = q('[{"url_citation":{"url":"', u, '","title":"T"}},{"url":"', u, '","title":"again"},{"title":"none"}]')
    b = q('{"citations":["', u, '","https://b.test","', u, '",""]}')
    c = q('{"groundingChunks":[{"web":{"uri":"', u, '","title":"W"}},{"web":{"title":"x"}}]}')
    found = F.when(F.col("page_id") % 3 == 0, forms.normalize_citations(a, "annotations")).when(F.col("page_id") % 3 == 1, forms.normalize_citations(b, "results")).otherwise(forms.normalize_citations(c, "chunks"))
    return p.select("page_id", F.array_join(F.transform(found, lambda x: F.concat_ws("|", x["url"], F.coalesce(x["title"], F.lit("")))), ",").alias("citations"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'plain ' || conv_id || '; open ' || turn || '. Mood: calm; last' ELSE 'plain ' || conv_id || '; open ' || turn || '; last' END AS prompts FROM conversations")
def video_prompts(spark, sf_dir):
    q = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    raw = q('["plain ', F.col("conv_id"), '",{"openingShot":"open ', F.col("turn"), '","closingShot":"","mood":"', F.when(F.col("turn") % 2 == 0, "calm").otherwise(""), '"},"last","too many"]')
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(forms.normalize_prompts(raw), "; ").alias("prompts"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'mp4' WHEN 2 THEN 'mp3' ELSE 'bin' END AS ext, CASE WHEN page_id % 2 = 0 THEN 'glb' END AS address_ext, page_id % 4 = 0 AS is_data FROM pages")
def media_extensions(spark, sf_dir):
    i = F.col("page_id")
    mime = F.when(i % 4 == 0, "image/unheard").when(i % 4 == 1, "video/mp4").when(i % 4 == 2, "audio/mpeg").otherwise("text/plain")
    url = F.concat(F.lit("https://a.test/x."), F.when(i % 2 == 0, "GLB?v=1.png").otherwise("html"))
    data = F.when(i % 4 == 0, F.concat(F.lit("data:image/png;base64,"), F.lit("AAAA"))).otherwise("plain")
    return table(spark, sf_dir, "pages").select("page_id", forms.mime_to_ext(mime).alias("ext"), forms.url_ext(url).alias("address_ext"), forms.parse_data_url(data).isNotNull().alias("is_data"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'audio' WHEN page_id % 3 = 0 THEN 'video' WHEN page_id % 2 = 0 THEN 'video' ELSE 'image' END AS kind FROM pages")
def output_kinds(spark, sf_dir):
    i, none = F.col("page_id"), F.array().cast("array<string>")
    kind = forms.output_kind(F.when(i % 5 == 0, F.array(F.lit("a"))).otherwise(none), F.when(i % 3 == 0, F.array(F.lit("v"))).otherwise(none), F.array(F.when(i % 2 == 0, "https://x.test/clip.mp4").otherwise("data:image/png;base64,AA")))
    return table(spark, sf_dir, "pages").select("page_id", kind["kind"].alias("kind"))


@query("SELECT doc_id, string_split(text, ' ')[1] AS a, CASE WHEN len(string_split(text, ' ')) > 1 THEN string_split(text, ' ')[2] END AS b FROM documents")
def first_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", forms.first_pair(F.split("text", " ")).alias("p")).select("doc_id", "p.a", "p.b")


NODES_SQL = "SELECT p_partkey // 50 AS workflow_id, ['nanoBanana', 'generateVideo', 'splitGrid', 'prompt'][p_size % 4 + 1] AS type, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS chosen, ['nano-banana', 'nano-banana-pro', 'nano-banana-2'][p_partkey % 3 + 1] AS model, ['1K', '4K'][p_partkey % 2 + 1] AS res, p_partkey % 4 AS target FROM part"


@query(f"SELECT workflow_id, type, sum(CASE WHEN type = 'splitGrid' THEN target ELSE 1 END)::BIGINT AS n, round(sum(CASE WHEN chosen IS NOT NULL AND type <> 'splitGrid' THEN 0 ELSE CASE WHEN type = 'splitGrid' THEN target ELSE 1 END * CASE model WHEN 'nano-banana' THEN 0.039 WHEN 'nano-banana-pro' THEN CASE res WHEN '1K' THEN 0.134 ELSE 0.24 END ELSE CASE res WHEN '1K' THEN 0.067 ELSE 0.151 END END END), 6)::DOUBLE AS cost FROM ({NODES_SQL}) WHERE type = 'nanoBanana' OR type = 'generateVideo' AND chosen IS NOT NULL OR type = 'splitGrid' AND target > 0 GROUP BY 1, 2")
def node_costs(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    n = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("workflow_id"), pick(["nanoBanana", "generateVideo", "splitGrid", "prompt"], F.col("p_size") % 4).alias("type"), F.when(k % 3 == 0, F.col("p_brand")).alias("model_id"), F.lit("other").alias("provider"), pick(["nano-banana", "nano-banana-pro", "nano-banana-2"], k % 3).alias("model"), pick(["1K", "4K"], k % 2).alias("resolution"), F.lit(True).alias("is_configured"), (k % 4).alias("target_count"))
    q = cost.cost_quantities(n)
    price = F.coalesce(F.col("quantity") * cost.unit_price("model_id", "resolution"), F.lit(0.0))
    return q.groupBy("workflow_id", "type").agg(F.sum("quantity").alias("n"), F.round(F.sum(price), 6).alias("cost"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice WHEN p_size % 2 = 0 THEN 0.067 END, 4)::DOUBLE AS unit_price FROM part")
def looked_up_prices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    items = p.select("p_partkey", F.col("p_partkey").cast("string").alias("model"), (F.col("p_size") % 2).cast("string").alias("resolution"))
    prices = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("model"), F.col("p_retailprice").alias("price"))
    fixed = p.select(F.col("p_partkey").cast("string").alias("model"), F.lit("0").alias("resolution"), F.lit(0.067).alias("price"))
    return cost.price_lookup(items, prices, fixed).select("p_partkey", F.round("unit_price", 4).alias("unit_price"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '$0.00' WHEN p_partkey % 3 = 1 THEN '<$0.01' ELSE '$' || p_size || '.50' END AS price, p_brand || ' Px' AS label, CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'second' END AS unit FROM part")
def price_texts(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    price = F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.004).otherwise(F.col("p_size") + 0.5)
    return p.select("p_partkey", S.format_cost(price).alias("price"), S.to_label(F.concat("p_brand", F.lit("_px"))).alias("label"), F.when(k % 2 == 0, "per-run").otherwise("per-second").alias("t")).select("p_partkey", "price", "label", cost.price_unit("t").alias("unit"))


@query("SELECT p_brand, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
def other_provider_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return cost.other_items(items, "p_brand", ["Brand#11", "Brand#12"]).select("p_brand", "l_partkey", "l_suppkey")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'rate_limited' ELSE 'error' END AS status, event_type IN ('error', 'click', 'view') AS retriable FROM events")
def error_statuses(spark, sf_dir):
    text = F.create_map(*[F.lit(x) for x in ("error", "Request aborted, 429", "click", "Rate  limit 429", "view", "HTTP 503", "signup", "bad key", "purchase", "none")])[F.col("event_type")]
    e = table(spark, sf_dir, "events").select("event_id", X.classify_error(text).alias("c"))
    return e.select("event_id", "c.status", "c.retriable")


# -- boards, media and documents ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderpriority <> '' AS has_workflow_data FROM orders WHERE o_custkey = 7")
def customer_boards(spark, sf_dir):
    return documents.scan_boards(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "o_orderpriority", [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_custkey") == 7)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def newest_boards(spark, sf_dir):
    return catalog.newest_first(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'draft' ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name FROM customer")
def default_statuses(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("status"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"))
    return catalog.apply_defaults(c, {"status": "draft", "name": ""})


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size END AS p_size FROM part")
def patched_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changes = p.where("p_partkey % 4 = 0").select("p_partkey", F.lit("new").alias("p_name"), F.when(F.col("p_partkey") % 8 == 0, 0).cast(p.schema["p_size"].dataType).alias("p_size"))
    return dedup.patch(p.withColumn("updated_at", F.lit(None).cast("timestamp")), changes, "p_partkey", ["p_name", "p_size"], F.lit("2026-01-01").cast("timestamp")).select("p_partkey", "p_name", "p_size")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'png' WHEN page_id % 3 = 1 THEN 'mp4' END AS ext, page_id % 3 = 2 AS not_found FROM pages")
def media_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    files = p.where("id % 3 = 0").withColumn("ext", F.explode(F.array(F.lit("mp4"), F.lit("png")))).union(p.where("id % 3 = 1").withColumn("ext", F.lit("mp4"))).union(p.where("id % 3 = 2").withColumn("ext", F.lit("txt")))
    return documents.resolve_media(p, files).select(F.col("id").alias("page_id"), "ext", "not_found")


@query("SELECT doc_id, md5(source || '/' || text) AS ref, length(text) AS n FROM documents")
def externalized_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows, store = dedup.externalize(d, "text", F.col("source"))
    back = dedup.hydrate(rows, store)
    ref = next(c for c in rows.columns if c not in d.columns)
    return rows.select("doc_id", F.col(ref).alias("ref")).join(back.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def distinct_contents(spark, sf_dir):
    return dedup.dedup_hash(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id")


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_replace(url, '[0-9]+', '', 'g') ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def distinct_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("u", F.regexp_replace("url", "[0-9]+", ""))
    return dedup.dedup_url(p, "u", ["page_id"]).select("page_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def newest_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    text = F.concat(F.lit('{"version":'), F.col("v").cast("string"), F.lit(',"nodes":[],"edges":'), F.when((F.col("doc_id") % 2 == 1) & (F.col("v") == 2), "{}").otherwise("[]"), F.lit("}"))
    files = d.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("text", F.when(F.col("v") == 3, "not json").otherwise(text))
    return documents.newest_valid(files.withColumn("modified", F.col("v")), "doc_id").select("doc_id", F.col("v").alias("version"))


@query("SELECT conv_id, turn, 'r' || conv_id || '-' || turn AS run_id, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 4 END AS category FROM conversations WHERE role = 'assistant'")
def answers_with_runs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumns({"prompt_id": F.concat_ws("-", "conv_id", "turn"), "model": F.lit("m")})
    runs = c.select("prompt_id", "model", F.concat(F.lit("r"), "prompt_id").alias("run_id"))
    prompts = c.where("conv_id % 5 <> 0").select("prompt_id", (F.col("conv_id") % 4).alias("category"))
    return visibility.attach_category(visibility.attach_run_id(c, runs), prompts).select("conv_id", "turn", "run_id", "category")


@query("SELECT user_id, model_id, place FROM (SELECT user_id, event_type AS model_id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2) WHERE place <= 4")
def recent_catalog_items(spark, sf_dir):
    recents = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("model_id")).agg(F.max("ts").alias("ts"))
    known = [("click", "text-to-image"), ("view", "image-to-image"), ("purchase", "text-to-image"), ("signup", "text-to-video")]
    return catalog.recent_models(recents, spark.createDataFrame(known, "model_id string, capability string"), "image").select("user_id", "model_id", "place")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY) WHERE n = 1")
def fresh_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("m")).first()["m"]
    return jobs.fresh_values(e, ["user_id"], "ts", "3 days", F.lit(now)).select("user_id", "event_id")


# -- sets --------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, k - 1 AS ord, unnest([event_type, props][k:k]) AS result FROM events, range(1, 3) r(k) WHERE event_id % 4 <> 0")
def flattened_results(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type", "props").alias("results"), F.when(F.col("event_id") % 4 == 0, "failed").alias("error"))
    return forms.flatten_ok(e, ["user_id", "event_id"], "results", "error").withColumn("ord", F.col("ord").cast("long"))


@query("SELECT l_orderkey, bool_and(l_linenumber < 6) AS same FROM lineitem GROUP BY 1")
def same_line_sets(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return forms.same_ids(items, items.where("l_linenumber < 6"), ["l_orderkey"], "l_linenumber")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 10")
def events_beyond(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return forms.beyond(e, dedup.newest_n(e, ["user_id"], "event_id", ["ts", "event_id"], 10), ["event_id"]).select("user_id", "event_id")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'nodes[1] must have a purpose (string)' WHEN 1 THEN 'connections[0].to references unknown node: z' WHEN 2 THEN 'groups[0] must have a valid color (neutral, blue, green, purple, orange)' WHEN 3 THEN 'estimatedComplexity must be one of: simple, moderate, complex' END AS message FROM documents WHERE doc_id % 5 <> 4")
def proposal_problems(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("proposal_id")), F.col("proposal_id") % 5
    p = d.select("proposal_id", F.lit("n").alias("name"), F.lit("d").alias("description"), F.when(k == 3, "odd").otherwise("simple").alias("complexity"))
    n = d.select("proposal_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select("proposal_id", "ord", F.when(F.col("ord") == 0, "a").otherwise("b").alias("id"), F.lit("prompt").alias("type"), F.when((k == 0) & (F.col("ord") == 1), "").otherwise("p").alias("purpose"), F.lit("t").alias("title"))
    c = d.select("proposal_id", F.lit(0).alias("ord"), F.lit("a").alias("from_id"), F.when(k.isin(0, 1), "z").otherwise("b").alias("to_id"), F.lit("text").alias("type"), F.lit("d").alias("description"))
    g = d.select("proposal_id", F.lit(0).alias("ord"), F.lit("g").alias("name"), F.when(k == 2, "red").otherwise("blue").alias("color"), F.lit(True).alias("has_nodes"), F.lit("p").alias("purpose"))
    return forms.proposal_errors(p, n, c, g).withColumnRenamed("proposal_id", "doc_id")
