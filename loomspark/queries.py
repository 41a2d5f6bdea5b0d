"""The registered queries over the reference's kinds of data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import easing
from .functions import semantics as S
from .functions import text as X
from .operators import catalog, cost, dedup, graph, timeline, visibility
from .plans import catalogs, forms, graphs, leads, media, stored, texts  # noqa: F401  (they register their queries)
from .registry import oracle_sql, queries, query, table  # noqa: F401
from .sources import documents
from .streaming import jobs

# -- visibility: a user turn is a prompt, the next assistant turn its answer ------------------------

BRAND, RIVALS = "the", ["and", "der", "that"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    prompts = c.where("role = 'user'").select("conv_id", F.col("turn").alias("prompt_turn"))
    replies = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("prompt_turn"), "text")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("conv_id") % 4 + 1).cast("int"))
    out = prompts.join(replies, ["conv_id", "prompt_turn"])
    return out.select("conv_id", "prompt_turn", "text", F.lit(BRAND).alias("brand"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), category.alias("category"), F.when(F.length("text") < 60, "error").otherwise("success").alias("status"))


CATEGORIES = ["direct", "category", "problem", "comparison"]
#: Mentions of one-word names: every separator is doubled first, so that neighbours both count.
ANSWERS_SQL = r"""
WITH a AS (
  SELECT p.conv_id, p.turn AS prompt_turn, r.text, 'the' AS brand, 'm' || (p.conv_id % 3) AS model,
    ['direct', 'category', 'problem', 'comparison'][(p.conv_id % 4 + 1)::INT] AS category,
    CASE WHEN length(r.text) < 60 THEN 'error' ELSE 'success' END AS status
  FROM conversations p JOIN conversations r ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 AND r.role = 'assistant'
  WHERE p.role = 'user'
), d AS (SELECT *, regexp_replace(text, '([^\p{L}\p{N}])', '\1\1', 'g') AS t2,
  list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> '') AS ss FROM a
), e AS (SELECT *, list_transform(ss, lambda s: len(regexp_extract_all(regexp_replace(s, '([^\p{L}\p{N}])', '\1\1', 'g'), '(?i)(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])'))) AS n FROM d
), f AS (SELECT *, list_sum(n)::BIGINT AS c, list_position(list_transform(n, lambda x: x > 0), true) AS pos,
  list_filter(['and', 'der', 'that'], lambda w: regexp_matches(t2, '(?i)(^|[^\p{L}\p{N}])' || w || '($|[^\p{L}\p{N}])')) AS rivals FROM e
), m AS (SELECT *, coalesce(c, 0) > 0 AS mentioned, CASE WHEN c > 0 THEN pos END AS position FROM f)
"""
KPI_SQL = """count(*) AS total, count(*) FILTER (status = 'success') AS successful,
  count(*) FILTER (status = 'success' AND mentioned) AS mentions,
  CASE WHEN count(*) FILTER (status = 'success') > 0 THEN floor(count(*) FILTER (status = 'success' AND mentioned) * 100.0 / count(*) FILTER (status = 'success') * 100 + 0.5) / 100 ELSE 0 END::DOUBLE AS visibility_pct,
  floor(avg(position) FILTER (status = 'success' AND mentioned) * 100 + 0.5) / 100 AS position_avg"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.extract_mentions(answers(spark, sf_dir), BRAND, RIVALS)


@query(ANSWERS_SQL + "SELECT conv_id, prompt_turn, mentioned, position::INT AS position, coalesce(c, 0)::INT AS mention_count, array_to_string(rivals, ', ') AS rivals FROM m")
def answer_mentions(spark, sf_dir):
    return mentions(spark, sf_dir).select("conv_id", "prompt_turn", "mentioned", "position", "mention_count", F.concat_ws(", ", "competitors_mentioned").alias("rivals"))


@query(ANSWERS_SQL + f"SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(category) = 0 THEN 'category' ELSE 'brand' END AS level, brand, model, category, {KPI_SQL} FROM m GROUP BY GROUPING SETS ((brand), (brand, model), (brand, category))")
def visibility_scorecard(spark, sf_dir):
    return visibility.scorecard(mentions(spark, sf_dir))


@query(ANSWERS_SQL + f"SELECT brand, {KPI_SQL} FROM m GROUP BY brand")
def brand_kpis(spark, sf_dir):
    return visibility.brand_kpis(mentions(spark, sf_dir), ["brand"])


@query(ANSWERS_SQL + f", g AS (SELECT brand, model, {KPI_SQL} FROM m GROUP BY brand, model) SELECT b.brand, x.model, coalesce(total, 0) AS total, coalesce(successful, 0) AS successful, coalesce(mentions, 0) AS mentions, coalesce(visibility_pct, 0) AS visibility_pct, position_avg FROM (SELECT DISTINCT brand FROM m) b CROSS JOIN (VALUES ('m0'), ('m1'), ('m2'), ('m9')) x(model) LEFT JOIN g ON g.brand = b.brand AND g.model = x.model")
def kpis_by_model(spark, sf_dir):
    domain = spark.createDataFrame([("m0",), ("m1",), ("m2",), ("m9",)], "model string")
    return visibility.kpis_by(mentions(spark, sf_dir), "model", domain, ["brand"])


@query(ANSWERS_SQL + f", g AS (SELECT brand, category, {KPI_SQL} FROM m GROUP BY brand, category) SELECT b.brand, x.category, coalesce(total, 0) AS total, coalesce(successful, 0) AS successful, coalesce(mentions, 0) AS mentions, coalesce(visibility_pct, 0) AS visibility_pct, position_avg FROM (SELECT DISTINCT brand FROM m) b CROSS JOIN (VALUES ('direct'), ('category'), ('problem'), ('comparison')) x(category) LEFT JOIN g ON g.brand = b.brand AND g.category = x.category")
def kpis_by_category(spark, sf_dir):
    return visibility.kpis_by(mentions(spark, sf_dir), "category", spark.createDataFrame([(c,) for c in CATEGORIES], "category string"), ["brand"])


@query(ANSWERS_SQL + ", s AS (SELECT brand, unnest(CASE WHEN mentioned THEN ['the'] ELSE [] END || rivals) AS name FROM m WHERE status = 'success'), k AS (SELECT b.brand, n.name, (SELECT count(*) FROM s WHERE s.brand = b.brand AND s.name = n.name) AS mentions FROM (SELECT DISTINCT brand FROM m) b CROSS JOIN (VALUES ('the'), ('and'), ('der'), ('that')) n(name)) SELECT brand, name, mentions, CASE WHEN sum(mentions) OVER (PARTITION BY brand) > 0 THEN floor(mentions * 100.0 / sum(mentions) OVER (PARTITION BY brand) * 100 + 0.5) / 100 ELSE 0 END::DOUBLE AS share_pct FROM k")
def share_of_voice(spark, sf_dir):
    return visibility.share_of_voice(mentions(spark, sf_dir), BRAND, RIVALS, ["brand"])


@query("SELECT d.source, floor(avg(CASE WHEN toxic = 1 THEN -1.0 WHEN quality = 1 THEN 1.0 ELSE 0.0 END) * 100 + 0.5) / 100 AS sentiment_avg, count(*) FILTER (NOT toxic = 1 AND quality = 1) AS positive, count(*) FILTER (NOT toxic = 1 AND NOT quality = 1) AS neutral, count(*) FILTER (toxic = 1) AS negative FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source")
def sentiment_by_source(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("sentiment", label)
    return visibility.sentiment_stats(rows, "sentiment", ["source"])


@query("SELECT conv_id, turn, model, 'pending' AS status FROM conversations CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) m(model) WHERE role = 'user'")
def run_matrix(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    return visibility.run_matrix(prompts, spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string"))


@query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def run_summary_by_week(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(S.iso_week("ts").alias("week"), F.col("event_type").alias("status"))
    return visibility.run_summary(e, ["week"], ["purchase", "error"])


# -- deduplication and windows ---------------------------------------------------------------------


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1".replace("\\\\", "\\"))
def dedup_document_text(spark, sf_dir):
    return dedup.dedup_text(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id")


@query("SELECT doc_id, md5(text) AS hash, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def content_addressed_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return dedup.write_content_addressed(d, F.col("text"), F.lit("txt"), "source", ["doc_id"]).select("doc_id", "hash", "is_duplicate")


@query("SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY lower(trim(p_brand)) ORDER BY p_partkey) n FROM part) WHERE n = 1")
def dedup_brand_names(spark, sf_dir):
    return dedup.dedup_name(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"]).select("p_partkey", "p_brand")


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1)) WHERE place <= 3")
def newest_event_types(spark, sf_dir):
    return dedup.newest_n(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], 3).select("user_id", "event_id", "place")


@query("SELECT doc_id, lang, place, short FROM (SELECT doc_id, lang, q, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) < q AS short FROM documents JOIN (VALUES ('en', 10), ('de', 5), ('fr', 7), ('es', 100000)) l(lang, q) USING (lang)) WHERE place <= q")
def language_quota(spark, sf_dir):
    limits = spark.createDataFrame([("en", 10), ("de", 5), ("fr", 7), ("es", 100000)], "lang string, quota int")
    return dedup.quota(table(spark, sf_dir, "documents"), "lang", limits, ["doc_id"]).select("doc_id", "lang", "place", "short")


@query("SELECT doc_id, row_number() OVER w AS item, count(*) OVER (PARTITION BY source) AS items, floor((row_number() OVER w - 1) / 16)::BIGINT AS chunk FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def source_batches(spark, sf_dir):
    return dedup.batch_chunks(table(spark, sf_dir, "documents"), ["source"], 16, ["doc_id"]).select("doc_id", "item", "items", "chunk")


@query("SELECT c_custkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY c_nationkey) AS \"of\", coalesce(lag(c_custkey) OVER w, last_value(c_custkey) OVER f) AS previous, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER f) AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), f AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def customer_neighbours(spark, sf_dir):
    return dedup.neighbours(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", ["c_acctbal", "c_custkey"]).select("c_custkey", "place", "of", "previous", "next")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_segments(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    old, new = c.withColumn("v", F.lit(0)), c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"), F.lit(1).alias("v"))
    return dedup.upsert(old, new, ["c_custkey"], "v").select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark, sf_dir):
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    _, left = dedup.delete_cascade(o, items, o.where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    return left.groupBy("l_orderkey").agg(F.count("*").alias("lines"))


# -- cost ------------------------------------------------------------------------------------------


def priced(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey"), F.lit(1).cast("long").alias("quantity"))
    prices = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("unit_price"))
    return items.join(prices, "p_partkey")


COST_SQL = "SELECT p_brand, l_partkey % 50 AS grp, count(*) AS n, arg_min(struct_pack(p := price), p_partkey).p AS first_price, sum(coalesce(price, 0)) AS s FROM (SELECT l_partkey, p_partkey, p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2"


@query(f"SELECT p_brand, grp, n, round(first_price, 4) AS unit_price, round(CASE WHEN first_price IS NOT NULL THEN s END, 2) AS subtotal FROM ({COST_SQL})")
def cost_breakdown(spark, sf_dir):
    out = cost.cost_breakdown(priced(spark, sf_dir).withColumn("grp", F.col("p_partkey") % 50), ["p_brand", "grp"], "p_partkey")
    return out.select("p_brand", "grp", "n", F.round("unit_price", 4).alias("unit_price"), F.round("subtotal", 2).alias("subtotal"))


@query(f"SELECT round(sum(CASE WHEN first_price IS NOT NULL THEN s END), 0) AS total, sum(n)::BIGINT AS items, sum(CASE WHEN first_price IS NULL THEN n END)::BIGINT AS unknown FROM ({COST_SQL})")
def cost_total(spark, sf_dir):
    b = cost.cost_breakdown(priced(spark, sf_dir).withColumn("grp", F.col("p_partkey") % 50), ["p_brand", "grp"], "p_partkey")
    return cost.cost_total(b).withColumn("total", F.round("total", 0))


@query("SELECT p_brand, count(*) AS entries, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN ('Brand#11', 'Brand#12') GROUP BY p_brand")
def cost_by_provider(spark, sf_dir):
    return cost.cost_by_provider(priced(spark, sf_dir), "p_brand", ["Brand#11", "Brand#12"])


@query("SELECT l_suppkey, bool_or(p_brand NOT IN ('Brand#11', 'Brand#12')) AS any_other FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def any_other_provider(spark, sf_dir):
    return cost.any_other_provider(priced(spark, sf_dir), "l_suppkey", "p_brand", ["Brand#11", "Brand#12"])


@query("WITH e AS (SELECT *, sum((o_orderkey % 9 = 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch FROM orders) SELECT o_orderkey, round(sum(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_totalprice END) OVER (PARTITION BY o_custkey, epoch ORDER BY o_orderdate, o_orderkey), 2) AS incurred FROM e")
def running_cost(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("reset", F.col("o_orderkey") % 9 == 0)
    return cost.running_cost(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "reset").select("o_orderkey", F.round("incurred", 2).alias("incurred"))


# -- catalog ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin') THEN '3d' WHEN contains(lower(p_type), 'steel') THEN 'audio' WHEN contains(lower(p_type), 'copper') THEN 'video' ELSE 'image' END AS kind FROM part")
def catalog_capabilities(spark, sf_dir):
    kind = catalog.infer_capabilities(F.col("p_type"), {"3d": ["brass", "tin"], "audio": ["steel"], "video": ["copper"]}, "image")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("SELECT doc_id FROM documents WHERE list_has_any(string_split(lower(text), ' '), ['the', 'der'])")
def documents_with_any(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("tokens", F.split(F.lower("text"), " "))
    return catalog.filter_any(d, "tokens", ["the", "der"]).select("doc_id")


RULES = {"short": ("the,der", "starts-with"), "licence": ("license", "contains"), "dot": (".", "ends-with")}


@query(r"""WITH d AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^[\s\x{0B}]+', ''), '[\s\x{0B}]+$', '')) AS t FROM documents), h AS (
  SELECT doc_id, list_filter(['short', 'licence', 'dot'], lambda r: CASE r WHEN 'short' THEN starts_with(t, 'the') OR starts_with(t, 'der') WHEN 'licence' THEN contains(t, 'license') ELSE ends_with(t, '.') END) AS o FROM d)
SELECT doc_id, unnest(CASE WHEN len(o) = 0 THEN ['default'] ELSE o END) AS output FROM h""")
def rule_routing(spark, sf_dir):
    rules = [(name, X.match_rule("text", value, mode)) for name, (value, mode) in RULES.items()]
    return catalog.route(table(spark, sf_dir, "documents"), rules, "doc_id")


# -- text ------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, len(x)::INT AS items, array_to_string(x[1:2], '|') AS head FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ', '), lambda s: regexp_replace(s, '^[@WHITE]+|[@WHITE]+$', '', 'g')), lambda s: s <> '') AS x FROM conversations)")
def split_by_delimiter(spark, sf_dir):
    items = X.split_text("text", "delimiter", ", ")["items"]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(items).alias("items"), F.concat_ws("|", F.slice(items, 1, 2)).alias("head"))


@query(r"""SELECT conv_id, turn, len(x)::INT AS items, array_to_string(x, chr(31)) AS joined FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ', '),
  lambda s: regexp_replace(s, '^[WHITE]+|[WHITE]+$', '', 'g')), lambda s: s <> '') AS x FROM conversations)""".replace("WHITE", r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"))
def split_all_turns(spark, sf_dir):
    """Every turn, also those of many lines, with all its items."""
    items = X.split_text("text", "delimiter", ", ")["items"]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(items).alias("items"), F.concat_ws("\x1f", items).alias("joined"))


@query("SELECT conv_id, turn, replace(replace('@role said @n words', '@role', role), '@n', (length(text) - length(replace(text, ' ', '')) + 1)::VARCHAR) AS text FROM conversations")
def fill_turn_template(spark, sf_dir):
    words = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1).cast("string")
    values = F.create_map(F.lit("role"), F.col("role"), F.lit("n"), words)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.fill_template(F.lit("@role said @n words"), values)["text"].alias("text"))


# -- time axis -------------------------------------------------------------------------------------


@query("WITH s AS (SELECT user_id, epoch(ts)::DOUBLE AS t, value, event_id FROM events), g AS (SELECT DISTINCT user_id, (floor(t / 86400) * 86400)::DOUBLE AS at FROM s) SELECT g.user_id, g.at, s.value FROM g ASOF JOIN (SELECT user_id, t, arg_max(value, event_id) AS value FROM s GROUP BY user_id, t) s ON s.user_id = g.user_id AND s.t <= g.at")
def resample_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "event_id")
    e = e.select("user_id", (F.col("us") / 1e6).alias("t"), "value", "event_id")
    targets = e.select("user_id", (F.floor(F.col("t") / 86400) * 86400.0).alias("t")).distinct()
    return timeline.resample_asof(e, targets, ["user_id"], "t", "value", "event_id").select("user_id", F.col("t").alias("at"), "value")


@query("WITH s AS (SELECT 0 AS series, epoch(ts)::DOUBLE AS t, value, event_id FROM events), g AS (SELECT DISTINCT (floor(t / 600) * 600)::DOUBLE AS at FROM s) SELECT g.at, s.value FROM g ASOF JOIN (SELECT t, arg_max(value, event_id) AS value FROM s GROUP BY t) s ON s.t <= g.at")
def resample_all_events(spark, sf_dir):
    """All events as one series, scanned in parts."""
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_id")
    targets = e.select("series", (F.floor(F.col("t") / 600) * 600.0).alias("t")).distinct()
    return timeline.resample_asof(e, targets, ["series"], "t", "value", "event_id", long=True).select(F.col("t").alias("at"), "value")


@query("SELECT b AS bucket, max(abs(value)) AS peak FROM (SELECT value, (row_number() OVER (ORDER BY ts, event_id) - 1) // greatest(1, count(*) OVER () // 256) AS b FROM events) WHERE b < 256 GROUP BY 1")
def peaks_of_all_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("series", F.lit(0))
    return timeline.peaks(e, ["series"], ["ts", "event_id"], "value", long=True).select("bucket", "peak")


@query("WITH e AS (SELECT *, sum((o_orderkey % 97 = 0)::INT) OVER (ORDER BY o_orderdate, o_orderkey) AS epoch FROM orders) SELECT o_orderkey, round(sum(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_totalprice END) OVER (PARTITION BY epoch ORDER BY o_orderdate, o_orderkey), 2) AS incurred FROM e")
def running_cost_of_all(spark, sf_dir):
    """All orders as one account."""
    o = table(spark, sf_dir, "orders").withColumns({"reset": F.col("o_orderkey") % 97 == 0, "account": F.lit(0)})
    return cost.running_cost(o, "account", ["o_orderdate", "o_orderkey"], "o_totalprice", "reset", long=True).select("o_orderkey", F.round("incurred", 2).alias("incurred"))


@query("SELECT user_id, b AS bucket, max(abs(value)) AS peak FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // greatest(1, count(*) OVER (PARTITION BY user_id) // 16) AS b FROM events) WHERE b < 16 GROUP BY 1, 2")
def value_peaks(spark, sf_dir):
    return timeline.peaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 16)


@query("SELECT user_id, event_id, round(t - min(t) OVER (PARTITION BY user_id), 3) AS t FROM (SELECT user_id, event_id, epoch(ts)::DOUBLE - min(epoch(ts)::DOUBLE) OVER () AS t FROM events) WHERE t >= 86400 AND t < 864000")
def trim_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    first = e.agg(F.min("t").alias("first"))
    e = e.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("first"))
    return timeline.trim(e, ["user_id"], "t", 86400.0, 864000.0).select("user_id", "event_id", F.round("t", 3).alias("t"))


@query("SELECT event_id, round(u * u * u, 10) AS cubic_in, round(sin(u * pi() / 2), 10) AS sine_out, round(CASE WHEN u < 0.5 THEN 2 * u * u ELSE 1 - (2 - 2 * u) * (2 - 2 * u) / 2 END, 10) AS quad_both FROM (SELECT event_id, least(1.0, abs(value) / 500)::DOUBLE AS u FROM events)")
def eased_values(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("event_id", F.least(F.lit(1.0), F.abs("value") / 500).alias("u"))
    return u.select("event_id", F.round(easing.ease("u", "easeInCubic"), 10).alias("cubic_in"), F.round(easing.ease("u", "easeOutSine"), 10).alias("sine_out"), F.round(easing.ease("u", "easeInOutQuad"), 10).alias("quad_both"))


# -- placement and chart rows ----------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::DOUBLE + 20) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS at FROM lineitem")
def stacked_lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("double"))
    return graph.stack(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "size").select("l_orderkey", "l_linenumber", F.col("offset").alias("at"))


@query("SELECT o_custkey, o_orderkey, (n // c)::BIGINT AS at_row, (n % c)::BIGINT AS at_column FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, ceil(sqrt(count(*) OVER (PARTITION BY o_custkey)))::BIGINT AS c FROM orders)")
def order_grid(spark, sf_dir):
    g = graph.grid(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"])
    return g.select("o_custkey", "o_orderkey", F.col("row").alias("at_row"), F.col("column").alias("at_column"))


@query("WITH r AS (SELECT conv_id % 3 AS brand, 'by_role' AS dimension, role AS label, count(*)::DOUBLE AS value FROM conversations GROUP BY 1, 3 UNION ALL SELECT conv_id % 3, 'by_turn', turn::VARCHAR, count(*)::DOUBLE FROM conversations GROUP BY 1, 3) SELECT brand, dimension, CASE WHEN label = 'user' THEN 'assistant' WHEN label = 'assistant' THEN 'reply' ELSE label END AS label, value, least(100, value) AS width, row_number() OVER (PARTITION BY brand, dimension ORDER BY value DESC, label) AS place FROM r")
def tidy_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("brand", F.col("conv_id") % 3)

    def counts(by: str, name: str) -> DataFrame:
        n = c.groupBy("brand", F.col(by).cast("string").alias("label")).count()
        return n.groupBy("brand").agg(F.map_from_entries(F.collect_list(F.struct("label", "count"))).alias(name))

    return visibility.score_to_tidy(counts("role", "by_role").join(counts("turn", "by_turn"), "brand"), ["brand"], ["by_role", "by_turn"], {"user": "assistant", "assistant": "reply"})


# -- stored forms ----------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN length(text) > 90000 THEN left(text, 90000) || chr(10) || '[…truncated]' ELSE text END AS text FROM conversations WHERE role = 'assistant'")
def answer_previews(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return documents.split_raw_preview(c)[1].select("conv_id", "turn", "text")


@query("SELECT conv_id % 3 AS brand_id, CASE conv_id % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' ELSE 'Unknown Brand' END AS brand_name, role, count(*)::DOUBLE AS n FROM conversations GROUP BY 1, 2, 3")
def score_read_back(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 3).alias("brand_id"), "role").count()
    scores = counts.groupBy("brand_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "count"))).alias("by_role"))
    brands = spark.createDataFrame([(0, "Zero"), (1, "One"), (2, "")], "brand_id long, brand_name string")
    back = documents.decode_scores(documents.encode_scores(scores, ["by_role"]), ["by_role"], brands)
    return back.select("brand_id", "brand_name", F.explode("by_role").alias("role", "n"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, arg_max(l_partkey, (l_shipdate, l_partkey)) FILTER (l_linenumber = 1) AS first_part FROM lineitem GROUP BY 1")
def order_part_map(spark, sf_dir):
    m = documents.images_for_board(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return m.select("l_orderkey", F.size("images").alias("n"), F.try_element_at("images", F.lit(1).cast(m.schema["images"].dataType.keyType)).alias("first_part"))


@query("SELECT e.* EXCLUDE (ts, props) FROM events e JOIN (SELECT user_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 10) USING (user_id)")
def newest_sessions(spark, sf_dir):
    return documents.retain_sessions(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "user_id", "event_type", "value")


# -- streams ---------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; as a pattern, the path may be one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_kpis(spark, sf_dir):
    k = jobs.stream_kpis(event_stream(spark, sf_dir), "ts", "1 day", "7 days", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    return jobs.drain(k, "kpis", "update", ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT DISTINCT md5(event_type || '|' || props) AS hash FROM events")
def stream_distinct_content(spark, sf_dir):
    return jobs.drain(jobs.stream_dedup(event_stream(spark, sf_dir), F.concat_ws("|", "event_type", "props"), "ts", "400 days"), "dedup").select("hash")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_sessions(spark, sf_dir):
    s = jobs.sessionize(event_stream(spark, sf_dir), ["user_id"], "ts", "6 hours", "1 day")
    return jobs.drain(s, "sessions").select("user_id", F.unix_micros("start").alias("start_us"), "n")


RECENT_SQL = "SELECT user_id, place, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY 1, 2)) WHERE place <= "


@query(RECENT_SQL + "8")
def stream_recent_types(spark, sf_dir):
    r = jobs.stream_recents(event_stream(spark, sf_dir), ["user_id"], "event_type", "ts")
    return jobs.drain(r, "recents", "update", ["user_id", "place"]).select("user_id", "place", "event_type")


@query(RECENT_SQL + "2")
def stream_newest_types(spark, sf_dir):
    """With items that fall off the list."""
    r = jobs.stream_recents(event_stream(spark, sf_dir), ["user_id"], "event_type", "ts", 2)
    return jobs.drain(r, "recents", "update", ["user_id", "place"]).select("user_id", "place", "event_type")


@query("SELECT user_id, round(coalesce(sum(value) FILTER (r IS NULL OR ts > r OR ts = r AND event_id > i), 0), 2) AS total FROM events LEFT JOIN (SELECT user_id, max(ts) AS r, arg_max(event_id, ts) AS i FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id) GROUP BY 1")
def stream_cost_since_reset(spark, sf_dir):
    e = event_stream(spark, sf_dir).withColumn("reset", F.col("event_type") == "error")
    return jobs.stream_running_cost(e, "user_id", ["ts", "event_id"], "value", "reset").select("user_id", F.round("total", 2).alias("total"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE arg_max(event_type, ts) END AS status FROM events GROUP BY 1")
def stream_task_status(spark, sf_dir):
    e = event_stream(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")))
    return jobs.drain(jobs.latest_status(e, "user_id", "status", "ts"), "status", "update", ["user_id"])


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR - INTERVAL 8 HOUR")
def stream_fresh_events(spark, sf_dir):
    """Users' newest events, eight hours long at most by a clock one hour behind the newest event."""
    e = event_stream(spark, sf_dir).withColumn("event", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    fresh = jobs.drain(jobs.stream_fresh_values(e.select("user_id", "event", "ts"), ["user_id"], "event", "ts", "8 hours", "1 hour"), "fresh", "update", ["user_id"])
    return fresh.where("not expired").select("user_id", F.col("event").cast("long").alias("event_id"))


@query("WITH h AS (SELECT event_id, list_filter(['large', 'errors', 'first'], lambda r: CASE r WHEN 'large' THEN abs(value) > 300 WHEN 'errors' THEN event_type = 'error' ELSE contains(props, '1') END) AS o FROM events) SELECT event_id, unnest(CASE WHEN len(o) = 0 THEN ['default'] ELSE o END) AS output FROM h")
def stream_routed_events(spark, sf_dir):
    rules = {"large": F.abs("value") > 300, "errors": F.col("event_type") == "error", "first": F.col("props").contains("1")}
    return jobs.route_to(event_stream(spark, sf_dir), rules, graph.shared_folder(spark, "routed")).select("event_id", "output")
