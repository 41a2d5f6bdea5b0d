"""Queries on curves, time warps, layouts and model schemas."""

from pyspark.sql import functions as F

from ..functions import easing
from ..operators import layout, schema, timeline
from ..registry import dealt, query, table

HALF = {"Quad": "{0}*{0}", "Cubic": "{0}*{0}*{0}", "Quart": "{0}*{0}*{0}*{0}", "Quint": "{0}*{0}*{0}*{0}*{0}", "Sine": "1-cos({0}*pi()/2)", "Expo": "CASE WHEN {0}=0 THEN 0 ELSE power(2,10*{0}-10) END", "Circ": "1-sqrt(greatest(0,1-{0}*{0}))"}


def curve_sql(name: str, u: str = "u") -> str:
    if name == "linear":
        return u
    if name == "easeInExpoOutCubic":
        return f"CASE WHEN {u} <= 0.5 THEN 0.5*({HALF['Expo'].format(f'(2*{u})')}) ELSE 1 - 0.5*({HALF['Cubic'].format(f'(2-2*{u})')}) END"
    if name == "easeInQuartOutQuad":
        return f"CASE WHEN {u} <= 0.5 THEN 0.5*({HALF['Quart'].format(f'(2*{u})')}) ELSE 1 - 0.5*({HALF['Quad'].format(f'(2-2*{u})')}) END"
    if name.startswith("easeInOut"):
        k = HALF[name.removeprefix("easeInOut")]
        return f"CASE WHEN {u} < 0.5 THEN ({k.format(f'(2*{u})')})/2 ELSE 1 - ({k.format(f'(2-2*{u})')})/2 END"
    if name.startswith("easeOut"):
        return f"1 - ({HALF[name.removeprefix('easeOut')].format(f'(1-{u})')})"
    return HALF[name.removeprefix("easeIn")].format(u)


UNIT_SQL = "SELECT event_id, least(1.0, abs(value) / 500)::DOUBLE AS u FROM events"


def units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(1.0), F.abs("value") / 500).alias("u"))


@query(f"SELECT event_id, {', '.join(f'round({curve_sql(n)}, 7)::DOUBLE AS {n}' for n in easing.NAMES)} FROM ({UNIT_SQL})")
def every_curve(spark, sf_dir):
    return units(spark, sf_dir).select("event_id", *[F.round(easing.ease("u", n), 7).cast("double").alias(n) for n in easing.NAMES])


@query(f"WITH RECURSIVE b AS (SELECT event_id, u, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM ({UNIT_SQL}) UNION ALL SELECT event_id, u, CASE WHEN x < u THEN mid ELSE lo END, CASE WHEN x < u THEN hi ELSE mid END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, 3 * mid * (1 - mid) * (1 - mid) * 0.42 + 3 * mid * mid * (1 - mid) * 0.58 + mid * mid * mid AS x FROM b WHERE i < 40)) SELECT event_id, round(3 * t * t * (1 - t) + t * t * t, 4)::DOUBLE AS y FROM (SELECT event_id, (lo + hi) / 2 AS t FROM b WHERE i = 40)")
def bezier_values(spark, sf_dir):
    return units(spark, sf_dir).select("event_id", F.round(easing.bezier("u", easing.DEFAULT_BEZIER), 4).alias("y"))


@query(f"""WITH RECURSIVE w AS (SELECT event_id, u, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.5::DOUBLE AS t, false AS done, 0 AS i FROM ({UNIT_SQL}) UNION ALL
SELECT event_id, u, CASE WHEN gap < 0 THEN m ELSE lo END, CASE WHEN gap < 0 THEN hi ELSE m END, m, done OR abs(gap) <= 1e-6, i + 1 FROM (SELECT *, {curve_sql("easeInOutCubic", "m")} - u AS gap FROM (SELECT *, CASE WHEN done THEN t ELSE (lo + hi) / 2 END AS m FROM w WHERE i < 32)))
SELECT event_id, round(1.5 * CASE WHEN u <= 1e-6 THEN 0 WHEN u >= 1 - 1e-6 THEN 1 ELSE t END, 9)::DOUBLE AS warped FROM w WHERE i = 32""")
def warped_times(spark, sf_dir):
    return units(spark, sf_dir).select("event_id", F.round(easing.warp_time("u", 1.0, 1.5, "easeInOutCubic"), 9).alias("warped"))


@query("SELECT c_custkey, round(10.0 * floor((1 + c_custkey % 7) * 4) / floor((1 + c_custkey % 7) * 4) * 1.0, 3)::DOUBLE / 10 AS avg_speed FROM customer")
def warp_speeds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(5.0).alias("d_in"), (1.0 + F.col("c_custkey") % 7).alias("d_out"))
    return easing.warp_stats(c, ["c_custkey"], "d_in", "d_out", "linear").select("c_custkey", F.round("avg_speed", 3).alias("avg_speed"))


@query("""WITH p AS (SELECT c_custkey, 2.0 + c_custkey % 5 AS d_in, 1.0 + c_custkey % 7 AS d_out, unnest(range(100)) AS k FROM customer), s AS (SELECT c_custkey, (d_in / 100) / ((sqrt((k + 1) / 100.0) - sqrt(k / 100.0)) * d_out + 1e-10) / (d_in / d_out) AS speed FROM p)
SELECT c_custkey, round(min(speed), 2) AS min_speed, round(max(speed), 1) AS max_speed, round(avg(speed), 3) AS avg_speed FROM s GROUP BY 1""")
def warp_speeds_of_a_curve(spark, sf_dir):
    """The inverse of a square is a root: slow pieces first and fast ones last."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (2.0 + F.col("c_custkey") % 5).alias("d_in"), (1.0 + F.col("c_custkey") % 7).alias("d_out"))
    found = easing.warp_stats(c, ["c_custkey"], "d_in", "d_out", "easeInQuad")
    return found.select("c_custkey", F.round("min_speed", 2).alias("min_speed"), F.round("max_speed", 1).alias("max_speed"), F.round("avg_speed", 3).alias("avg_speed"))


@query("WITH s AS (SELECT c_custkey, 2.0 + c_custkey % 5 AS d_in, 1 + c_custkey % 3 AS d_out, (1 + c_custkey % 3) * 4 AS n FROM customer), k AS (SELECT *, unnest(range(n)) AS slot FROM s) SELECT c_custkey, slot, round(slot * 0.25, 6)::DOUBLE AS at, round(greatest(0, least(power(slot / (n - 1.0), 2) * d_in, d_in - 0.001)), 6)::DOUBLE AS source_time FROM k")
def slot_schedule(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (2.0 + F.col("c_custkey") % 5).alias("d_in"), (1 + F.col("c_custkey") % 3).alias("d_out"))
    s = easing.eased_schedule(c, ["c_custkey"], "d_in", "d_out", 4.0, "easeInQuad")
    return s.select("c_custkey", "slot", F.round("at", 6).alias("at"), F.round("source_time", 6).alias("source_time"))


@query("""WITH p AS (SELECT user_id, event_id, event_type, floor(epoch(ts)::DOUBLE / 3600) AS h FROM events), q AS (SELECT *, h - min(h) OVER (PARTITION BY user_id, event_type) AS off FROM p),
l AS (SELECT user_id, event_type, max(off) + 1 AS n FROM q GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(n) OVER (PARTITION BY user_id) AS total FROM l)
SELECT user_id, event_id, r::INT AS round, (r * total + base + off)::BIGINT AS slot FROM q JOIN b USING (user_id, event_type), (VALUES (0), (1)) x(r)""")
def stitched_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).cast("double").alias("h"))
    return timeline.stitch(e, ["user_id"], "event_type", "h", 1.0, 2).select("user_id", "event_id", "round", F.col("slot").cast("long").alias("slot"))


SIZE_SQL = "SELECT p_partkey, (400 + 37 * p_size)::DOUBLE AS w, (300 + p_partkey % 500)::DOUBLE AS h FROM part"


@query(f"""WITH s AS ({SIZE_SQL}), g AS (SELECT *, (w / c) / (h / r) AS cell FROM s, range(1, 7) a(r), range(1, 7) b(c) WHERE r > 1 OR c > 1),
k AS (SELECT p_partkey, r, c, 0.45 * exp(-3 * list_min(list_transform([16.0::DOUBLE / 9, 4.0::DOUBLE / 3, 1.5, 1.85, 2.39, 1.0, 9.0::DOUBLE / 16, 0.75, 2.0::DOUBLE / 3], lambda x: greatest(cell / x, x / cell) - 1))) + 0.25 * exp(-2 * (greatest((w / h) / (c::DOUBLE / r), (c::DOUBLE / r) / (w / h)) - 1)) + 0.15 * least(r * c / 6.0::DOUBLE, 1) + 0.15 * (1 - abs(r - c) / greatest(r, c)::DOUBLE) AS score FROM g)
SELECT p_partkey, round(max(score), 6)::DOUBLE AS best, round(avg(score), 6)::DOUBLE AS mean FROM k GROUP BY 1""")
def layout_score_stats(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (400.0 + 37 * F.col("p_size")).alias("w"), (300.0 + F.col("p_partkey") % 500).alias("h"))
    return layout.layout_scores(p, "p_partkey", "w", "h").groupBy("p_partkey").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query()
def best_layouts(spark, sf_dir):
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", (400.0 + 37 * F.col("p_size")).alias("w"), (300.0 + F.col("p_partkey") % 500).alias("h"))
    return layout.rank_layouts(p, "p_partkey", "w", "h").select("p_partkey", "place", "rows", "cols", F.round("score", 6).alias("score"))


@query(f"SELECT p_partkey, r::INT AS row, c::INT AS col, floor(c * (w / 3) + 0.5)::BIGINT AS x, floor(r * (h / 2) + 0.5)::BIGINT AS y, floor(w / 3 + 0.5)::BIGINT AS width, floor(h / 2 + 0.5)::BIGINT AS height FROM ({SIZE_SQL}), range(0, 2) a(r), range(0, 3) b(c)")
def image_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (400.0 + 37 * F.col("p_size")).alias("w"), (300.0 + F.col("p_partkey") % 500).alias("h"))
    return layout.grid_cells(p, "p_partkey", "w", "h", 2, 3)


PLACED_SQL = "SELECT p_partkey // 50 AS workflow_id, p_partkey % 50 AS node_id, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 53 % 700)::DOUBLE AS y, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 10.0 END AS measured FROM part"


def placed(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 50).alias("workflow_id"), (k % 50).alias("node_id"), (k * 37 % 1000).cast("double").alias("x"), (k * 53 % 700).cast("double").alias("y"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 10.0).alias("measured"))


@query(f"SELECT workflow_id, min(x) - 20 AS x, min(y) - 20 AS y, max(x + coalesce(measured, 300)) - min(x) + 40 AS width, max(y + 280) - min(y) + 40 AS height FROM ({PLACED_SQL}) GROUP BY 1")
def group_boxes(spark, sf_dir):
    return layout.bounding_box(placed(spark, sf_dir).withColumn("none", F.lit(0)), ["workflow_id"], "x", "y", ["measured"], ["none"])


@query(f"WITH RECURSIVE d AS (SELECT DISTINCT workflow_id, y FROM ({PLACED_SQL})), b AS (SELECT workflow_id, min(y) AS start FROM d GROUP BY 1 UNION ALL SELECT b.workflow_id, (SELECT min(d.y) FROM d WHERE d.workflow_id = b.workflow_id AND d.y > b.start + 50) FROM b WHERE b.start IS NOT NULL) SELECT p.workflow_id, p.node_id, row_number() OVER (PARTITION BY p.workflow_id ORDER BY (SELECT max(b.start) FROM b WHERE b.workflow_id = p.workflow_id AND b.start <= p.y), p.x, p.node_id) AS place FROM ({PLACED_SQL}) p")
def nodes_as_read(spark, sf_dir):
    return layout.reading_order(placed(spark, sf_dir), "workflow_id", "x", "y", "node_id").select("workflow_id", "node_id", "place")


def schemas(spark, sf_dir):
    """A schema for each part: properties that depend on its key."""
    k = F.col("p_partkey")
    props = F.concat_ws(",", F.lit('"Prompt_Text":{"type":"string"}'), F.when(k % 2 == 0, '"image_url":{"type":"string","description":"Source"}').otherwise('"input_images":{"type":"array","items":{"type":"string"},"description":"An image url"}'), F.when(k % 3 == 0, '"num_inference_steps":{"anyOf":[{"type":"null"},{"type":"integer"}],"default":20}'), F.when(k % 5 == 0, '"mode":{"$ref":"#/components/schemas/Mode"}'), F.lit('"seed":{"type":"integer","minimum":1},"webhook":{"type":"string"}'))
    text = F.concat(F.lit('{"components":{"schemas":{"Mode":{"type":"string","enum":["a","b"]},"Input":{"required":["seed"],"properties":{'), props, F.lit("}}}}}"))
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", text.alias("schema"))


@query("SELECT p_partkey, 'Prompt_Text' AS prompt, CASE WHEN p_partkey % 2 = 0 THEN 'image_url' ELSE 'input_images' END AS image, CASE WHEN p_partkey % 3 = 0 THEN 'num_inference_steps' END AS steps, 'seed' AS seed, 3 + (p_partkey % 3 = 0)::INT AS n FROM part")
def parameter_names(spark, sf_dir):
    m = F.col("m")
    return schemas(spark, sf_dir).select("p_partkey", schema.param_mapping("schema").alias("m")).select("p_partkey", m["prompt"].alias("prompt"), m["image"].alias("image"), m["steps"].alias("steps"), m["seed"].alias("seed"), F.size(m).alias("n"))


@query("SELECT p_partkey, 'Prompt_Text:string,' || CASE WHEN p_partkey % 2 = 0 THEN 'image_url:string' ELSE 'input_images:array' END || ',seed:integer,webhook:string' AS types FROM part")
def parameter_types(spark, sf_dir):
    t = schema.param_types("schema")
    return schemas(spark, sf_dir).select("p_partkey", F.array_join(F.transform(F.map_entries(t), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("types"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'image_url' ELSE 'input_images' END AS name, 'image' AS type, CASE WHEN p_partkey % 2 = 0 THEN 'Image' ELSE 'Input Images' END AS label, p_partkey % 2 = 1 AS is_array FROM part")
def model_inputs(spark, sf_dir):
    return schema.schema_inputs(schemas(spark, sf_dir), "p_partkey").select("p_partkey", "name", "type", "label", "is_array")


@query("""SELECT p_partkey, 'Prompt_Text' AS name, 'string' AS type, false AS required, NULL AS "default", NULL::DOUBLE AS minimum, NULL AS enum FROM part UNION ALL SELECT p_partkey, 'num_inference_steps', 'integer', false, '20', NULL, NULL FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'mode', 'string', false, NULL, NULL, '["a","b"]' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'seed', 'integer', true, NULL, 1, NULL FROM part""")
def model_parameters(spark, sf_dir):
    return schema.schema_params(schemas(spark, sf_dir), "p_partkey").select("p_partkey", "name", "type", "required", "default", "minimum", "enum")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN (event_id % 100)::VARCHAR WHEN 'view' THEN 'false' WHEN 'error' THEN '\"x' || event_id || '\"' WHEN 'signup' THEN (event_id % 100) || '.5' ELSE '\"' || (event_id % 100) || '.5px\"' END AS value FROM events")
def coerced_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "event_id")).otherwise(F.concat((F.col("event_id") % 100).cast("string"), F.lit(".5px")))
    kind = F.create_map(*[F.lit(x) for x in ("click", "integer", "view", "boolean", "error", "integer", "signup", "number", "purchase", "string")])[F.col("event_type")]
    return e.select("event_id", raw.alias("raw"), kind.alias("kind")).select("event_id", schema.coerce_param("raw", "kind").alias("value"))
