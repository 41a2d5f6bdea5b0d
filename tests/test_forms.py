"""Edge cases of forms, curves, catalogs, schemas and sources on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import easing
from loomspark.functions import text as X
from loomspark.functions.semantics import short
from loomspark.operators import catalog, cost, edits, forms, intel, layout, leads, schema, validate
from loomspark.sources import documents


def values(spark, column, kind, *xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r["v"] for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_curves_start_at_0_end_at_1_and_rise(spark):
    t = np.linspace(0, 1, 101)
    df = spark.createDataFrame([(float(x),) for x in t], "t double")
    rows = df.select("t", *[easing.ease("t", n).alias(n) for n in easing.NAMES]).orderBy("t").collect()
    for n in easing.NAMES:
        y = [r[n] for r in rows]
        assert abs(y[0]) < 1e-9 and abs(y[-1] - 1) < 1e-9 and all(b >= a - 1e-9 for a, b in zip(y, y[1:], strict=False))
        assert easing.warp_problems(name=n) == []
    assert values(spark, easing.ease("x", "no such curve"), "double", 0.3, None) == [0.3, None]
    assert values(spark, easing.ease("x", lambda c: c * 2), "double", 0.3) == [0.6]


def test_warp_and_bezier(spark):
    got = values(spark, easing.warp_time("x", 5.0, 1.5, "easeInOutCubic"), "double", 0.0, 2.5, 5.0, -3.0, 9.0, None)
    assert got[:5] == pytest.approx([0, 0.75, 1.5, 0, 1.5], abs=1e-5) and got[5] is None
    assert values(spark, easing.bezier("x", (0, 0, 1, 1)), "double", 0.25, None)[0] == pytest.approx(0.25, abs=1e-6)
    assert values(spark, easing.bezier("x", easing.preset_bezier("easeInOutSine")), "double", 0.0, 0.5, 1.0) == pytest.approx([0, 0.5, 1], abs=1e-6)
    assert easing.preset_bezier(None) == easing.DEFAULT_BEZIER
    pieces = values(spark, easing.warped_duration("x", F.lit(0.5), 5.0, 1.5), "double", *[i / 2 for i in range(10)])
    assert sum(pieces) == pytest.approx(1.5, abs=1e-4) and min(pieces) > 0


def test_page_rules(spark):
    assert values(spark, intel.html_title("x"), "string", "<TITLE a=1> A \n B </title>", "<title></title><title>x</title>", "no", None) == ["A \n B", "x", "", None]
    metas = ['<meta name="description" content=" a ">', "<meta content='b' name='description'>", '<meta name="description" content=""><meta content="c" name="description">', '<meta name="keywords" content="k">', '<meta name="description" content="a > b">']
    assert values(spark, intel.html_meta("x"), "string", *metas) == ["a", "b", "c", "", "a > b"]
    assert values(spark, intel.html_body("x"), "string", "<body></body>tail", "<p>all</p>", "<body><script>x</script><style>y</style> a  <b>c</b></body>") == ["", "all", "a c"]
    assert values(spark, intel.page_gaps("x", F.lit(0)), "string", None, "blog gtag itemtype") == [[intel.UNFETCHED], ["thin homepage content"]]


def test_icp_anti_list_and_unfetched(spark):
    rows = [(1, "https://a", None, "Gambling SaaS", "x", "DE"), (2, "http://a", "<body>blog</body>", None, "", None), (3, "a", "x", "Education", "", "AT")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, industry string, industry_sub string, country string")
    none = F.lit(None).cast("array<string>")
    df = intel.page_maturity(df).withColumns({c: none for c in ("products", "services", "pain_points", "content_themes")} | {"pricing_model": F.lit(None).cast("string"), "gtm_playbook": F.lit("")})
    got = {r["page_id"]: r for r in leads.icp_total(leads.icp_parts(df)).collect()}
    assert got[1]["industry_fit"]["score"] == 0 and got[1]["digital_maturity"]["score"] == 0 and "anti" in got[1]["industry_fit"]["reasons"][0]
    assert got[2]["industry_fit"]["score"] == 5 and got[3]["industry_fit"]["score"] == 21 and got[3]["tier"] == "cold"
    assert all(r["total"] == sum(r[c]["score"] for c in leads.MOST) for r in got.values())
    own = {r["page_id"]: r["industry_fit"]["score"] for r in leads.icp_parts(df, {"geo_focus": [], "anti": []}).collect()}
    assert own == {1: 25, 2: 5, 3: 18}


def test_split_rules(spark):
    split = lambda text, **k: tuple(values(spark, X.split_text("x", **k), "string", text)[0])
    assert split(" one * two *  * three ") == (["one", "two", "three"], None)
    assert split("a\nb\r\nc", mode="newline")[0] == ["a", "b", "c"] and split("a1b2c3", mode="regex", pattern=r"\d")[0] == ["a", "b", "c"]
    assert split("abc", delimiter="")[0] == ["abc"] and split("", delimiter=",") == ([], None) and split(None) == ([], None)
    assert split("aXbxc", mode="regex", pattern="/x/i")[0] == ["a", "b", "c"]
    assert "nested" in split("aaa", mode="regex", pattern="(a+)+")[1] and "too long" in split("a" * 100_001, mode="regex", pattern="b")[1]
    assert split(" a ,, b", delimiter=",", trim=False, drop_empty=False)[0] == [" a ", "", " b"]


def test_data_urls_and_extensions(spark):
    assert values(spark, forms.parse_data_url("x"), "string", "data:image/png;base64,AAAA", "http://x", None)[0]["mime"] == "image/png"
    assert values(spark, forms.mime_to_ext("x"), "string", "model/obj", "model/x", "audio/x", "text/x") == ["obj", "glb", "mp3", "bin"]
    assert values(spark, forms.url_ext("x"), "string", "https://a/b.GLB?x", "https://a/b", "https://a/b.", "https://a.png/b.exe", "no url", None) == ["glb", None, None, None, None, None]
    meta = json.loads(values(spark, forms.image_metadata("x"), "string", "data:image/jpeg;base64," + "A" * 4096)[0])
    assert meta == {"format": "jpeg", "sizeKB": 3, "isDataURI": True}


def test_coercion_and_schemas(spark):
    rows = [("12px", "integer"), ("x", "integer"), ("1.50", "number"), ("2.0", "number"), (".5e1z", "number"), ("true", "boolean"), ("yes", "boolean"), ('a"b', "string"), (None, "integer"), ("5", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, k string")
    got = [r["o"] for r in df.select("i", schema.coerce_param("v", "k").alias("o")).orderBy("i").collect()]
    assert got == ["12", '"x"', "1.5", "2", "5", "true", "false", '"a\\"b"', None, '"5"']
    docs = spark.createDataFrame([(1, None), (2, "{}"), (3, "not json"), (4, json.dumps({"components": {"schemas": {"Input": {"properties": {"audio_x": {"type": "string"}, "a_image": {"oneOf": [{"$ref": "#/components/schemas/U"}]}, "image_size": {"type": "string"}, "go_fast": {"type": "boolean"}, "n_images": {"type": "integer"}}}, "U": {"type": "string", "format": "uri"}}}}))], "k int, schema string")
    assert [(r["k"], r["name"], r["type"]) for r in schema.schema_inputs(docs, "k").orderBy("pos").collect()] == [(4, "audio_x", "audio"), (4, "a_image", "image")]
    assert {(r["name"], r["type"]) for r in schema.schema_params(docs, "k").collect()} == {("image_size", "string"), ("n_images", "integer")}


def test_edges_that_may_meet(spark):
    nodes = spark.createDataFrame([(1, n, t, i) for n, t, i in [("p", "prompt", None), ("r", "router", None), ("s", "switch", "text"), ("c", "conditionalSwitch", None), ("o", "output", None), ("v", "generateVideo", None), ("e", "easeCurve", None), ("g", "glbViewer", None)]], "workflow_id int, node_id string, type string, input_type string")
    cases = [("p", "text", "p", "prompt_a", True), ("p", "text", "p", "image", False), ("p", "x", "s", "generic-input", True), ("s", "a", "p", "text", True), ("s", "a", "p", "image", False), ("p", "image", "c", "text", False), ("c", "d", "p", "text", True), ("v", "video", "o", "image", True), ("v", "video", "p", "image", False), ("g", "3d", "r", "image", True), ("g", "3d", "p", "image", False), ("v", "audio", "o", "image", True), ("p", "image", "v", "audio-1", False), ("e", "easeCurve", "e", "easeCurve", True), ("e", "easeCurve", "p", "easeCurve", False), ("p", None, "o", "image", True), ("p", "first_frame", "o", "image", True), ("gone", "text", "gone", "text", True)]
    edges = spark.createDataFrame([(1, i, *c[:4]) for i, c in enumerate(cases)], "workflow_id int, ord int, source string, source_handle string, target string, target_handle string")
    got = {r["ord"]: r["compatible"] for r in validate.compatible_edges(nodes, edges).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_edits_in_order(spark):
    nodes = spark.createDataFrame([(1, "a", "prompt", '{"x": 1}'), (1, "b", "output", None), (2, "z", "prompt", "{}")], "workflow_id long, node_id string, type string, data string")
    edges = spark.createDataFrame([(1, "e1", "a", "b")], "workflow_id long, edge_id string, source string, target string")
    ops = [("updateNode", "a", None, None, None, None, None, '{"y": 2}'), ("removeNode", "gone", None, None, None, None, None, None), ("addEdge", None, None, None, "b", "a", "text", None), ("addEdge", None, None, None, "b", "gone", None, None), ("removeNode", "b", None, None, None, None, None, None), ("removeEdge", None, None, "e1", None, None, None, None), ("addNode", None, "array", None, None, None, None, None)]
    ops = spark.createDataFrame([(1, i, *o) for i, o in enumerate(ops)], "workflow_id long, ord int, type string, node_id string, node_type string, edge_id string, source string, target string, source_handle string, data string")
    r = edits.apply_edits(nodes, edges, ops).collect()
    assert len(r) == 1 and r[0]["applied"] == 4 and r[0]["node_ids"] == ["a", "array-ai-6"] and r[0]["edge_ids"] == []
    assert r[0]["skipped"] == ['removeNode: node "gone" not found', 'addEdge: target node "gone" not found', 'removeEdge: edge "e1" not found'] and json.loads(r[0]["data"]["a"]) == {"x": 1, "y": 2}
    assert edits.apply_edits(nodes, edges, ops.where("false")).count() == 0


def test_reading_order_and_boxes(spark):
    rows = [(1, "a", 50.0, 0.0), (1, "b", 10.0, 40.0), (1, "c", 0.0, 60.0), (1, "d", 5.0, 110.0), (1, "e", 0.0, 111.0), (2, "z", None, None)]
    df = spark.createDataFrame(rows, "k int, id string, x double, y double")
    got = {r["id"]: r["place"] for r in layout.reading_order(df, "k", "x", "y", "id").collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "d": 4, "e": 5, "z": 1}
    box = layout.bounding_box(df.where("k = 1").withColumn("w", F.lit(0.0)), ["k"], "x", "y", ["w"], ["w"]).first()
    assert (box["x"], box["y"], box["width"], box["height"]) == (-20, -20, 390, 431)


def test_costs_and_paths(spark):
    nodes = spark.createDataFrame([("nanoBanana", None, None, "nano-banana", "4K", None, None), ("nanoBanana", "fal", "m", "nano-banana-2", "2K", None, None), ("generateVideo", None, None, None, None, None, None), ("splitGrid", None, None, "nano-banana-pro", "4K", True, 6), ("splitGrid", None, None, "nano-banana-pro", "4K", False, 6), ("prompt", None, None, None, None, None, None)], "type string, provider string, model_id string, model string, resolution string, is_configured boolean, target_count int")
    got = sorted((r["provider"], r["model_id"], r["resolution"], r["quantity"], r["p"]) for r in cost.cost_quantities(nodes).withColumn("p", cost.unit_price("model_id", "resolution")).collect())
    assert got == [("fal", "m", "2K", 1, None), ("gemini", "nano-banana", "1K", 1, 0.039), ("gemini", "nano-banana-pro", "4K", 6, 0.24)]
    paths = {"/home/a": None, "home": "absolute", "/a/../b": "traversal", "/a/": "traversal", "//a": "traversal", "/etc": "/etc", "/usr/x": "/usr", "/usrx": None, None: "absolute", "/a.b/..c": None}
    for (p, want), e in zip(paths.items(), values(spark, catalog.validate_path("x")["error"], "string", *paths), strict=True):
        assert (e is None) if want is None else want in e, p


def test_client_pages_and_sessions(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"records": [{"id": f"r{i}{j}", "fields": {"Name": f"n{j}", "Other": 1}} for j in range(2)]}))
    got = documents.read_clients(spark, str(tmp_path), ["Name", "Status"]).collect()
    assert sorted((r["id"], r["Name"], r["Status"]) for r in got) == [(f"r{i}{j}", f"n{j}", None) for i in range(3) for j in range(2)]
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(15)], "s string, t int")
    documents.write_sessions(rows, "s", "t", str(tmp_path / "a"), str(tmp_path / "b"))
    assert {r["s"] for r in spark.read.json(str(tmp_path / "b")).collect()} == {f"s{i}" for i in range(5, 15)}


def test_only_short_tables_are_broadcast(spark):
    for most, hint in ((5, True), (3, False)):
        table = short(spark.range(5), most)
        assert table.count() == 5 and ("broadcast" in table._jdf.queryExecution().logical().toString().lower()) == hint


def test_definitions_are_looked_up_once(spark):
    """A schema's definitions are read in one step, not once a link, field and use; results by links, variants and names with quotes."""
    links = {f"L{i}": {"$ref": f"#/components/schemas/L{i + 1}"} for i in range(14)} | {"L14": {"type": "integer", "enum": [1.50, 2], "format": "uri", "default": "null"}}
    other = {f"X{i}": {"type": "object", "description": "x" * 200} for i in range(200)}
    props = {
        "a": {"allOf": [{"$ref": "#/components/schemas/L0"}]}, "b": {"$ref": "#/components/schemas/L13"}, "c": {"anyOf": [{"type": "null"}, {"$ref": "#/components/schemas/none"}, {"type": "number"}], "default": None}, "d": {"$ref": "#/components/schemas/it's"},
        "e": {"oneOf": ["x", [1], {"description": "of a variant"}], "description": ""}, "f": {"$ref": "elsewhere"},
    }
    text = json.dumps({"components": {"schemas": other | links | {"it's": {"type": "boolean"}, "Input": {"required": ["b"], "properties": props}}}})
    docs = spark.range(40).withColumn("schema", F.lit(text))
    rows = schema.schema_params(docs, "id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") < 80 and plan.count("from_json") < 10
    got = {(r["id"], r["name"]): (r["type"], r["required"], r["description"], r["default"], r["enum"]) for r in rows.collect()}
    one = {"a": ("integer", False, None, None, "[1.5,2]"), "b": ("integer", True, None, "null", "[1.5,2]"), "c": ("number", False, None, None, None), "d": ("boolean", False, None, None, None), "e": ("string", False, "", None, None), "f": ("string", False, None, None, None)}
    assert got == {(i, n): v for i in range(40) for n, v in one.items()}


def test_names_are_read_once(spark):
    """The mapping of 12 inputs by 60 patterns parses a schema once."""
    text = json.dumps({"components": {"schemas": {"Input": {"properties": {f"x{i}": {"type": "string", "description": "y" * 2000} for i in range(300)} | {"My_Seed": {}, "Prompt_Text": {}}}}}})
    docs = spark.range(40).select("id", F.concat(F.lit(text), F.repeat(F.lit(" "), F.col("id").cast("int"))).alias("schema"))
    m = docs.select("id", schema.param_mapping("schema").alias("m"))
    assert m._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert all(r["m"] == {"prompt": "Prompt_Text", "seed": "My_Seed"} for r in m.collect())


def test_best_of_a_row_without_a_sort(spark):
    """Layouts and searches are ranked in their row: as by a window, and nothing is dealt out or sorted over rows."""
    sizes = spark.range(300).select("id", (300.0 + F.col("id") * 7 % 501).alias("w"), (200.0 + F.col("id") * 13 % 401).alias("h"))
    best = layout.rank_layouts(sizes, "id", "w", "h", 5)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "rows", "cols")
    ranked = layout.layout_scores(sizes, "id", "w", "h").withColumn("place", F.row_number().over(w)).where("place <= 5").select(*best.columns)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, ranked.collect()))
    c = spark.createDataFrame([(1, "A", "a.test", "B2B SaaS"), (2, "B", None, "Ecommerce"), (3, None, "c.test", None)], "id int, company_name string, domain string, industry string")
    top = leads.company_queries(c, most=6)
    assert sorted(map(str, top.collect())) == sorted(map(str, intel.top_queries(leads.company_queries(c), "id", "weight", "ord").drop("place").collect()))
    for df in (best, top):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan
