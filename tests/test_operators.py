"""Rules of the operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import semantics as S
from loomspark.functions import text as X
from loomspark.operators import catalog, cost, dedup, dictionary, flow, graph, intel, timeline, visibility


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "want"), [(-0.125, -0.12), (1.005, 1.0), (2.345, 2.35), (0.0, 0.0)])
def test_round2_halves_go_up(spark, x, want):
    assert one(spark, S.round2("x"), x=x) == want


def test_text_rules(spark):
    assert one(spark, S.trim_all("x"), x="  a b\t\n") == "a b"
    assert one(spark, S.or_else("x", "d"), x="") == "d"
    assert one(spark, S.to_label("x"), x="max_out_PX") == "Max Out PX"
    assert [one(spark, S.format_cost("x"), x=x) for x in (0.0, 0.004, 1.005, 12.0)] == ["$0.00", "<$0.01", "$1.00", "$12.00"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Acme is first. Then others.", (True, 1, 1)),
        ("Others. acme, ACME and Acmeist!", (True, 2, 2)),
        ("Acmeist. xAcme. Acme1", (False, None, 0)),
        ("Ends with Acme", (True, 1, 1)),
        ("ÄAcme Acmeß. Acme", (True, 2, 1)),
        ("", (False, None, 0)),
        (None, (False, None, 0)),
    ],
)
def test_find_mention(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(X.find_mention("t", "Acme").alias("m")).first()["m"]
    assert (r["present"], r["position"], r["count"]) == want


def test_mentions_within_sentences_but_competitors_in_the_whole_text(spark):
    df = spark.createDataFrame([("big.\ncorp wins",)], "t string")
    r = df.select(X.find_mention("t", "big corp")["present"].alias("a"), X.competitors_in("t", ["corp", " ", "big"]).alias("b")).first()
    assert (r["a"], r["b"]) == (False, ["corp", "big"])


@pytest.mark.parametrize(
    ("args", "text", "items"),
    [
        ({"delimiter": "*"}, " one * two *  * three ", ["one", "two", "three"]),
        ({"mode": "newline"}, "a\nb\r\nc", ["a", "b", "c"]),
        ({"mode": "regex", "pattern": r"\d"}, "a1b2c3", ["a", "b", "c"]),
        ({"mode": "regex", "pattern": "/X/i"}, "axbXc", ["a", "b", "c"]),
        ({"delimiter": ""}, "a*b", ["a*b"]),
        ({"delimiter": "*", "trim": False, "drop_empty": False}, "a**b*", ["a", "", "b", ""]),
        ({}, None, []),
    ],
)
def test_split_text(spark, args, text, items):
    r = spark.createDataFrame([(text,)], "t string").select(X.split_text("t", **args).alias("s")).first()["s"]
    assert (r["items"], r["error"]) == (items, None)


def test_split_text_refuses_patterns(spark):
    for pattern in ("(a+)+", "(", "a" * 101):
        r = spark.createDataFrame([("aa",)], "t string").select(X.split_text("t", "regex", pattern=pattern).alias("s")).first()["s"]
        assert r["items"] == [] and r["error"]
    long = spark.createDataFrame([("a" * 100_001,)], "t string").select(X.split_text("t", "regex", pattern="b")["error"].alias("e")).first()["e"]
    assert long


def test_template_keeps_the_prefix_rule(spark):
    df = spark.createDataFrame([("@a meets @ab and @zz", {"a": "X", "ab": "Y"})], "t string, v map<string,string>")
    r = df.select(X.fill_template("t", "v").alias("f")).first()["f"]
    assert (r["text"], r["unresolved"]) == ("X meets Xb and @zz", ["zz"])


def test_tags_lines_and_json(spark):
    assert [tuple(x) for x in one(spark, X.var_tags("x"), x='<var="n">a\nb</var> <var="m"></var>')] == [("n", "a\nb"), ("m", "")]
    assert one(spark, X.parse_prompt_lines("x"), x='1. "First one"\n- second line\nabc\n\n') == ["First one", "second line"]
    for text in ('{"k": 1}', 'so:\n```json\n{"k": 1}\n```', 'well {"k": 1} then'):
        assert one(spark, F.try_variant_get(X.json_from_text("x"), "$.k", "int"), x=text) == 1


def test_rules_route_to_every_match(spark):
    df = spark.createDataFrame([(1, " Red apple "), (2, "pear"), (3, "")], "id long, t string")
    rules = [("red", X.match_rule("t", "red, blue", "starts-with")), ("apple", X.match_rule("t", "apple"))]
    got = {(r["id"], r["output"]) for r in catalog.route(df, rules, "id").collect()}
    assert got == {(1, "red"), (1, "apple"), (2, "default"), (3, "default")}
    assert catalog.route(df, rules, "id", paused=True).count() == 9


def test_scorecard_without_success(spark):
    df = spark.createDataFrame([("b", "m", "c", "error", True, 1)], "brand string, model string, category string, status string, mentioned boolean, position int")
    r = visibility.brand_kpis(df, ["brand"]).first()
    assert (r["total"], r["successful"], r["visibility_pct"], r["position_avg"]) == (1, 0, 0.0, None)


def test_cost_of_a_key_with_an_unknown_first_price(spark):
    df = spark.createDataFrame([("a", 1, 2, None), ("a", 2, 1, 5.0), ("b", 1, 3, 2.0), ("b", 2, 1, None)], "k string, o int, quantity int, unit_price double")
    got = {r["k"]: (r["n"], r["subtotal"]) for r in cost.cost_breakdown(df, ["k"], "o").collect()}
    assert got == {"a": (3, None), "b": (4, 6.0)}


def test_price_lookup_falls_back(spark):
    items = spark.createDataFrame([("m1", "1k"), ("m2", "1k"), ("m3", "4k")], "model string, resolution string")
    prices, fixed = spark.createDataFrame([("m1", 1.0)], "model string, price double"), spark.createDataFrame([("m2", "1k", 2.0), ("m1", "1k", 9.0)], "model string, resolution string, price double")
    assert {r["model"]: r["unit_price"] for r in cost.price_lookup(items, prices, fixed).collect()} == {"m1": 1.0, "m2": 2.0, "m3": None}


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a B "), (3, "c"), (4, "")], "id long, t string")
    once = dedup.dedup_text(df, "t", ["id"])
    assert sorted(r["id"] for r in once.collect()) == [1, 3, 4] == sorted(r["id"] for r in dedup.dedup_text(once, "t", ["id"]).collect())
    assert sorted(r["id"] for r in dedup.dedup_name(df, "t", ["id"]).collect()) == [1, 2, 3]


def test_externalize_and_hydrate(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id long, blob string")
    rows, store = dedup.externalize(df, "blob", F.lit("f"))
    assert store.count() == 1
    assert {r["id"]: r["blob"] for r in dedup.hydrate(rows, store).collect()} == {1: "x", 2: "x", 3: None}


def test_patch_replaces_given_fields_only(spark):
    target = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id long, x string, y string")
    got = {r["id"]: (r["x"], r["y"], r["updated_at"]) for r in dedup.patch(target, spark.createDataFrame([(1, None, "B")], "id long, x string, y string"), "id", ["x", "y"], F.lit("now")).collect()}
    assert got == {1: ("a", "B", "now"), 2: ("c", "d", None)}


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([], {"a": 0, "b": 0, "c": 0, "d": 0}),
        ([("a", "b"), ("b", "c"), ("c", "d")], {"a": 0, "b": 1, "c": 2, "d": 3}),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], {"a": 0, "b": 1, "c": 1, "d": 2}),
        ([("b", "c"), ("c", "b"), ("c", "d")], {"a": 0}),
        ([("gone", "b"), ("a", "missing")], {"a": 0, "c": 0, "d": 0}),
    ],
)
def test_levels(spark, edges, want):
    nodes = spark.createDataFrame([(1, x) for x in "abcd"], "workflow_id long, node_id string")
    table = spark.createDataFrame([(1, *e) for e in edges], "workflow_id long, source string, target string")
    assert {r["node_id"]: r["level"] for r in graph.levels(nodes, table).collect()} == want


def test_downstream_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (2, "a", "z")], "workflow_id long, source string, target string")
    seeds = spark.createDataFrame([(1, "a")], "workflow_id long, node_id string")
    assert {(r["workflow_id"], r["node_id"]) for r in graph.downstream(edges, seeds).collect()} == {(1, "a"), (1, "b"), (1, "c")}


@pytest.mark.parametrize(
    ("url", "valid"),
    [("https://a.example/x", True), ("http://b.example", True), ("ftp://c.example", False), ("http://localhost/", False), ("http://10.0.0.1", False), ("http://172.20.1.1", False), ("http://172.32.1.1", True), ("http://192.168.1.1", False), ("nonsense", False)],
)
def test_url_check(spark, url, valid):
    assert one(spark, intel.validate_url("u")["valid"], u=url) is valid


def test_body_falls_back_only_without_a_body(spark):
    assert one(spark, intel.html_body("h"), h="<p>a</p>") == "a"
    assert one(spark, intel.html_body("h"), h="x<body></body>y") == ""


def test_signals_take_zero_as_missing(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 150.0), (-1.0, 10.0)], "confidence double, relevance double")
    assert [tuple(r) for r in intel.clamp_signal(df).collect()] == [(0.5, 50.0), (1.0, 100.0), (0.0, 10.0)]


def test_resample_holds_the_last_value(spark):
    series = spark.createDataFrame([("s", 1.0, 10.0, 1), ("s", 3.0, 30.0, 2)], "k string, t double, v double, o long")
    targets = spark.createDataFrame([("s", 0.5), ("s", 1.0), ("s", 2.9), ("s", 9.0)], "k string, t double")
    assert {r["t"]: r["v"] for r in timeline.resample_asof(series, targets, ["k"], "t", "v", "o").collect()} == {1.0: 10.0, 2.9: 10.0, 9.0: 30.0}


def test_stitch_puts_segments_after_each_other(spark):
    df = spark.createDataFrame([("k", 0, 5.0), ("k", 0, 6.0), ("k", 1, 100.0), ("k", 1, 101.0)], "k string, s long, t double")
    assert [r["slot"] for r in timeline.stitch(df, ["k"], "s", "t", 1.0).orderBy("s", "t").collect()] == [0, 1, 2, 3]


def test_trim_rejects_an_empty_range(spark):
    with pytest.raises(ValueError):
        timeline.trim(spark.range(1), ["id"], "id", 3.0, 3.0)


def test_maturity_counts_every_kind_of_marker(spark):
    pages = [
        (1, "http://a", "<body>nothing</body>", 0, "F", []),
        (2, "http://a", "<a href='https://LinkedIn.com/a'>", 10, "F", []),
        (3, "http://a", "<script src=gtag.js></script>", 10, "F", ["Google Analytics"]),
        (4, "http://a", "HubSpot forms", 10, "F", ["HubSpot"]),
        (5, "http://a", "klaviyo", 5, "F", ["Klaviyo"]),
        (6, "http://a", "<div id=__next>", 10, "F", ["Next.js"]),
        (7, "https://a", "blog schema.org x.com posthog drift marketo vue laws wordpress <body>" + "word " * 300 + "</body>", 90, "A+", ["WordPress", "PostHog", "Drift", "Marketo", "AWS", "Vue.js"]),
        (None, None, None, 25, "F", []),  # an unfetched page keeps the points for blog and schema: only that it is unfetched is known
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = intel.page_maturity(df).withColumn("stack", intel.tech_stack("html")).collect()
    key = lambda r: r[0] or 0
    assert sorted(((r["page_id"], r["score"], r["grade"], r["stack"]) for r in got), key=key) == sorted(((p[0], *p[3:]) for p in pages), key=key)


def test_nested_quantifiers_are_refused():
    refused = ["(a+)+", "(a*)*", "((a+))+", "((a*)b)*", "((a+)|b)+", "((a)+){2}", "/(x+)+/g", r"(\(a+)+"]
    allowed = [",", r"\d+", "(a|b)+", r"(\+)+", "a+b*", "(ab)?", "/[,;]/g", "(a)+(b)+"]
    assert all("nested" in (X.regex_guard(p) or "") for p in refused)
    assert all(X.regex_guard(p) is None for p in allowed)
    assert "too long" in X.regex_guard("a" * 101) and "Invalid" in X.regex_guard("(")


def test_levels_of_large_and_small_workflows_agree(spark, monkeypatch):
    edges = [(w, a, b) for w in (1, 2) for a, b in [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("gone", "e"), ("a", "missing"), ("a", "b")]]
    nodes = [(w, n) for w in (1, 2) for n in "abcdexyz"]
    n, e = spark.createDataFrame(nodes, "workflow_id long, node_id string"), spark.createDataFrame(edges, "workflow_id long, source string, target string")
    want = sorted((w, k, v) for w in (1, 2) for k, v in {"a": 0, "b": 1, "c": 2, "d": 3, "z": 0}.items())
    assert sorted(tuple(r) for r in graph.levels(n, e).collect()) == want
    monkeypatch.setattr(graph, "SMALL", 3)
    assert sorted(tuple(r) for r in graph.levels(n, e).collect()) == want
    assert graph.levels(n.where("false"), e.where("false")).count() == 0
    order = {r["node_id"]: r["place"] for r in graph.topo_order(n, e, n.where("workflow_id = 1 and node_id <> 'z'")).collect()}
    assert order["a"] < order["b"] < order["c"] < order["d"] and len(order) == 7


def brute_blocked(edges, closed):
    """Node by node in topological order, for one workflow without cycles."""
    after = {}
    for s, _, t, _ in edges:
        after.setdefault(s, []).append(t)
    maybe, todo = set(), [t for s, h, t, _ in edges if (s, h) in closed]
    while todo:
        n = todo.pop()
        if n not in maybe:
            maybe.add(n)
            todo += after.get(n, [])
    level = {}

    def depth(n):
        level[n] = level.get(n) or 1 + max((depth(s) for s, _, t, _ in edges if t == n and s in maybe), default=0)
        return level[n]

    done = set()
    for n in sorted(maybe, key=depth):
        into = [(s, h, th) for s, h, t, th in edges if t == n and th]
        dead = {th for s, h, th in into if (s, h) in closed or s in done}
        live = {th for s, h, th in into if not ((s, h) in closed or s in done)}
        if dead and not dead & live:
            done.add(n)
    return done


def test_blocked_nodes_against_brute_force(spark):
    draw, rows, off, want = random.Random(3), [], [], set()
    for w in range(30):
        edges = [(i, f"s{draw.randrange(2)}", j, draw.choice(["image", "text", None])) for j in range(1, 14) for i in draw.sample(range(j), min(j, 2))]
        closed = {(draw.randrange(6), f"s{draw.randrange(2)}") for _ in range(2)}
        rows += [(w, *e) for e in edges]
        off += [(w, *c) for c in closed]
        want |= {(w, n) for n in brute_blocked(edges, closed)}
    e = spark.createDataFrame(rows, "workflow_id long, source long, source_handle string, target long, target_handle string")
    got = flow.blocked_nodes(e, spark.createDataFrame(off, "workflow_id long, source long, source_handle string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    loop = spark.createDataFrame([(1, "s", "x", "n", "text"), (1, "n", "x", "m", "text"), (1, "m", "x", "n", "image"), (1, "q", "x", "m", "text")], "workflow_id long, source string, source_handle string, target string, target_handle string")
    got = flow.blocked_nodes(loop, spark.createDataFrame([(1, "s", "x")], "workflow_id long, source string, source_handle string"))
    assert {r["node_id"] for r in got.collect()} == {"n"}


def test_resolved_inputs(spark):
    n = spark.createDataFrame([
        (1, "p", "prompt", "hello", None, False, None), (1, "q", "prompt", "later", None, False, None), (1, "i", "imageInput", "img", None, False, None), (1, "e", "imageInput", "", None, False, None),
        (1, "r", "router", None, None, False, None), (1, "r2", "router", None, None, False, None), (1, "s", "switch", None, None, False, "image"), (1, "a", "array", "whole", ["x", "y"], False, None),
        (1, "b", "array", "whole", ["k", "l"], True, None), (1, "c", "conditionalSwitch", None, None, False, None), (1, "v", "generateVideo", "vid", None, False, None), (1, "t", "nanoBanana", None, None, False, None), (1, "u", "nanoBanana", None, None, False, None),
    ], "workflow_id long, node_id string, type string, value string, items array<string>, batch boolean, input_type string")
    e = [
        ("p", None, "r", "text", None), ("i", None, "r", "image", None), ("r", "text", "t", "text", None), ("r", "image", "r2", "image", None), ("r2", "image", "t", "image", None), ("r2", "image", "r", "image", None),
        ("i", None, "s", "image", None), ("s", "on", "t", "image", None), ("s", "off", "u", "image", None), ("a", "text-1", "u", "text", None), ("a", None, "u", "text", 4), ("b", None, "u", "text", None),
        ("c", "m", "t", "text", None), ("v", None, "t", "video", None), ("e", None, "t", "image", None), ("q", None, "t", "prompt_2", None), ("p", None, "t", None, None), ("i", None, "u", "image-1", None),
    ]
    edges = spark.createDataFrame([(1, i, *x) for i, x in enumerate(e)], "workflow_id long, ord long, source string, source_handle string, target string, target_handle string, item_index int")
    closed = spark.createDataFrame([(1, "s", "off")], "workflow_id long, source string, source_handle string")
    schema = spark.createDataFrame([(1, "u", 0, "first", "image"), (1, "u", 1, "mask", "image"), (1, "u", 2, "says", "text")], "workflow_id long, node_id string, pos int, name string, kind string")
    got = {r["node_id"]: r for r in flow.resolve_inputs(n, edges, closed, schema=schema).collect()}
    # the first edge has opened r, so that r2 behind it finds nothing: one image comes, through the switch
    assert (got["t"]["images"], got["t"]["videos"], got["t"]["text"]) == (["img"], ["vid"], "hello")
    assert (got["u"]["images"], got["u"]["text"], got["u"]["text_items"]) == (["img"], "x", ["k", "l"])
    assert got["u"]["dynamic"] == {"mask": ["img"], "says": ["y", "x"]}
    stop = spark.createDataFrame([(1, "i")], "workflow_id long, node_id string")
    assert {r["node_id"]: r["images"] for r in flow.resolve_inputs(n, edges, closed, stop).collect()}["t"] == []


def test_names_from_a_table_are_found_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "Müller AG und c++ (x)"), (2, "Mülleranlage"), (3, "a.b  c"), (4, None)], "doc_id long, text string")
    names = spark.createDataFrame([("müller",), ("C++",), ("a.b c",), ("",), (None,), ("AG und",)], "name string")
    assert {tuple(r) for r in dictionary.mentions_of(docs, "doc_id", "text", names).collect()} == {(1, "müller"), (1, "C++"), (1, "AG und"), (3, "a.b c")}
