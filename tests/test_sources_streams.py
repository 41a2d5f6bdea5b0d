"""Document sources and streams on small files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.functions import easing
from loomspark.operators import graph, visibility
from loomspark.sources import documents as D
from loomspark.streaming import jobs as J

T0 = datetime(2024, 1, 1)
ROWS = "id long, k string, ts timestamp, amount double, status string"


def streamed(spark, tmp_path, batches):
    """A stream that gives each list of rows as one batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))


def rows(*marks):
    return [(i, k, T0 + timedelta(hours=h), float(a), s) for i, k, h, a, s in marks]


def test_workflow_documents(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    doc = {"version": 1, "name": "One", "nodes": [{"id": "n1", "type": "prompt", "position": {"x": 1, "y": 2}, "data": {"prompt": "p"}}], "edges": []}
    (tmp_path / "a/w.json").write_text(json.dumps(doc).replace('"p"', '"p\nq"'))
    (tmp_path / "a/.git/w.json").write_text(json.dumps(doc))
    (tmp_path / "a/x.json").write_text("{}")
    nodes, edges = D.read_workflows(spark, str(tmp_path / "a/w.json"))
    assert [(r.node_id, r.type, r.x) for r in nodes.collect()] == [("n1", "prompt", 1.0)] and edges.isEmpty()
    assert [r["name"] for r in D.list_documents(spark, str(tmp_path)).collect()] == ["One"]
    good, bad = '{"version": 1, "nodes": [], "edges": [1]}', '{"version": "1", "nodes": [], "edges": []}'
    files = spark.createDataFrame([("a", good, 1), ("a", bad, 2), ("a", "{", 3), ("b", None, 1)], "directory string, text string, modified int")
    assert [(r.directory, r.modified) for r in D.newest_valid(files).collect()] == [("a", 1)]


def test_stored_forms(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    files = spark.createDataFrame([("a", "mp4"), ("a", "jpg"), ("b", "txt")], "id string, ext string")
    got = {r.id: (r.ext, r.content_type, r.not_found) for r in D.resolve_media(ids, files).collect()}
    assert got == {"a": ("jpg", "image/jpeg", False), "b": (None, None, True)}
    scores = spark.createDataFrame([(1, '{"m": 2.5}'), (2, "{bad"), (3, None)], "brand_id int, by string")
    assert {r.brand_id: r.by for r in D.decode_scores(scores, ["by"]).collect()} == {1: {"m": 2.5}, 2: {}, 3: {}}
    cut = D.split_raw_preview(spark.createDataFrame([("abcdef",), ("abc",), (None,)], "text string"), limit=3)[1]
    assert [r.text for r in cut.collect()] == ["abc" + D.CUT, "abc", None]


def test_running_cost_over_batches(spark, tmp_path):
    s = streamed(spark, tmp_path, [rows((1, "a", 0, 5, ""), (2, "b", 0, 1, "")), rows((3, "a", 1, 9, "reset"), (4, "a", 2, 2, "")), rows((5, "b", 3, 4, ""), (6, "a", 3, 1, ""))])
    got = J.stream_running_cost(s.withColumn("reset", F.col("status") == "reset"), "k", ["ts", "id"], "amount", "reset")
    assert {r.k: r.total for r in got.collect()} == {"a": 3.0, "b": 5.0}


def again(spark, tmp_path, batch, new):
    """More rows, as the stream's next batch."""
    spark.createDataFrame(new, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={batch}"))


def test_running_cost_goes_on(spark, tmp_path):
    s = streamed(spark, tmp_path, [rows((1, "a", 0, 5, ""), (2, "b", 0, 1, "")), rows((3, "a", 1, 7, ""), (4, "c", 2, None or 0, ""))]).withColumn("reset", F.col("status") == "reset")
    run = lambda: {r.k: r.total for r in J.stream_running_cost(s, "k", ["ts", "id"], "amount", "reset", folder=str(tmp_path / "kept")).collect()}
    assert run() == {"a": 12.0, "b": 1.0, "c": 0.0}
    assert run() == {"a": 12.0, "b": 1.0, "c": 0.0}  # nothing new has come
    again(spark, tmp_path, 9, rows((5, "b", 9, 3, ""), (6, "a", 9, 1, "reset"), (7, "a", 10, 2, "")))
    assert run() == {"a": 2.0, "b": 4.0, "c": 0.0}


def test_status_recents_and_dedup_over_batches(spark, tmp_path):
    s = streamed(spark, tmp_path, [rows((1, "a", 0, 1, "running"), (2, "b", 0, 1, "running")), rows((3, "a", 1, 1, "failed"), (4, "b", 1, 1, "queued")), rows((5, "a", 2, 1, "running"))])
    status = lambda folder=None: {r.k: r.status for r in J.drain(J.latest_status(s, "k", "status", "ts"), "t", "update", ["k"], folder=folder).collect()}
    recent = lambda n, folder=None: {(r.k, r.place): (r.status, r.ts.hour) for r in J.drain(J.stream_recents(s, ["k"], "status", "ts", n), "t", "update", ["k", "place"], folder=folder).collect()}
    assert status(str(tmp_path / "s")) == {"a": "failed", "b": "queued"}
    assert recent(8, str(tmp_path / "r")) == {("a", 1): ("running", 2), ("a", 2): ("failed", 1), ("b", 1): ("queued", 1), ("b", 2): ("running", 0)}
    assert recent(1) == {("a", 1): ("running", 2), ("b", 1): ("queued", 1)}
    assert J.drain(J.stream_dedup(s, F.col("status"), "ts", "10 days"), "t").count() == 3
    again(spark, tmp_path, 9, rows((6, "a", 3, 1, "failed"), (7, "b", 4, 1, "succeeded"), (8, "c", 4, 1, "expired")))
    assert status(str(tmp_path / "s")) == {"a": "failed", "b": "succeeded", "c": "expired"}
    assert recent(8, str(tmp_path / "r"))["a", 1] == ("failed", 3) and recent(8, str(tmp_path / "r"))["a", 2] == ("running", 2)
    batch = J.latest_status(spark.read.schema(ROWS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "k", "status", "ts")
    assert {r.k: r.status for r in batch.collect()} == status(str(tmp_path / "s"))


def test_values_expire_by_the_streams_clock(spark, tmp_path):
    s = streamed(spark, tmp_path, [rows((1, "a", 0, 1, "x"), (2, "b", 0, 1, "y")), rows((3, "a", 5, 1, "z")), rows((4, "c", 9, 1, "w")), rows((5, "d", 12, 1, "v"))])
    run = lambda: {r.k: (r.status, r.expired) for r in J.drain(J.stream_fresh_values(s, ["k"], "status", "ts", "5 hours", "1 hour"), "t", "update", ["k"], folder=str(tmp_path / "f")).collect()}
    assert run() == {"a": (None, True), "b": (None, True), "c": ("w", False), "d": ("v", False)}
    again(spark, tmp_path, 9, rows((6, "b", 13, 1, "back")))
    assert run() == {"a": (None, True), "b": ("back", False), "c": ("w", False), "d": ("v", False)}


def test_routes_replace_a_batch_that_runs_again(spark, tmp_path):
    s = streamed(spark, tmp_path, [rows((1, "a", 0, 1, "x"), (2, "b", 0, 7, None)), rows((3, "a", 1, 9, "x"), (4, "a", 1, 0, "q"))])
    run = lambda: sorted((r.id, r.output) for r in J.route_to(s, {"x": F.col("status") == "x", "big": F.col("amount") > 5}, str(tmp_path / "f")).collect())
    want = [(1, "x"), (2, "big"), (3, "big"), (3, "x"), (4, "default")]
    assert run() == want == run()
    last = max((tmp_path / "f/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))  # as if the last batch was lost before it was marked as done
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == want


def test_route(spark, tmp_path):
    s, out = streamed(spark, tmp_path, [rows((1, "a", 0, 1, "x"), (2, "b", 0, 7, None)), rows((3, "a", 1, 9, "y"))]), {}
    J.stream_route(s, {"x": F.col("status") == "x", "big": F.col("amount") > 5}, lambda name, df, i: out.setdefault(name, []).extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert out == {"x": [1], "big": [2, 3], "default": []}


@pytest.mark.parametrize(("name", "at", "want"), [("easeInQuad", 0.5, 0.25), ("easeOutExpo", 1.0, 1.0), ("easeInOutExpo", 0.0, 0.0), ("easeInOutCirc", 0.5, 0.5), ("easeOutCubic", 0.5, 0.875), ("other", 0.3, 0.3)])
def test_ease(spark, name, at, want):
    assert spark.range(1).select(easing.ease(F.lit(at), name).alias("v")).first()["v"] == pytest.approx(want)


def test_placement_and_tidy_rows(spark):
    items = spark.createDataFrame([("g", i, 10.0) for i in range(5)], "k string, i int, s double")
    assert [r.offset for r in graph.stack(items, ["k"], ["i"], "s").orderBy("i").collect()] == [0, 30, 60, 90, 120]
    assert [(r.row, r.column) for r in graph.grid(items, ["k"], ["i"]).orderBy("i").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    scores = spark.createDataFrame([(1, {"a": 120.0}, None), (2, {}, {"b": 3.0})], "id int, x map<string,double>, y map<string,double>")
    got = sorted(tuple(r) for r in visibility.score_to_tidy(scores, ["id"], ["x", "y"]).collect())
    assert got == [(1, "x", "a", 120.0, 100.0, 1), (2, "y", "b", 3.0, 3.0, 1)]
    swapped = visibility.score_to_tidy(spark.createDataFrame([(1, {"a": 2.0, "b": 1.0})], "id int, x map<string,double>"), ["id"], ["x"], {"a": "b", "b": "c"})
    assert {(r["label"], r["value"]) for r in swapped.collect()} == {("b", 2.0), ("c", 1.0)}
