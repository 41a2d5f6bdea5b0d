"""File heads, judged sentiment, and long series in parts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import cost, dedup, timeline, visibility
from loomspark.sources import buckets, documents, heads


def test_heads_read_little(spark, tmp_path):
    """A document of 50 MB costs its first kilobyte; folders are skipped by name and depth."""
    big = '{"version": 1, "name": "Big", "nodes": [' + " " * 50_000_000 + "]}"
    for place, text in {"a/w.json": big, "a/b/w.json": big[:200], "a/b/c/d/w.json": big[:200], "node_modules/w.json": big[:200], ".git/w.json": big[:200], "e/w.txt": big[:200], "f/w.json": '{"other": 1}', "w.json": '{"version": 2, "nodes": []}', "w2.json": '{"version": 2, "nodes": []}'}.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(text)
    reader = heads.HeadReader({"path": str(tmp_path), "suffix": ".json", "skipped": "node_modules"})
    read = lambda: int(Path("/proc/self/io").read_text().split("rchar: ")[1].split()[0])
    before = read()
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert read() - before < 100_000 and max(r[2] for r in rows) > 50_000_000
    assert sorted(str(Path(r[0]).relative_to(tmp_path)) for r in rows) == ["a/b/w.json", "a/w.json", "f/w.json", "w.json", "w2.json"]
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = [tuple(r) for r in documents.list_documents(spark, root).select("name", "directory").collect()]
        assert sorted(n for n, _ in got) == sorted(["Big", "Big", tmp_path.name]) and all(d.endswith(str(tmp_path / n)) for (_, d), n in zip(sorted(got, key=lambda r: r[1]), ["", "a", "a/b"], strict=True))
    assert documents.list_documents(spark, str(tmp_path / "e")).collect() == []


def test_judged_sentiment(spark):
    """Batches that fail or come short are asked again one by one."""
    said = {"good": '{"sentiment": "Positive", "rationale": "r"}', "bad": '```json\n{"sentiment": "negative"}\n```', "odd": '{"sentiment": "glad"}', "list": "[1]", "prose": "fine"}

    def judge(texts):
        if "boom" in texts:
            raise ValueError
        return [said.get(t) for t in texts][: 1 if "short" in texts and len(texts) > 1 else None]

    rows = [(i, t) for i, t in enumerate(["good", "boom", "bad", None, "odd", "list", "prose", "short", "nothing"])]
    got = {r["t"]: (r["sentiment"], r["rationale"]) for r in visibility.judge_sentiment(spark.createDataFrame(rows, "i int, t string"), "t", judge, size=3).collect()}
    none = ("neutral", "no judge response")
    assert got == {"good": ("positive", "r"), "bad": ("negative", None), "odd": ("neutral", None), "list": ("neutral", "parse error"), "prose": ("neutral", "parse error"), "boom": none, "short": none, "nothing": none, None: (None, None)}
    stats = visibility.sentiment_stats(visibility.judge_sentiment(spark.createDataFrame(rows, "i int, t string"), "t", judge), "sentiment", [])
    assert stats.first()["positive"] == 1 and stats.first()["neutral"] == 6 and stats.first()["negative"] == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_long_series_equal_short_ones(spark, parts):
    draw = random.Random(4)
    rows = [(k, float(draw.randrange(60)), i, float(draw.randrange(-9, 9)) if draw.random() < 0.9 else None, draw.random() < 0.05) for k in ("a", "b", None) for i in range(300)]
    rows += [("c", 1.0, 0, 2.0, True)]
    df = spark.createDataFrame(rows, "k string, t double, i int, v double, reset boolean")
    targets = spark.createDataFrame([(k, x / 2) for k in ("a", "b", "c", None) for x in range(-4, 130)], "k string, t double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # these rows would make one part
    try:
        both = lambda f: [sorted(map(tuple, f(x).collect()), key=repr) for x in (False, True)]
        keyed = F.coalesce("k", F.lit("none"))
        for a, b in (
            both(lambda x: timeline.resample_asof(df, targets, ["k"], "t", "v", "i", long=x)),
            both(lambda x: timeline.peaks(df.withColumn("k", keyed), ["k"], ["t", "i"], "v", 16, long=x)),
            both(lambda x: cost.running_cost(df, "k", ["t", "i"], "v", "reset", long=x).select("k", "i", F.coalesce("incurred", F.lit(0.0)))),
            both(lambda x: cost.running_cost(df, "k", ["t", "i"], "v", long=x).select("k", "i", F.coalesce("incurred", F.lit(0.0)))),
        ):
            assert a == b and len(a) > 40
        one = timeline.in_parts(df.withColumn("k", F.lit("one")), ["k"], ["t", "i"])
        assert one.select(timeline.PART).distinct().count() == parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_changes_leave_other_buckets_alone(spark, tmp_path):
    """Equal to a full rewrite; files of untouched buckets stay the same files, and emptied buckets stay empty."""
    rows = spark.createDataFrame([(i, f"v{i}", None, 0) for i in range(400)], "k long, x string, updated_at string, v int")
    path, keys = str(tmp_path / "t"), ["k"]
    files = lambda: {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    buckets.write_table(rows, path, keys, 16)
    before, full = files(), rows
    some = spark.createDataFrame([(3, "new", None, 1), (900, "added", None, 1)], "k long, x string, updated_at string, v int")
    buckets.upsert_rows(spark, path, some, keys, "v", 16)
    assert len(before & files()) >= 14
    full = dedup.upsert(full, some, keys, "v").select(*rows.columns)
    fix = spark.createDataFrame([(5, "fixed"), (6, None)], "k long, x string")
    buckets.patch_rows(spark, path, fix, "k", ["x"], F.lit("now"), 16)
    full = dedup.patch(full.drop("updated_at"), fix, "k", ["x"], F.lit("now")).select(*rows.columns)
    seen = lambda df: sorted(map(tuple, df.collect()))
    key = lambda r: (r[0], r[1], r[2] or "", r[3])
    assert sorted(map(key, buckets.read_table(spark, path).collect())) == sorted(map(key, full.collect()))
    gone = rows.where(F.pmod(F.xxhash64("k"), F.lit(16)) == 2).select("k")
    buckets.delete_rows(spark, path, gone, keys, 16)
    left = buckets.read_table(spark, path)
    assert seen(left.select("k")) == seen(full.select("k").join(gone, "k", "left_anti")) and seen(left.join(gone, "k", "left_semi")) == []
    kept = files()
    buckets.delete_rows(spark, path, gone.where("false"), keys, 16)
    assert files() == kept
    buckets.upsert_rows(spark, path, rows.join(gone, "k"), keys, "v", 16)
    assert seen(buckets.read_table(spark, path).select("k")) == seen(full.select("k"))


def test_equally_late_blobs(spark):
    """Of rows of one key and one time the largest blob stays, whatever their order; rows without a time come first."""
    rows = [(1, 1, b, t) for b, t in ((5, 2), (9, 2), (7, 2), (99, 1), (100, None))] + [(2, 1, 3, None), (2, 1, 4, None), (2, None, 5, 1)]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "p int, k int, blob int, t int").coalesce(1)
        got = {r["p"]: r["images"] for r in documents.images_for_board(df, "p", "k", "blob", "t").collect()}
        assert got == {1: {1: 9}, 2: {1: 4}}


def test_stored_documents_stay_small(spark, tmp_path):
    """A brand's parts of far keys are other documents."""
    from loomspark.plans import stored

    parts = spark.range(0, 1_000_000, 1_000).select(F.col("id").alias("p_partkey"), F.lit("B").alias("p_brand"), F.concat(F.lit("t"), F.col("id") % 7).alias("p_name"), (F.col("id") / 1000 % 50).cast("int").alias("p_size"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    seen, read = [], documents.read_workflows
    try:
        documents.read_workflows = lambda s, path: seen.append(path) or read(s, path)
        got = stored.stored_workflows(spark, str(tmp_path)).collect()
    finally:
        documents.read_workflows = read
    assert sum(r["nodes"] for r in got) == 1_000 and sum(r["sources"] for r in got) == 480
    assert read(spark, seen[0])[0].groupBy("workflow_id").count().agg(F.max("count")).first()[0] == 100
