"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomspark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT") or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, str) else round(float(v), 6)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_best_layouts_against_brute_force(spark, sf_dir):
    """Without SQL: equal scores may be ranked by their last bits."""
    sizes = {r["p_partkey"]: (400.0 + 37 * r["p_size"], 300.0 + r["p_partkey"] % 500) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    got = queries.queries()["best_layouts"](spark, sf_dir).collect()
    assert len(got) == 8 * len(sizes)
    for r in got:
        w, h = sizes[r["p_partkey"]]
        scores = []
        for a in range(1, 7):
            for b in range(1, 7):
                if a * b > 1:
                    cell, shape, grid = (w / b) / (h / a), w / h, b / a
                    off = min(max(cell / x, x / cell) - 1 for x in (16 / 9, 4 / 3, 1.5, 1.85, 2.39, 1, 9 / 16, 0.75, 2 / 3))
                    scores.append(0.45 * math.exp(-3 * off) + 0.25 * math.exp(-2 * (max(shape / grid, grid / shape) - 1)) + 0.15 * min(a * b / 6, 1) + 0.15 * (1 - abs(a - b) / max(a, b)))
        assert abs(sorted(scores, reverse=True)[r["place"] - 1] - r["score"]) < 2e-6


def test_queries_without_sql_are_known():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"graph_blocked", "best_layouts"}  # each has a brute-force test


def test_every_turn_is_split(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["joined"].split("\x1f") if r["items"] else [] for r in queries.queries()["split_all_turns"](spark, sf_dir).collect()}
    want = {(r["conv_id"], r["turn"]): [x.strip() for x in r["text"].split(", ") if x.strip()] for r in c.collect()}
    assert got == want and any("\n" in x for items in got.values() for x in items) and any(len(x) > 2 for x in got.values())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(queries.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
