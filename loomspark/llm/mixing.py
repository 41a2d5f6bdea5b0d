"""Mixing sources to target weights by pivotal dependent rounding (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Weights of the sources by code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all words that the mix takes, and the most copies of a document.
SHARE, MOST = 1.5, 2.0
#: Documents of one pivotal pass, and groups whose leftovers meet in one step of the tree.
GROUP, FAN_IN = 4_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target words of each source: shares by weight, held at ``most`` times the source, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, rest, open_, out = dict(order), share * sum(n for _, n in order), {s for s, _ in order}, {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / total > most * size[s]}
        if not full:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        rest -= sum(most * size[s] for s in full)
        open_ -= full
    return out


def pivot(size: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """Copies of which all but one at most are integral, with the sum of size * copies as before.

    Two fractional entries meet; words move from one to the other until either is integral, in the
    direction drawn with the chances that keep each entry's expectation.
    """
    out = copies.astype(float).copy()
    draw = np.random.default_rng(seed)
    floor = np.floor(out + 1e-9)
    open_ = [i for i in range(len(out)) if size[i] > 0 and 1e-9 < out[i] - floor[i] < 1 - 1e-9]
    settled = np.ones(len(out), bool)
    settled[open_] = False
    out[settled] = np.round(out[settled])
    chances = draw.random(len(open_))
    left = None
    for step, i in enumerate(open_):
        if left is None:
            left = i
            continue
        j, si, sj = left, float(size[i]), float(size[left])
        up = min((floor[i] + 1 - out[i]) * si, (out[j] - floor[j]) * sj)  # words that can move from j to i
        down = min((out[i] - floor[i]) * si, (floor[j] + 1 - out[j]) * sj)
        move = up if chances[step] * (up + down) < down else -down
        out[i] += move / si
        out[j] -= move / sj
        free = []
        for x in (j, i):
            if abs(out[x] - round(out[x])) < 1e-9:
                out[x] = round(out[x])
            else:
                free.append(x)
        left = free[0] if free else None
    return out


def _round(level: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        source, group = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("hash", "ascending"), ("number", "ascending")])
        seed = zlib.crc32(f"{source}|{group}|{level}".encode())
        copies = pivot(np.asarray(table["size"]), np.asarray(table["copies"]), seed)
        return table.set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies))

    return run


def text_hash(text: Column) -> Column:
    """What tells the texts of one id apart in ``mix``."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, hash, number, copies, taken: how often the mix takes each document.

    A source's fractional copies, its target over its size, are rounded in groups of bounded size,
    each of which leaves at most one fraction; these meet in a reduction tree, level by level, until
    each source has one left, which is drawn. A source's taken words thus miss its target by less
    than one document. Seeds depend on source and group alone, so reruns agree.

    The driver holds one row for each source. Null sources are a source of their own, the last;
    documents without words are never taken; other columns are ignored; an empty table gives no rows. Repeated rows (same id,
    source and text) are documents of their own: they are counted first and then numbered, so that
    they and rows without an id spread over the groups by id, hash of the text and number.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_hash(text).alias("hash"))
    rows = durable(rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n")), "sizes")
    per = [(r["source"], r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()]
    target = capped_targets([(s, n) for s, n, _ in per], weights, share, most)
    spark = docs.sparkSession
    facts = spark.createDataFrame([(s, n, float(target[s]), float(min(most, target[s] / n)) if n else 0.0, -(-c // GROUP)) for s, n, c in per] or [("", 0, 0.0, 0.0, 1)], "source string, source_size long, target double, copies double, groups long")
    rows = rows.withColumnRenamed("source", "own").join(facts, F.col("own").eqNullSafe(F.col("source")))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    group = F.pmod(F.xxhash64("doc_id", "hash", "number", F.lit(11)), F.greatest(F.col("groups"), F.lit(1)))
    rows = rows.select("doc_id", "source", "size", "hash", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0.0).alias("copies"), group.alias("group"), "number")
    schema, level, done = rows.schema, 0, None
    depth = max([-(-c // GROUP) for *_, c in per], default=1)
    while True:
        rows = durable(rows.groupBy("source", "group").applyInArrow(_round(level), schema), "mix")
        open_ = F.abs(F.col("copies") - F.round("copies")) > 1e-9
        settled = rows.where(~open_)
        done = settled if done is None else done.union(settled)
        rows = rows.where(open_)
        if depth <= 1:
            break
        depth, level = -(-depth // FAN_IN), level + 1
        rows = rows.withColumn("group", F.floor(F.col("group") / FAN_IN))
    chance = F.pmod(F.xxhash64("doc_id", "source", "hash", "number", F.lit(13)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    last = rows.withColumn("copies", F.floor("copies") + F.when(chance < F.col("copies") - F.floor("copies"), 1).otherwise(0).cast("double"))
    return done.union(last).select("doc_id", "size", "source", "source_size", "target", "hash", "number", F.col("copies").cast("int").alias("copies"), (F.col("copies").cast("long") * F.col("size")).alias("taken"))
