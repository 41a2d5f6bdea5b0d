"""Largest inner products by a forest of random-projection trees (operator 7)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import durable

#: Vectors on which the trees' planes are fitted, at most; every vector is indexed.
SAMPLE = 20_000
TREES, LEAF = 16, 256
#: Share of the true neighbours of TRIALS sampled vectors, found by brute force, that sets how many leaves a query visits.
RECALL, TRIALS = 0.96, 128
#: Leaves that one task ranks together, and the most vectors and queries of theirs in one group; more are dealt out in parts.
CELL, PART, ASKED = 32, 16_384, 4_096
#: Queries whose leaves one task looks up.
PROBES = 256


class Forest:
    """Trees of planes over lifted vectors: (x, sqrt(M * M - |x| ** 2)), by which large inner products become small angles."""

    def __init__(self, sample: np.ndarray, most: float, depth: int, trees: int = TREES, seed: int = 3) -> None:
        self.most, self.depth = most, depth
        draw, lifted = np.random.default_rng(seed), self.lift(sample)
        self.planes = draw.normal(size=(trees, 2**depth - 1, lifted.shape[1]))
        self.cuts = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            node = np.zeros(len(lifted), np.int64)
            for level in range(depth):
                for i in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = lifted[node == i]
                    if len(own) > 1:
                        a, b = own[draw.integers(len(own))], own[draw.integers(len(own))]
                        if (a != b).any():
                            self.planes[t, i] = a - b
                    self.planes[t, i] /= np.linalg.norm(self.planes[t, i])
                    self.cuts[t, i] = np.median(own @ self.planes[t, i]) if len(own) else 0.0
                node = 2 * node + 1 + ((lifted * self.planes[t, node]).sum(axis=1) > self.cuts[t, node])

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most**2 - (x**2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree [vectors, trees], numbered over all trees."""
        lifted, trees = self.lift(x), len(self.planes)
        out = np.zeros((len(x), trees), np.int64)
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((lifted * self.planes[t, node]).sum(axis=1) > self.cuts[t, node])
            out[:, t] = node - (2**self.depth - 1) + t * 2**self.depth
        return out

    def probe(self, q: np.ndarray, n: int) -> list[int]:
        """The n most promising leaves of all trees: one queue, ordered by the worst plane crossed on the way."""
        norm = np.linalg.norm(q)
        lifted = np.append(q / norm * self.most if norm else q, 0.0)
        margins = self.planes @ lifted - self.cuts
        inner, out = 2**self.depth - 1, []
        heap = [(0.0, t, 0) for t in range(len(self.planes))]
        while heap and len(out) < n:
            worst, t, node = heapq.heappop(heap)
            while node < inner:
                m = margins[t, node]
                heapq.heappush(heap, (max(worst, abs(m)), t, 2 * node + 1 + (m <= 0)))
                node = 2 * node + 1 + (m > 0)
            out.append(node - inner + t * (inner + 1))
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles; shorter lists end in zeros."""
    lens = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), width))
    out[np.arange(width) < lens[:, None]] = np.asarray(column.flatten())
    return out


def top(score: np.ndarray, first: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k largest scores, ties to the smaller ``first``, in that order."""
    order = np.lexsort((first, -score, owner))
    own = owner[order]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return order[place < k]


def products(q: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of the rows q[row] and x[at], summed from the first component to the last."""
    out = np.zeros(len(row))
    for d in range(q.shape[1]):
        out += q[row, d] * x[at, d]
    return out


def above(q: np.ndarray, bound: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best among x that reach its bound; at most a million pairs are looked at together."""
    parts, step = [], max(1, 1_000_000 // max(1, len(x)))
    for a in range(0, len(q), step):
        near = q[a : a + step] @ x.T
        least = bound[a : a + step]
        if len(x) > k:  # about the k-th largest score
            least = np.maximum(least, np.partition(near, len(x) - k, axis=1)[:, len(x) - k])
        row, at = np.nonzero(near >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None])
        score = products(q, x, a + row, at)
        keep = top(score, first[at], row, k)
        keep = keep[score[keep] >= bound[a + row[keep]] - 1e-9 * (1 + np.abs(score[keep]))]
        parts.append((a + row[keep], at[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _index(forest: Forest, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = forest.leaves(matrix(batch.column(1), width))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), leaf.shape[1]))
                flat = leaf.ravel()
                yield pa.RecordBatch.from_arrays([pa.array((flat // CELL).astype(np.int32)), pa.array(flat.astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["cell", "leaf", "first", "vector"])

    return run


def _probe(forest: Forest, probes: int, sample: np.ndarray, k: int, width: int):
    """Queries to the cells with leaves that they visit, and a score that k vectors of these leaves reach: the k-th best of the sample's among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = forest.leaves(sample), len(forest.planes) * 2**forest.depth
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows, cells, leaves, bound = [], [], [], []
                for i, x in enumerate(matrix(part.column(1), width)):
                    visited = np.sort(np.array(forest.probe(x, min(probes, total)), np.int32))
                    seen = np.zeros(total, bool)
                    seen[visited] = True
                    near = sample[seen[own].any(axis=1)] @ x
                    bound.append(np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else -np.inf)
                    cut = np.flatnonzero(np.concatenate([[True], visited[1:] // CELL != visited[:-1] // CELL]))
                    rows.append(np.full(len(cut), i))
                    cells.append(visited[cut] // CELL)
                    leaves += np.split(visited, cut[1:])
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(leaves, pa.list_(pa.int32())), pa.array(np.array(bound)[rows])], ["cell", "query", "vector", "leaves", "bound"])

    return run


def _rank(k: int, width: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if points.num_rows and queries.num_rows:
            first, leaf = np.asarray(points["first"]), np.asarray(points["leaf"])
            x, q = matrix(points["vector"].combine_chunks(), width), matrix(queries["vector"].combine_chunks(), width)
            asks, bound = queries["leaves"].combine_chunks(), np.asarray(queries["bound"])
            row, wanted = np.repeat(np.arange(len(q)), np.asarray(asks.value_lengths())), np.asarray(asks.flatten())
            for one in np.unique(leaf):
                mine, own = row[wanted == one], np.flatnonzero(leaf == one)
                i, j, score = above(q[mine], bound[mine], x[own], first[own], k)
                found.append((mine[i], own[j], score))
        row, at, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if len(row):  # a vector may stand in leaves of several trees
            named = np.asarray(points["first"])[at]
            order = np.lexsort((named, row))
            order = order[np.concatenate([[True], (named[order][1:] != named[order][:-1]) | (row[order][1:] != row[order][:-1])])]
            row, at, score = row[order], at[order], score[order]
        keep = top(score, np.asarray(points["first"])[at], row, k)
        return pa.table({"query": queries["query"].take(pa.array(row[keep])), "first": points["first"].take(pa.array(at[keep])), "score": pa.array(score[keep])}, pa.schema([("query", pa.int64()), ("first", pa.int64()), ("score", pa.float64())]))

    return run


def _nearest(forest: Forest, trials: np.ndarray, k: int, width: int):
    """Vectors to each task's k best for every trial query, with the leaves that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = matrix(batch.column(1), width), np.asarray(batch.column(0))
            row, at, score = above(trials, np.full(len(trials), -np.inf) if best is None else best[4], x, first, k)
            new = (row, first[at], score, forest.leaves(x[at]))
            if best is not None:
                new = tuple(np.concatenate(c) for c in zip(best[:4], new, strict=True))
            keep = top(new[2], new[1], new[0], k)
            new = tuple(c[keep] for c in new)
            bound, full = np.full(len(trials), -np.inf), np.flatnonzero(np.bincount(new[0], minlength=len(trials)) >= k)
            bound[full] = new[2][np.searchsorted(new[0], full, side="right") - 1]
            best = (*new, bound)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array(list(best[3]), pa.list_(pa.int64()))], ["trial", "first", "score", "leaves"])

    return run


def visits_for(forest: Forest, points: DataFrame, trials: np.ndarray, k: int, recall: float, width: int) -> int:
    """Leaves to visit so that the trial queries find a share ``recall`` of their true neighbours, one for each tree at least; all for a recall of 1.

    Their neighbours are found by brute force: one pass over all vectors, of which each task sends
    k for every trial.
    """
    whole = len(forest.planes) * 2**forest.depth
    if recall >= 1:
        return whole
    near = points.mapInArrow(_nearest(forest, trials, k, width), "trial long, first long, score double, leaves array<bigint>")
    by = Window.partitionBy("trial").orderBy(F.desc("score"), "first")
    turns = []
    rows = near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("trial", "leaves").toArrow().to_pydict()
    wanted: dict[int, list[list[int]]] = {}
    for t, leaves in zip(rows["trial"], rows["leaves"], strict=True):
        wanted.setdefault(t, []).append(leaves)
    for t, lists in wanted.items():
        turn = np.empty(whole, np.int64)
        turn[forest.probe(trials[t], whole)] = np.arange(whole)
        turns += [int(turn[leaves].min()) for leaves in lists]
    return max(len(forest.planes), 1 + int(np.sort(turns)[min(len(turns) - 1, int(np.ceil(recall * len(turns))))]))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row whose id is divisible by ``every``.

    1. Planes are fitted on at most SAMPLE vectors; every vector is put in one leaf of every tree.
    2. How many leaves a query visits is what TRIALS sampled vectors need to find a share ``recall`` of
       their true neighbours, so it follows the data and its size.
    3. Each query takes its leaves through one priority queue over all trees. The (k + 1)-th best of the
       sample's vectors in these leaves bounds what each of them needs to send. All vectors of the
       visited leaves are ranked, in groups of bounded size, by sums in double precision over the stored
       vectors, in order. Where the leaves hold fewer than k vectors, fewer are found.

    Equal vectors are indexed and searched once, with their k + 1 smallest ids, which is all that a
    result of k can hold. Vectors that are null, empty, zero, or hold null or non-finite values take no
    part, nor do null ids; of rows with one id, the smallest vector counts. A shorter vector has zeros
    behind its end. Fewer than k other vectors give as many rows; an empty table none. Ties go to the
    smaller id. Other columns are ignored.
    """
    v = F.col("vector")
    kind = "float" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = durable(rows.where(F.col("id").isNotNull() & v.isNotNull() & fine).groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    by = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
    kept = durable(kept.withColumn("first", F.min("id").over(Window.partitionBy("vector"))), "distinct")
    points = kept.where("place = 1").select("first", "vector")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = points.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("vector")).alias("width")).first()
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = facts["width"]
    sample = points.orderBy(F.xxhash64("vector", F.lit(1)), "first").limit(SAMPLE).select("vector").toArrow()
    sample = matrix(sample["vector"].combine_chunks(), width)
    depth = int(np.ceil(np.log2(max(1, min(facts["n"] / leaf, len(sample) / 8)))))
    forest = Forest(sample, float(facts["most"]), depth, trees)
    probes = visits_for(forest, points, sample[:TRIALS], k + 1, recall, width)

    index = points.mapInArrow(_index(forest, width), f"cell int, leaf int, first long, vector array<{kind}>")
    queries = durable(rows.where(F.pmod("id", F.lit(every)) == 0).join(points, "vector").select(F.col("id").alias("query_id"), F.col("first").alias("query")), "queries")
    asked = points.join(queries.select(F.col("query").alias("first")).distinct(), "first", "left_semi").select(F.col("first").alias("query"), "vector")
    tasks = 1 + queries.count() // PROBES  # few bytes a query, but long work: dealt by their number
    visits = asked.repartition(tasks, "query").mapInArrow(_probe(forest, probes, sample, k + 1, width), f"cell int, query long, vector array<{kind}>, leaves array<int>, bound double")
    visits = durable(visits, "visits")
    held = points.mapInArrow(_index(forest, width), f"cell int, leaf int, first long, vector array<{kind}>").groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
    sizes = durable(held.join(visits.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).alias("turns")), "cell"), "cells")

    def every_one(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    sides = [index.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts"))).withColumn("turn", every_one("turns")).select("cell", "part", "turn", "leaf", "first", "vector")]
    sides += [visits.join(sizes, "cell").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns"))).withColumn("part", every_one("parts")).select("cell", "part", "turn", "query", "vector", "leaves", "bound")]
    left, right = (x.groupBy("cell", "part", "turn") for x in sides)
    found = left.cogroup(right).applyInArrow(_rank(k + 1, width), "query long, first long, score double")
    best = found.groupBy("query", "first").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("query", "first", "score")
    pairs = best.join(kept.select("first", F.col("id").alias("vec_id")), "first").select("query", "vec_id", "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.join(queries, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
