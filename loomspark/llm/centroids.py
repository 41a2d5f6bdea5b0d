"""Centroid clustering over Hilbert-ordered blocks of vectors with zone maps (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Vectors of a block, and bits of each component that its place on the curve counts.
BLOCK, BITS = 256, 4
#: Whole components stay below this size, so that a squared distance fits a long.
MOST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve, as rows of bytes, most significant first, of cells (n, dims) of ``bits`` bits each.

    Cells are turned into the transposed place by undoing the curve's rotations from the highest bit on and
    then Gray coding, one dimension of all cells at a time (Skilling 2004).
    """
    x = np.ascontiguousarray(cells.T, dtype=np.uint8)
    for b in range(bits - 1, 0, -1):
        below = np.uint8((1 << b) - 1)
        for i in range(len(x)):
            on = (x[i] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, np.uint8((1 << b) - 1), np.uint8(0))
    x ^= turn
    planes = [x.T >> b & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some vector within a box.

    The centroid that is nearest to its own farthest corner is held against each other one: how much farther
    than it that one is anywhere in the box, a sum of one bound a component, is negative only where it can win.
    """
    farthest = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    one = int((farthest * farthest).sum(1).argmin())
    way, squares = centroids - centroids[one], (centroids * centroids).sum(1)
    behind = 2 * np.maximum(low * way, high * way).sum(1) + squares[one] - squares  # the most by which ``one`` is farther
    return np.flatnonzero(behind >= 0)


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number among equals; exact in whole numbers."""
    some = candidates(low, high, centroids)
    near = centroids[some]
    most = int(max(np.abs(vectors).max(), np.abs(near).max()))
    kind = np.float64 if vectors.shape[1] * most * most < 2**50 else np.int64  # whole numbers that doubles hold, for the faster product
    v, c = vectors.astype(kind), near.astype(kind)
    squares = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    at = squares.argmin(1)
    return some[at].astype(np.int32), squares[np.arange(len(v)), at].astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _blocks(vectors: DataFrame, dims: int, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors that are neighbours on the curve: ids, values, and the least and greatest of each component."""
    ends = vectors.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    base, width = ends[0], max(1, ends[1] - ends[0] + 1)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = hilbert_keys((_matrix(b.column(1), dims) - base) * (1 << BITS) // width)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "q", "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, size):
                part = b.slice(first, size)
                v = _matrix(part.column(1), dims).astype(np.int32)
                out = [part.column(0).to_pylist()], [v.tobytes()], [v.min(0).tobytes()], [v.max(0).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(b.schema.field(0).type)), *[pa.array(x, pa.binary()) for x in out[1:]]], ["ids", "vectors", "low", "high"])

    along = vectors.mapInArrow(placed, f"vec_id {kind}, q array<int>, place binary")
    # equal vectors share a place: the id splits them
    along = along.repartitionByRange("place", F.xxhash64("vec_id")).sortWithinPartitions("place", F.xxhash64("vec_id")).drop("place")
    return durable(along.mapInArrow(packed, f"ids array<{kind}>, vectors binary, low binary, high binary"), "centroid-blocks")


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    """(ids, vectors, least, greatest) of each block."""
    for i in range(batch.num_rows):
        v, low, high = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int32).astype(np.int64) for k in (1, 2, 3))
        yield batch.column(0)[i].values, v.reshape(-1, dims), low, high


def _tallied(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid that has vectors: their number, summed distance and componentwise sum. One row a centroid and task is shuffled."""
    dims = centroids.shape[1]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = (np.zeros(s, np.int64) for s in (len(centroids), len(centroids), centroids.shape))
        for b in batches:
            for _, v, low, high in _opened(b, dims):
                at, distance = nearest(v, low, high, centroids)
                np.add.at(n, at, 1)
                np.add.at(far, at, distance)
                for c in np.unique(at):
                    sums[c] += v[at == c].sum(0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), pa.array(far[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "far", "sums"])

    parts = blocks.mapInArrow(tally, "cluster int, n long, far long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n"), F.sum("far"), F.array(*[F.sum(F.col("sums")[j]) for j in range(dims)])).collect()  # a row a centroid at most
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    Vectors of ``dims`` components, none null or non-finite, become whole numbers floor(scale * x). The first
    centroids are the ``k`` vectors (all, if fewer) of least sha256 of ``seed:id``; each round moves a
    centroid to the floor of its vectors' mean, empty ones stay.

    Vectors are written once, in Hilbert order, as blocks with their least and greatest components. In each
    pass a block's box bounds leave the centroids that can be nearest to any of its vectors, and these alone are
    compared. Only ``k`` rows of sums reach the driver. Copies of one vector spread over tasks by their ids.

    Vectors with a component of 2^27 or more after scaling are left out, as their distances fit no long. A
    null id takes part and comes last as a first centroid; repeated rows count each; other columns are ignored;
    where no vector is kept there are no rows.
    """
    x = F.col(vector_col)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < MOST))
    vectors = table.where(sound).select(F.col(id_col).alias("vec_id"), whole.cast("array<int>").alias("q"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = vectors.orderBy(order.asc_nulls_last(), "q").limit(k).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not seeds:
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r["q"] for r in seeds], np.int64)
    blocks = _blocks(vectors, dims, block)
    for _ in range(rounds):
        for c, (n, _, sums) in _tallied(blocks, centroids).items():
            centroids[c] = [s // n for s in sums]
    last = {c: far for c, (_, far, _) in _tallied(blocks, centroids).items()}

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, v, low, high in _opened(b, dims):
                at, distance = nearest(v, low, high, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(distance)], ["vec_id", "cluster", "distance"])

    sums = table.sparkSession.createDataFrame([(c, far, sum(last.values()), centroids[c].tolist()) for c, far in last.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    rows = blocks.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
