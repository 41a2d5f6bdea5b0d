"""Quality scores of documents by ridge regression on random Fourier features (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, durable, list_array, text_buffers
from .words import shingles, word_hashes

#: Most labelled rows that a fit takes; where there are more, a hash of the id picks as many.
MOST_LABELLED = 200_000
FOURIER, RIDGE, SEED = 256, 1e-3, 7
#: Cells of the raw score between LOW and HIGH from which the calibration curve is made.
CELLS, LOW, HIGH = 3_000, -1.0, 2.0
THRESHOLD = 0.7
FIT_TASKS = 16

_CLASSES = [
    np.isin(np.arange(256), list(range(97, 123))),
    np.isin(np.arange(256), list(range(65, 91))),
    np.isin(np.arange(256), list(range(48, 58))),
    np.arange(256) >= 128,
    np.isin(np.arange(256), list(b" ")),
    np.isin(np.arange(256), list(b"\n\r")),
    np.isin(np.arange(256), list(b".,;:'\"?-")),
    np.isin(np.arange(256), list(b"!")),
    np.isin(np.arange(256), list(b"|")),
    np.isin(np.arange(256), list(b"#$%&*@^~_+=<>\\/")),
    np.isin(np.arange(256), list(b"()[]{}")),
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text [texts, features]: lengths, shares of byte classes, word shapes and repetition."""
    n, size = len(offsets) - 1, np.diff(offsets)
    some = np.maximum(size, 1)
    out = []
    for mask in _CLASSES:
        upto = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        out.append((upto[offsets[1:]] - upto[offsets[:-1]]) / some)
    hashes, first, starts, lens = word_hashes(data, offsets)
    count = np.diff(first)
    words = np.maximum(count, 1)

    def per_text(values):
        upto = np.concatenate([[0.0], np.cumsum(values)])
        return upto[first[1:]] - upto[first[:-1]]

    mean = per_text(lens) / words
    out += [np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(per_text(lens.astype(float) ** 2) / words - mean**2, 0))]
    if len(hashes):
        end, begin = data[starts + lens - 1], data[starts]
        same = np.zeros(len(hashes))
        same[1:] = hashes[1:] == hashes[:-1]
        lead = first[:-1][count > 0]
        same[lead] = 0
        out += [per_text(_CLASSES[9][end]) / words, per_text(_CLASSES[1][begin]) / words, per_text(_CLASSES[1][end]) / words, per_text(same) / words]
    else:
        out += [np.zeros(n)] * 4
    _, _, distinct = shingles(data, offsets)
    _, _, single = shingles(data, offsets, 1)
    out += [distinct / np.maximum(count - 4, 1), single / words, single / np.sqrt(words)]
    return np.stack(out, axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for first, last in chunks(offsets):
            x = statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            rest = [batch.column(i).slice(first, last - first) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *rest, list_array(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())], ["doc_id", *batch.schema.names[2:], "x"])


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Fourier:
    """The feature map: standardised statistics, and cosines of random projections of them."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int = FOURIER, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = draw.normal(0, 1 / np.sqrt(len(mean)), (len(mean), n))
        self.b = draw.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)], axis=1)


def _normal(features: Fourier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = features(matrix(batch.column(1))), np.asarray(batch.column(0))
            part = z.T @ np.concatenate([z, y[:, None]], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), list_array(total.ravel(), np.arange(len(total) + 1) * total.shape[1], pa.float64())], ["i", "row"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = matrix(table["row"].combine_chunks()).sum(axis=0)
    return pa.table({"i": table["i"][:1], "row": pa.array([total.tolist()], pa.list_(pa.float64()))})


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing means of ordered cells by pooling adjacent violators; empty cells take their pool's."""
    pools: list[list[float]] = []
    for a, b in zip(n, positive, strict=True):
        pools.append([float(b), float(a), 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0 or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            b2, a2, w2 = pools.pop()
            pools[-1] = [pools[-1][0] + b2, pools[-1][1] + a2, pools[-1][2] + w2]
    return np.concatenate([np.full(int(w), b / a if a else 0.5) for b, a, w in pools])


def _score(features: Fourier, beta: np.ndarray, curve: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = features(matrix(batch.column(1))) @ beta if batch.num_rows else np.zeros(0)
            place = np.clip((raw - LOW) / (HIGH - LOW), 0, 1) * (CELLS - 1)
            if curve is None:
                value = np.rint(place)
            else:  # the curve, and a small strictly rising part that orders what the curve holds equal
                value = np.clip(0.998 * np.interp(place, np.arange(CELLS), curve) + 0.002 * place / CELLS, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["k", "value"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Statistics of each whole text feed a Gaussian-kernel machine: random Fourier features, of which
    every partition sums the normal equations of its labelled rows; the sums are added by Spark and
    solved on the driver (a fixed 280 x 281 matrix). Four fifths of the labels (at most MOST_LABELLED)
    fit the weights; the others calibrate the raw score by isotonic regression over CELLS counts.

    Labels count only where crc32 of the id as text, modulo 4, is not 2. A null text is empty; a null
    id is never labelled and not held out; rows with the same id share its label; several labels of an
    id are averaged. Without any label, or with one kind only, all scores are that label (or 0.5). Other columns are ignored; an empty table of documents gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = durable(rows.mapInArrow(_features, "doc_id long, x array<double>"), "statistics")
    crc = F.crc32(F.col("doc_id").cast("string"))
    held = F.coalesce(crc % 4 == 2, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y")).where(crc % 4 != 2)
    known = durable(x.where(~held).join(known, "doc_id").select("doc_id", "y", "x"), "labelled")
    facts = known.agg(F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).first()
    out = [F.col("doc_id"), held.alias("held_out")]
    if not facts["n"] or facts["a"] == facts["b"]:
        value = F.lit(float(facts["a"]) if facts["n"] else 0.5)
        return x.select(*out, value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
    if facts["n"] > MOST_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * MOST_LABELLED / facts["n"]))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5))
    width = len(x.select("x").first()["x"])
    moments = known.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    features = Fourier(np.array([moments[f"m{i}"] for i in range(width)]), np.array([moments[f"s{i}"] for i in range(width)]))
    sums = known.where(fold != 0).select("y", "x").repartition(FIT_TASKS).mapInArrow(_normal(features), "i int, row array<double>")
    sums = sums.groupBy("i").applyInArrow(_add, "i int, row array<double>").toArrow().sort_by("i")
    if sums.num_rows:
        total = matrix(sums["row"].combine_chunks())
        beta = np.linalg.solve(total[:, :-1] + RIDGE * total[0, 0] * np.eye(len(total)), total[:, -1])
    else:
        beta = np.zeros(1 + width + FOURIER)
    check = known.select("y", "x", fold.alias("fold")).where("fold = 0").select("y", "x").mapInArrow(_score(features, beta, None), "k double, value double")
    cells = check.groupBy(F.col("value").cast("int").alias("cell")).agg(F.count("*").alias("n"), F.sum("k").alias("p")).toArrow().to_pydict()
    n, p = np.zeros(CELLS), np.zeros(CELLS)
    n[cells["cell"]], p[cells["cell"]] = cells["n"], cells["p"]
    curve = isotonic(n, p)
    scored = x.withColumn("k", F.col("doc_id")).select("k", "x").mapInArrow(_score(features, beta, curve), "k long, value double").withColumnRenamed("k", "doc_id")
    return scored.select(*out, F.col("value").alias("score"), (F.col("value") >= threshold).cast("int").alias("predicted"))
