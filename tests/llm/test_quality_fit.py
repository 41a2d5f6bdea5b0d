"""The quality operator's fit and calibration against plain formulas."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import quality
from loomspark.llm.common import text_buffers


def curve_by_hand(n, p):
    """Isotonic means by the max-min formula; an empty cell takes the value before it, or the first one."""
    some = np.flatnonzero(n)
    own = [max(min(p[some[a : b + 1]].sum() / n[some[a : b + 1]].sum() for b in range(i, len(some))) for a in range(i + 1)) for i in range(len(some))]
    at = np.maximum(np.searchsorted(some, np.arange(len(n)), side="right") - 1, 0)
    return np.array(own)[at]


def test_isotonic_means():
    draw = np.random.default_rng(2)
    for _ in range(50):
        n = draw.integers(0, 3, 30)
        n[draw.integers(30)] = 1
        p = draw.binomial(n, np.linspace(0.2, 0.8, 30))
        assert quality.isotonic(n, p) == pytest.approx(curve_by_hand(n, p))


def test_scores_by_hand(spark):
    """Ridge weights by the normal equations over all fitted rows, then the curve over the others."""
    draw = random.Random(8)
    good = lambda: " ".join(draw.choice(["the", "river", "was", "long", "and", "Old."]) for _ in range(draw.randrange(5, 60)))
    bad = lambda: "".join(draw.choice("#$%|!AZ9 \n") for _ in range(draw.randrange(5, 200)))
    texts = [good() if i % 2 or draw.random() < 0.1 else bad() for i in range(240)]
    y = {i: int(bool(i % 2)) for i in range(200) if i % 5}
    rows = [*enumerate(texts), (1_000, None), (1_001, "")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, spark.createDataFrame(list(y.items()), "doc_id long, quality int")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    known = [i for i in y if not held[i]]
    fold = {r["id"]: r["f"] for r in spark.range(240).select("id", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)).alias("f")).collect()}
    x = dict(zip([i for i, _ in rows], quality.statistics(*text_buffers(pa.array([t for _, t in rows], pa.string()))), strict=True))
    own = np.array([x[i] for i in known])
    features = quality.Fourier(own.mean(0), own.std(0))
    z = features(np.array([x[i] for i in known if fold[i]]))
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ np.array([float(y[i]) for i in known if fold[i]]))
    place = lambda i: float(np.clip((features(x[i][None]) @ beta - quality.LOW) / (quality.HIGH - quality.LOW), 0, 1)[0] * (quality.CELLS - 1))
    n, p = np.zeros(quality.CELLS), np.zeros(quality.CELLS)
    for i in known:
        if not fold[i]:
            n[int(np.rint(place(i)))] += 1
            p[int(np.rint(place(i)))] += y[i]
    curve = curve_by_hand(n, p)
    assert len(got) == len(rows) and n.sum() > 10
    for i, _ in rows:
        want = np.clip(0.998 * np.interp(place(i), np.arange(quality.CELLS), curve) + 0.002 * place(i) / quality.CELLS, 0, 1)
        assert got[i]["held_out"] == held[i] and got[i]["predicted"] == int(got[i]["score"] >= quality.THRESHOLD)
        assert got[i]["score"] == pytest.approx(want, abs=1e-4)
