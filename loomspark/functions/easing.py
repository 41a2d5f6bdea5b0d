"""Easing curves by name, cubic Bezier curves, time warps and eased schedules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import col

#: Bezier handles of the presets and of any other curve.
PRESETS = {
    "easeInExpoOutCubic": (0.85, 0, 0.15, 1),
    "easeInOutExpo": (0.87, 0, 0.13, 1),
    "easeInQuartOutQuad": (0.8, 0, 0.2, 1),
    "easeInOutCubic": (0.65, 0, 0.35, 1),
    "easeInOutSine": (0.37, 0, 0.63, 1),
}
DEFAULT_BEZIER = (0.42, 0, 0.58, 1)
#: How near a Bezier curve's x must come (the rule asks for TOLERANCE).
EXACT = 1e-12
#: Exactness of inverses, steps of bisection, samples of the test for rising curves.
TOLERANCE, BISECTIONS, SAMPLES, NEWTON = 1e-6, 32, 256, 8

_POWERS = {"Quad": 2, "Cubic": 3, "Quart": 4, "Quint": 5}


class _Maths:
    """The few functions that curves need, over Columns or over arrays."""

    def __init__(self, sin, cos, sqrt, power, where) -> None:
        self.sin, self.cos, self.sqrt, self.power, self.where = sin, cos, sqrt, power, where


_COLUMNS = _Maths(F.sin, F.cos, F.sqrt, lambda a, b: F.pow(F.lit(a), b), lambda test, a, b: F.when(test, a).otherwise(b))
_ARRAYS = _Maths(np.sin, np.cos, lambda x: np.sqrt(np.maximum(x, 0.0)), np.power, np.where)


def _starts(kind: str, t, m: _Maths):
    """The curve that starts slowly; the other two kinds mirror it."""
    if kind in _POWERS:
        out = t
        for _ in range(_POWERS[kind] - 1):
            out = out * t
        return out
    if kind == "Sine":
        return 1 - m.cos(t * (np.pi / 2))
    if kind == "Expo":
        return m.where(t == 0, 0.0, m.power(2.0, 10 * t - 10))
    if kind == "Circ":
        return 1 - m.sqrt(1 - t * t)
    return None


def _curve(name: str, t, m: _Maths):
    """A curve by name; an unknown name is linear."""
    pairs = {"easeInExpoOutCubic": ("Expo", "Cubic"), "easeInQuartOutQuad": ("Quart", "Quad")}
    if name in pairs:
        a, b = pairs[name]
        return m.where(t <= 0.5, 0.5 * _starts(a, t * 2, m), 1 - 0.5 * _starts(b, 2 - 2 * t, m))
    for start, how in (("easeInOut", "both"), ("easeOut", "out"), ("easeIn", "in")):
        if name.startswith(start):
            kind = name.removeprefix(start)
            if _starts(kind, t, m) is None:
                return t
            if how == "in":
                return _starts(kind, t, m)
            if how == "out":
                return 1 - _starts(kind, 1 - t, m)
            return m.where(t < 0.5, _starts(kind, 2 * t, m) / 2, 1 - _starts(kind, 2 - 2 * t, m) / 2)
    return t


NAMES = ["linear", *[f"ease{how}{kind}" for how in ("In", "Out", "InOut") for kind in (*_POWERS, "Sine", "Expo", "Circ")], "easeInExpoOutCubic", "easeInQuartOutQuad"]


def ease(t: str | Column, name: str | Callable) -> Column:
    """A curve of t by name, or by a function from Column to Column; an unknown name is linear."""
    return name(col(t)) if callable(name) else _curve(name, col(t), _COLUMNS)


def preset_bezier(name: str | None) -> tuple[float, ...]:
    return PRESETS.get(name or "", DEFAULT_BEZIER)


def _bezier(t: np.ndarray, handles) -> np.ndarray:
    """The curve's y where its x is t: a few steps of Newton, and bisection where they do not arrive."""
    x1, y1, x2, y2 = (min(1.0, max(0.0, h)) for h in handles)
    at = lambda a, b, u: ((1 - 3 * b + 3 * a) * u + 3 * b - 6 * a) * u * u + 3 * a * u
    slope = lambda a, b, u: 3 * (1 - 3 * b + 3 * a) * u * u + 2 * (3 * b - 6 * a) * u + 3 * a
    x = np.clip(t, 0.0, 1.0)
    u = x.copy()
    for _ in range(NEWTON):
        error, d = at(x1, x2, u) - x, slope(x1, x2, u)
        move = (np.abs(error) >= EXACT) & (np.abs(d) >= TOLERANCE)
        u = np.where(move, u - error / np.where(move, d, 1.0), u)
    late = np.abs(at(x1, x2, u) - x) >= TOLERANCE
    if late.any():
        low, high = np.zeros(late.sum()), np.ones(late.sum())
        for _ in range(60):
            mid = (low + high) / 2
            below = at(x1, x2, mid) < x[late]
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        u[late] = (low + high) / 2
    return at(y1, y2, u)


def bezier(t: str | Column, handles) -> Column:
    """A cubic Bezier curve (x1, y1, x2, y2, each held between 0 and 1) of t, held between 0 and 1; null stays null."""
    handles = tuple(map(float, handles))

    @F.pandas_udf("double")
    def curve(x: pd.Series) -> pd.Series:
        return pd.Series(_bezier(x.to_numpy(float), handles)).where(x.notna())

    return curve(col(t).cast("double"))


def _rising(name: str) -> bool:
    y = _curve(name, np.linspace(0.0, 1.0, SAMPLES + 1), _ARRAYS)
    return bool((np.diff(y) > -TOLERANCE).all())


def _inverse(y: np.ndarray, name: str) -> np.ndarray:
    low, high, out, done = np.zeros(len(y)), np.ones(len(y)), np.full(len(y), 0.5), np.zeros(len(y), bool)
    for _ in range(BISECTIONS):
        out = np.where(done, out, (low + high) / 2)
        gap = _curve(name, out, _ARRAYS) - y
        done |= np.abs(gap) <= TOLERANCE
        low, high = np.where(gap < 0, out, low), np.where(gap < 0, high, out)
    return np.where(y <= TOLERANCE, 0.0, np.where(y >= 1 - TOLERANCE, 1.0, out))


def _warp(t: np.ndarray, d_in: float, d_out: float, name: str) -> np.ndarray:
    x = np.clip(t / d_in, 0.0, 1.0)
    return (_inverse(x, name) if _rising(name) else _curve(name, x, _ARRAYS)) * d_out


def warp_time(t: str | Column, d_in: float = 5.0, d_out: float = 1.5, name: str = "easeInOutCubic") -> Column:
    """A time of a stretch of d_in seconds in one of d_out: the inverse of the curve if it rises, else the curve itself; null stays null."""

    @F.pandas_udf("double")
    def warp(x: pd.Series) -> pd.Series:
        return pd.Series(_warp(x.fillna(0.0).to_numpy(float), d_in, d_out, name)).where(x.notna())

    return warp(col(t).cast("double"))


def warped_duration(start: str | Column, duration: str | Column, d_in: float = 5.0, d_out: float = 1.5, name: str = "easeInOutCubic") -> Column:
    return warp_time(col(start) + col(duration), d_in, d_out, name) - warp_time(start, d_in, d_out, name)


def warp_problems(d_in: float = 5.0, d_out: float = 1.5, name: str = "easeInOutCubic", tolerance: float = 0.001) -> list[str]:
    """What is wrong with a warp: its ends, or a time at which it falls."""
    at = _warp(np.arange(101) * d_in / 100, d_in, d_out, name)
    out = [f"Start point should be 0, got {at[0]}"] if abs(at[0]) > tolerance else []
    out += [f"End point should be {d_out}, got {at[-1]}"] if abs(at[-1] - d_out) > tolerance else []
    falls = np.flatnonzero(np.diff(at) < 0)
    return out + ([f"Monotonicity violation at t={(falls[0] + 1) * d_in / 100:.2f}: {at[falls[0] + 1]} < {at[falls[0]]}"] if len(falls) else [])


def warp_stats(spans: DataFrame, key: list[str], d_in: str, d_out: str, name: str = "easeInOutCubic", n: int = 100) -> DataFrame:
    """min, max and mean speed of each span's n pieces, against the mean speed of the whole."""
    pieces = spans.select(*key, F.col(d_in).alias("_in"), F.col(d_out).alias("_out"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    at = lambda i: warp_time((i / F.lit(float(n))).cast("double"), 1.0, 1.0, name) * F.col("_out")
    pieces = pieces.withColumn("_a", at(F.col("_i"))).withColumn("_b", at(F.col("_i") + 1))
    speed = (F.col("_in") / n) / (F.col("_b") - F.col("_a") + 1e-10) / (F.col("_in") / F.col("_out"))
    return pieces.groupBy(*key).agg(F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"), F.avg(speed).alias("avg_speed"))


def eased_schedule(spans: DataFrame, key: list[str], d_in: str, d_out: str, fps: float, name: str = "easeInOutCubic") -> DataFrame:
    """(key, slot, at, source_time): for each output slot the time of the source that it shows, a thousandth before its end at most."""
    slots = F.floor(F.col(d_out) * fps)
    rows = spans.where(slots > 0).select(*key, F.col(d_in).alias("_in"), slots.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"))
    done = F.when(F.col("_n") > 1, F.col("slot") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    source = F.greatest(F.lit(0.0), F.least(ease(done, name) * F.col("_in"), F.col("_in") - 0.001))
    return rows.select(*key, "slot", (F.col("slot") * (1 / fps)).alias("at"), source.alias("source_time"))
