"""Series on a time axis, keyed by series id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .graph import settled

#: The part of a series that a row lies in.
PART = "_part"


def in_parts(series: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_part``: Spark's even ranges of (key, order), numbered in that order, in a written table.

    A series of any length lies in as many parts as there are tasks; equal places in one part.
    """
    return settled(series.repartitionByRange(*key, *order).withColumn(PART, F.spark_partition_id()))


def carried(parts: DataFrame, key: list[str], facts: dict[str, Column], carry: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """The rows of ``in_parts`` with what the parts before theirs come to.

    ``facts`` are aggregates of one part of a series; ``carry`` are expressions over them in the window of all
    parts of a series before a row's, which they are given. There is a row for each part of a series, so the window is short.
    """
    each = parts.groupBy(*key, PART).agg(*[f.alias(n) for n, f in facts.items()])
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ids = (*key, PART)
    each = each.select(*[F.col(c).alias(f"_at_{c}") for c in ids], *[c(before).alias(n) for n, c in carry.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in ids]
    return parts.join(each, same, "left").drop(*[f"_at_{c}" for c in ids])


def resample_asof(series: DataFrame, targets: DataFrame, key: list[str], t: str, value: str, ord_: str, long: bool = False) -> DataFrame:
    """The value at or before each target time; targets before the first row are left out.

    ``long``: for few and long series, which are scanned in parts, each with the last value of those before it.
    """
    both = series.select(*key, t, value, F.col(ord_).alias("_o"), F.lit(0).alias("_target")).unionByName(targets.select(*key, t).withColumns({value: F.lit(None).cast(series.schema[value].dataType), "_o": F.lit(None).cast(series.schema[ord_].dataType), "_target": F.lit(1)}))
    own = F.when(F.col("_target") == 0, F.struct(value))
    early, groups = F.lit(None).cast(f"struct<{value}:{series.schema[value].dataType.simpleString()}>"), key
    if long:
        both = in_parts(both, key, [t])
        last = F.max_by(own, F.when(F.col("_target") == 0, F.struct(t, "_o")))
        both, early, groups = carried(both, key, {"_last": last}, {"_early": lambda w: F.last("_last", ignorenulls=True).over(w)}), F.col("_early"), [*key, PART]
    w = Window.partitionBy(*groups).orderBy(t, "_target", "_o").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_v", F.coalesce(F.last(own, ignorenulls=True).over(w), early))
    return held.where("_target = 1 and _v is not null").select(*key, t, F.col(f"_v.{value}").alias(value))


def peaks(series: DataFrame, key: list[str], ord_: list[str], value: str, n: int = 256, long: bool = False) -> DataFrame:
    """Largest magnitude in each of n buckets of equal size; rows beyond the last bucket are left out. ``long`` as in ``resample_asof``."""
    if long:
        rows = in_parts(series, key, ord_)
        rows = carried(rows, key, {"_rows": F.count("*")}, {"_before": lambda w: F.sum("_rows").over(w)})
        place = F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy(*key, PART).orderBy(*ord_)) - 1
        all_ = rows.groupBy(*key).agg(F.count("*").alias("_all"))
        rows = rows.withColumn("_place", place).join(all_, key)
        size, place = F.greatest(F.lit(1), F.floor(F.col("_all") / n)), F.col("_place")
    else:
        w = Window.partitionBy(*key)
        rows, size, place = series, F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n)), F.row_number().over(w.orderBy(*ord_)) - 1
    return rows.withColumn("bucket", F.floor(place / size)).where(F.col("bucket") < n).groupBy(*key, "bucket").agg(F.max(F.abs(value)).alias("peak"))


def trim(series: DataFrame, key: list[str], t: str, start: float, end: float) -> DataFrame:
    """Rows within [start, end), with times from the first one kept."""
    if end <= 0 or start >= end:
        raise ValueError("the trimmed range is empty")
    kept = series.where((F.col(t) >= start) & (F.col(t) < end))
    return kept.withColumn(t, F.col(t) - F.min(t).over(Window.partitionBy(*key)))


def stitch(segments: DataFrame, key: list[str], segment: str, t: str, step: float, repeat: int = 1) -> DataFrame:
    """Segments after each other on a grid: each starts one step behind the end of the one before.

    Rows come in order of time, and one that would lie before a row already placed is left out, which
    after rounding cannot happen within a segment; rows on one slot stay. The whole is repeated
    ``repeat`` times (column ``round``).
    """
    first = F.min(t).over(Window.partitionBy(*key, segment))
    placed = segments.withColumn("_at", F.floor((F.col(t) - first) / step + 0.5))
    length = placed.groupBy(*key, segment).agg((F.max("_at") + 1).alias("_n"))
    before = Window.partitionBy(*key).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    base = length.withColumns({"_base": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*key))}).drop("_n")
    out = placed.join(base, [*key, segment]).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return out.withColumn("slot", F.col("round") * F.col("_all") + F.col("_base") + F.col("_at")).drop("_at", "_base", "_all")
