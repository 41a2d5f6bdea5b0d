"""Tables kept in buckets of their key's hash, so that a change rewrites the buckets that it touches and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup
from ..operators.graph import settled

BUCKET, GONE = "bucket", "_gone"
#: Buckets of a table; a key's bucket never changes, so neither may their number.
BUCKETS = 64


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def write_table(df: DataFrame, path: str, keys: list[str], n: int = BUCKETS) -> None:
    """A new table; its columns may not be named as the two that it adds."""
    df.withColumns({GONE: F.lit(False), BUCKET: _bucket(keys, n)}).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(~F.col(GONE)).drop(GONE, BUCKET)


def _change(spark: SparkSession, path: str, touched: DataFrame, keys: list[str], n: int, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite the buckets of the keys in ``touched``: read, changed, written aside and then put in their places.

    A bucket that loses all its rows keeps one row that counts for nothing, as one without files would stay as it was.
    """
    table = spark.read.parquet(path)
    at = [r[0] for r in touched.select(_bucket(keys, n).alias(BUCKET)).distinct().collect()]  # n at most
    if not at:
        return
    own = table.where(F.col(BUCKET).isin(at))
    new = change(own.where(~F.col(GONE)).drop(GONE, BUCKET)).withColumns({GONE: F.lit(False), BUCKET: _bucket(keys, n)})
    mark = own.groupBy(BUCKET).agg(*[F.first(c).alias(c) for c in table.columns if c != BUCKET]).withColumn(GONE, F.lit(True))
    new = settled(new.unionByName(mark))
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert_rows(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order_col: str, n: int = BUCKETS) -> None:
    """As ``dedup.upsert``, in place."""
    _change(spark, path, updates, keys, n, lambda own: dedup.upsert(own, updates, keys, order_col).select(*own.columns))


def patch_rows(spark: SparkSession, path: str, changes: DataFrame, key: str, columns: list[str], now: Column, n: int = BUCKETS) -> None:
    """As ``dedup.patch``, in place; the table has a column ``updated_at``, which rows without a change keep."""

    def patched(own: DataFrame) -> DataFrame:
        done = dedup.patch(own.withColumnRenamed("updated_at", "_before"), changes, key, columns, now)
        return done.withColumn("updated_at", F.coalesce("updated_at", "_before")).select(*own.columns)

    _change(spark, path, changes, [key], n, patched)


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, keys: list[str], n: int = BUCKETS) -> None:
    """Without the rows whose key is in ``gone``: of a parent's table, or of its children's kept by the parent's key."""
    _change(spark, path, gone, keys, n, lambda own: own.join(gone.select(*keys).distinct(), keys, "left_anti").select(*own.columns))
