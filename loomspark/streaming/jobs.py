"""Streams: windows, sessions, deduplication, recents, running cost, routing, task status and expiring values.

Operators take and return streaming DataFrames; ``drain`` runs one until its source has no more and gives the
rows back. Windows, sessions and deduplication keep their state in Spark's aggregates; recents, running
cost, status and expiring values in keyed state of bounded size (``keyed``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.graph import shared_folder

#: States of a task that stay.
TERMINAL = ("succeeded", "failed", "expired")


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state needs; the session's setting stays as it was."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, trigger: dict | None = None, folder: str | None = None) -> DataFrame:
    """All rows that the stream gives until its source is read; with ``keys``, each key's row of the last batch.

    ``folder`` keeps the stream's state and its rows: a job that is started again with it goes on where
    it stopped. Without one, a new folder is taken and the job begins anew. A batch that runs again after
    a loss replaces its own folder, so rows never count twice.
    """
    spark, folder = stream.sparkSession, folder or shared_folder(stream.sparkSession, name)

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put)
    with _keyed_state(spark):
        query = run.trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    if keys:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("_n = 1").drop("_n")
    return out.drop("batch")


def stream_kpis(stream: DataFrame, ts: str, width: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """Measures of each tumbling window; rows later than ``delay`` behind the newest are dropped."""
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(*measures)
    return windows.select(F.col("window.start").alias("start"), *[c for c in windows.columns if c != "window"])


def stream_dedup(stream: DataFrame, content: Column, ts: str, delay: str) -> DataFrame:
    """One row for each content hash, as long as its repeats come within ``delay``."""
    return stream.withColumn("hash", F.md5(content)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["hash"])


def sessionize(stream: DataFrame, key: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions that a gap ends; on a stream each comes out once it can't grow any more. Batch rows work as well."""
    rows = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    s = rows.groupBy(*key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return s.select(*key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, time: str = "none") -> DataFrame:
    """Rows of (keys, ``out``) that a processor gives from each key's state, in update mode."""
    own = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, f"{own}, {out}", "Update", time)


def _frame(keys: list[str], key: tuple, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, *columns])


def _micros(ts: pd.Series) -> list[int]:
    return (pd.to_datetime(ts).astype("datetime64[us]").astype("int64")).tolist()


class Recents(StatefulProcessor):
    """The ``n`` newest different items of a key, as a list state that never holds more."""

    def __init__(self, keys: list[str], item: str, ts: str, n: int) -> None:
        self.keys, self.item, self.ts, self.n = keys, item, ts, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("recents", "item string, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = dict(self.state.get()) if self.state.exists() else {}
        for batch in rows:
            for item, us in zip(batch[self.item], _micros(batch[self.ts]), strict=True):
                last[item] = max(us, last.get(item, us))
        kept = sorted(last.items(), key=lambda x: (-x[1], str(x[0])))[: self.n]
        self.state.put(kept)
        yield _frame(self.keys, key, [(item, us, place) for place, (item, us) in enumerate(kept, 1)], ["_item", "_us", "place"])

    def close(self) -> None:
        pass


def stream_recents(stream: DataFrame, key: list[str], item: str, ts: str, n: int = 8) -> DataFrame:
    """Each key's n newest items with their last use and place; an item used again moves to the front, equal times go by the item's text.

    The whole list of a key comes with each batch that touches it: ``drain`` with the key and ``place``. An
    item beyond the n-th is forgotten, which loses nothing: its successors can only become newer.
    """
    out = keyed(stream, key, Recents(key, item, ts, n), "_item string, _us long, place int")
    return out.select(*key, F.col("_item").alias(item), F.timestamp_micros("_us").alias(ts), "place")


class Status(StatefulProcessor):
    """Last status, and first terminal one, of a task."""

    def __init__(self, task: str, status: str, ts: str) -> None:
        self.task, self.status, self.ts = task, status, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "last string, last_us long, ended string, ended_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, last_us, ended, ended_us = self.state.get() if self.state.exists() else (None, None, None, None)
        for batch in rows:
            for status, us in zip(batch[self.status], _micros(batch[self.ts]), strict=True):
                if last_us is None or us >= last_us:
                    last, last_us = status, us
                if status in TERMINAL and (ended_us is None or us < ended_us):
                    ended, ended_us = status, us
        self.state.update((last, last_us, ended, ended_us))
        yield _frame([self.task], key, [(ended or last,)], [self.status])

    def close(self) -> None:
        pass


def latest_status(df: DataFrame, task: str, status: str, ts: str) -> DataFrame:
    """Each task's last status, where the first terminal one stays whatever comes later; for streams and batches."""
    if df.isStreaming:
        return keyed(df, [task], Status(task, status, ts), f"{status} string")
    end = F.col(status).isin(*TERMINAL)
    ended, last = F.min_by(F.when(end, F.col(status)), F.when(end, F.col(ts))), F.max_by(status, ts)
    return df.groupBy(task).agg(F.coalesce(ended, last).alias(status))


class Fresh(StatefulProcessor):
    """A key's newest value and a timer that ends it."""

    def __init__(self, keys: list[str], value: str, ts: str, ttl: int) -> None:
        self.keys, self.value, self.ts, self.ttl = keys, value, ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("fresh", "value string, us long")

    def _told(self, key, value, us) -> pd.DataFrame:
        return _frame(self.keys, key, [(value, us, value is None)], ["_value", "_us", "expired"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, us = self.state.get() if self.state.exists() else (None, -1)
        for batch in rows:
            for v, u in zip(batch[self.value], _micros(batch[self.ts]), strict=True):
                if (u, str(v)) >= (us, str(value)):
                    value, us = str(v), u
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = (us + self.ttl) // 1_000 + 1
        if end <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
            yield self._told(key, None, us)
        else:
            self.state.update((value, us))
            self.handle.registerTimer(end)
            yield self._told(key, value, us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, us = self.state.get() if self.state.exists() else (None, -1)
        self.state.clear()
        yield self._told(key, None, us)

    def close(self) -> None:
        pass


def stream_fresh_values(stream: DataFrame, key: list[str], value: str, ts: str, ttl: str, delay: str) -> DataFrame:
    """Each key's newest value (as text) as long as it is not older than ``ttl`` by the stream's own clock, then one row with ``expired``.

    The clock is the watermark, ``delay`` behind the newest row, so that tests and reruns see the same;
    a value's state goes when its timer fires. Of values at one time the largest text counts. ``drain`` with the key
    gives each key's present row; those not expired equal ``fresh_values`` at the clock's time.
    """
    spark = stream.sparkSession
    width = int(spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {ttl})")).first()[0])
    out = keyed(stream.withWatermark(ts, delay), key, Fresh(key, value, ts, width), "_value string, _us long, expired boolean", "EventTime")
    return out.select(*key, F.col("_value").alias(value), F.timestamp_micros("_us").alias(ts), "expired")


def fresh_values(df: DataFrame, key: list[str], ts: str, ttl: str, now: Column) -> DataFrame:
    """The freshest row of each key that is not older than the time to live."""
    young = df.where(F.col(ts) >= now - F.expr(f"interval {ttl}"))
    return young.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(ts)))).where("_n = 1").drop("_n")


class RunningCost(StatefulProcessor):
    """A key's total since its last reset, and when that was."""

    def __init__(self, key: str, order: list[str], amount: str, reset: str) -> None:
        self.key, self.order, self.amount, self.reset = key, order, amount, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cost", "total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (total,) = self.state.get() if self.state.exists() else (0.0,)
        # rows of one key and batch: a reset makes what lies before it worthless, so only the last one's successors are kept
        for batch in [pd.concat(rows)]:
            batch = batch.sort_values(self.order, kind="stable")
            resets = batch[self.reset].fillna(False).astype(bool).to_numpy()
            if resets.any():
                total, batch = 0.0, batch.iloc[len(resets) - resets[::-1].argmax() :]
            total += float(batch[self.amount].fillna(0.0).astype(float).sum())
        self.state.update((total,))
        yield _frame([self.key], key, [(total,)], ["total"])

    def close(self) -> None:
        pass


def stream_running_cost(stream: DataFrame, key: str, order: list[str], amount: str, reset: str, trigger: dict | None = None, folder: str | None = None) -> DataFrame:
    """Each key's sum of amounts since its last reset, once the source is read.

    Batches come in the order of time; inside a batch, rows are ordered by ``order``. A key's total is one value of
    keyed state; a batch writes the keys that it touches. ``folder`` as in ``drain``: a job that is started again goes on from
    its totals, and gives them all if nothing new has come.
    """
    out = keyed(stream.select(key, *order, amount, reset), [key], RunningCost(key, order, amount, reset), "total double")
    return drain(out, "running-cost", "update", [key], trigger, folder)


def stream_route(stream: DataFrame, rules: dict[str, Column], put: Callable[[str, DataFrame, int], None], folder: str):
    """Starts a query that gives each batch's rows to every rule they meet, and the others to ``default``.

    ``put`` gets the output's name, the rows and the batch's number; a batch may come again after a loss, so it
    should replace what it wrote under that number, as ``route_to`` does.
    """

    def route(batch: DataFrame, i: int) -> None:
        met = F.lit(False)
        for name, rule in rules.items():
            hit = F.coalesce(rule, F.lit(False))
            put(name, batch.where(hit), i)
            met = met | hit
        put("default", batch.where(~met), i)

    return stream.writeStream.option("checkpointLocation", folder).foreachBatch(route).trigger(availableNow=True).start()


def route_to(stream: DataFrame, rules: dict[str, Column], folder: str) -> DataFrame:
    """All rows that the stream gives until its source is read, once for each output they go to (column ``output``).

    Each output and batch is a folder of its own that a batch replaces as a whole, so one that runs again leaves no
    row twice; a job started again with the same folder adds what is new.
    """
    spark = stream.sparkSession

    def put(name: str, batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/output={name}/batch={i}")

    stream_route(stream, rules, put, f"{folder}/state").awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/output=default/batch=-1")
    schema = StructType([*stream.schema.fields, StructField("output", StringType()), StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out").drop("batch")
