"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that one vectorised step holds in a Python worker at once.
CHUNK_BYTES = 250_000


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the cluster's shared checkpoint folder and read it again.

    Cuts the lineage, so a lost executor costs a re-read instead of a recomputation. The folder is
    ``spark.checkpoint.dir``; where that is unset, a temporary local one is taken on a single machine (tests),
    and a cluster is refused.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        column = column.fill_null(empty)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (first, last) of rows whose bytes stay below ``most``; one longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Flat indices of the runs [start, start + len)."""
    lens = np.asarray(lens, np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A string or binary Arrow array over a flat buffer, without a copy per row."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
