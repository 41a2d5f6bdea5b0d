"""BPE encoding of texts to ids and decoding of ids to texts (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, loaded
from .common import binary_array, chunks, list_array, text_buffers

#: Ids that one step of decoding holds.
DECODED = 150_000


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = encoder(vocabulary)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for first, last in chunks(offsets):
                part = batch.slice(first, last - first)
                ids, lens = merger.encode(part.column(1).to_pylist())
                upto = np.concatenate([[0], np.cumsum(lens)])
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, upto, pa.int32())], ["doc_id", "ids"])

    return run


def _decoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(vocabulary)
        for batch in batches:
            column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offs = np.asarray(column.offsets)
            offs = offs - offs[0] if len(offs) else np.zeros(1, np.int64)
            ids = np.asarray(column.flatten())
            for first, last in chunks(offs.astype(np.int64), DECODED):
                flat, sizes = v.decode(ids[offs[first] : offs[last]], np.diff(offs[first : last + 1]).astype(np.int64))
                upto = np.concatenate([[0], np.cumsum(sizes)])
                text = binary_array(flat, upto, pa.string())
                try:
                    text.validate(full=True)
                except pa.ArrowInvalid:
                    raw = flat.tobytes()
                    text = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.string())
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["doc_id", "ids", "decoded"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, an array of the token ids of the whole text.

    Merge rounds run over one flat array with the symbols of many words; pairs are looked up by binary
    search over sorted pair keys. Null and empty texts have an empty array. Ids, repeated rows and
    other columns are treated as in ``token_count.count_tokens``.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_encoded(vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded, the text of an ``ids`` array; bytes that are no UTF-8 come as U+FFFD.

    A null array decodes to the empty text.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(vocabulary), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded of every row: ``decode`` of ``encode``, both in one worker."""
    there, back = _encoded(vocabulary), _decoded(vocabulary)
    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)), "doc_id long, ids array<int>, decoded string")
