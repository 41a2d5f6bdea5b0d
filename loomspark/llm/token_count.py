"""Token counts of whole texts by rank-synchronous merging (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import chunks, text_buffers

LIMIT = 2048


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A worker takes texts in chunks of bounded size, holds their not yet known pre-tokens as ragged
    arrays and merges each one's lowest-rank pair in all of them at once until none is left; the
    surviving symbols are counted. Map-only: no shuffle, work in proportion to the text.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = encoder(vocabulary)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for first, last in chunks(offsets):
                part = batch.slice(first, last - first)
                n = merger.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
