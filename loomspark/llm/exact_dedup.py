"""Exact deduplication by content hash with a comparison of bytes (operator 13), in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Slots of the bitmap that marks hashes met more than once: 512 rows of 4 KB, whatever the table's size.
SLOTS = 1 << 24
#: A group of more than this share of all rows is joined by a broadcast; there are fewer than its inverse.
HOT_SHARE = 0.001


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(h: str) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(SLOTS)) + 1


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: its size, its smallest id, and the row that stays. Partial sums come before the shuffle."""
    stays = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return durable(rows.groupBy(*by).agg(F.min("doc_id").alias("keep_id"), stays.alias("keep_row"), F.count("*").alias("group_size")), "dedup-groups")


def _members(rows: DataFrame, groups: DataFrame, by: list[str], hot: int) -> DataFrame:
    """Every row with its group. Groups above ``hot`` rows are few and go to every task, so no key of the shuffled join has more rows than that."""
    large = F.broadcast(groups.where(F.col("group_size") > hot))
    names = ("keep_id", "keep_row", "group_size")
    met = rows.join(large.withColumnsRenamed({c: f"large_{c}" for c in names}), by, "left")
    found = met.where("large_group_size is not null").select(*rows.columns, *[F.col(f"large_{c}").alias(c) for c in names])
    rest = met.where("large_group_size is null").select(*rows.columns).join(groups.where(F.col("group_size") <= hot), by)
    out = found.unionByName(rest.select(*rows.columns, *names))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their ``normalised`` bytes are. Rows are grouped by a 128-bit hash, and of each
    group the row with the smallest id stays. Bytes are compared by a grouping on hash and text: only of
    texts whose hash falls in a slot of a fixed bitmap that some repeated hash has set, and copies
    merge before the shuffle, so each task sends a text once. A hash with more than one text (a
    collision) is split: its rows are grouped again by hash and text. Whole texts travel nowhere else.

    A null text counts as empty. Rows without an id come last: one stays only in a group where no row has an id, with a null
    keep_id. Of rows that repeat the smallest id, one stays. Other columns are ignored; an empty table
    gives no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    own = own.withColumn("hash", digest(F.col("norm")))
    keyed = own.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex("hash").alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    keyed = durable(keyed, "dedup-rows")
    groups = _groups(keyed, ["hash"])
    n = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = max(1, int(n * HOT_SHARE))
    apart = durable(_collided(own.withColumn("hash", F.unhex("hash")), groups), "dedup-collided")
    if apart.isEmpty():
        return _members(keyed, groups, ["hash"], hot)
    whole = own.withColumn("hash", F.unhex("hash")).join(apart, "hash", "left_semi")
    whole = durable(whole.select("doc_id", F.monotonically_increasing_id().alias("row"), "hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm"), "dedup-whole")
    plain = _members(keyed.join(apart, "hash", "left_anti"), groups.join(apart, "hash", "left_anti"), ["hash"], hot)
    return plain.unionByName(_members(whole, _groups(whole, ["hash", "norm"]), ["hash", "norm"], hot))


def _collided(own: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes with more than one text."""
    marks = groups.where("group_size > 1").select(F.bitmap_bucket_number(_slot("hash")).alias("bucket"), F.bitmap_bit_position(_slot("hash")).alias("bit"))
    marks = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = F.bitmap_bit_position(_slot("hash"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    asked = own.withColumn("bucket", F.bitmap_bucket_number(_slot("hash"))).join(F.broadcast(marks), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    texts = asked.groupBy("hash", "norm").agg(F.lit(1).alias("one"))
    return texts.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")
