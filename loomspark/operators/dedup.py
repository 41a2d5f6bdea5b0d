"""Keep-first deduplication, content addressing, upserts and windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import col, slug, squeeze, trim_all


def keep_first(df: DataFrame, key: Column, ord_: list[str | Column], blank_ok: bool = True) -> DataFrame:
    """The first row of each key by ``ord_``; rows with a blank key are dropped unless ``blank_ok``.

    As only the first row is asked for, Spark keeps one row a key and task before the shuffle (WindowGroupLimit), so
    a key that many rows share costs no task more than others.
    """
    out = df.withColumn("_k", key)
    if not blank_ok:
        out = out.where(F.coalesce(F.col("_k"), F.lit("")) != "")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*ord_))).where("_n = 1").drop("_k", "_n")


def dedup_text(df: DataFrame, text: str, ord_: list[str]) -> DataFrame:
    return keep_first(df, squeeze(text), ord_)


def dedup_url(df: DataFrame, url: str, ord_: list[str], blank_ok: bool = False) -> DataFrame:
    return keep_first(df, col(url), ord_, blank_ok)


def dedup_name(df: DataFrame, name: str, ord_: list[str]) -> DataFrame:
    return keep_first(df, F.lower(trim_all(name)), ord_, blank_ok=False)


def dedup_hash(df: DataFrame, content: str, ord_: list[str]) -> DataFrame:
    return keep_first(df, F.md5(col(content)), ord_)


def duplicate_ids(df: DataFrame, keys: list[str], ord_: list[str | Column]) -> DataFrame:
    """Every row after the first of its key."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*ord_))).where("occurrence > 1")


def write_content_addressed(df: DataFrame, content: Column, extension: Column, name: str, ord_: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Each row's hash, file name and whether the content is there already, earlier in the batch or in ``existing``(hash, ext)."""
    out = df.withColumns({"hash": F.md5(content), "ext": extension})
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy("hash", "ext").orderBy(*ord_)))
    seen = F.col("_n") > 1
    if existing is not None:
        out = out.join(existing.select("hash", "ext").distinct().withColumn("_e", F.lit(True)), ["hash", "ext"], "left")
        seen = seen | F.coalesce(F.col("_e"), F.lit(False))
    out = out.withColumns({"is_duplicate": seen, "file_name": F.concat(slug(name), F.lit("_"), F.col("hash"), F.lit("."), F.col("ext"))})
    return out.drop("_n", "_e")


def externalize(df: DataFrame, blob: str, folder: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a reference in place of the blob, one stored copy for each reference)."""
    ref = F.when(col(blob).isNotNull(), F.md5(F.concat_ws("/", folder, col(blob))))
    marked = df.withColumn("ref", ref)
    return marked.drop(blob), marked.where("ref is not null").select("ref", blob).dropDuplicates(["ref"])


def hydrate(df: DataFrame, store: DataFrame) -> DataFrame:
    return df.join(store, "ref", "left")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row for each key: the last of the updates, else the target's."""
    both = target.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_u"), F.desc(order_col))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_u")


def patch(target: DataFrame, changes: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Non-null fields of ``changes`` replace the target's, which is then marked as updated."""
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(renamed, key, "left")
    fresh = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    return joined.withColumns(fresh | {"updated_at": F.when(F.col("_hit"), now)}).drop("_hit", *[f"_{c}" for c in columns])


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(F.col(parent_key))
    return parents.join(ids, parent_key, "left_anti"), children.join(ids, children[child_key] == ids[parent_key], "left_anti")


def newest_n(df: DataFrame, key: list[str], id_: str, ts: list[str], n: int) -> DataFrame:
    """The n newest different ids of each key; an id that comes again moves to the front."""
    latest = Window.partitionBy(*key, id_).orderBy(*[F.desc(c) for c in ts])
    out = df.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in ts]))).where(F.col("place") <= n)


def quota(df: DataFrame, category: str, limits: DataFrame, ord_: list[str]) -> DataFrame:
    """The first rows of each category up to its limit, with whether the category falls short."""
    w = Window.partitionBy(category)
    out = df.join(limits, category).withColumns({"place": F.row_number().over(w.orderBy(*ord_)), "short": F.count("*").over(w) < F.col("quota")})
    return out.where(F.col("place") <= F.col("quota"))


def batch_chunks(df: DataFrame, key: list[str], size: int, ord_: list[str]) -> DataFrame:
    if size < 1:
        raise ValueError("size must be at least 1")
    w = Window.partitionBy(*key)
    n = F.row_number().over(w.orderBy(*ord_))
    return df.withColumns({"item": n, "items": F.count("*").over(w), "chunk": F.floor((n - 1) / size)})


def neighbours(df: DataFrame, key: list[str], id_: str, ord_: list[str]) -> DataFrame:
    """Place, number of rows, and the previous and next id, round the ends."""
    w = Window.partitionBy(*key).orderBy(*ord_)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        "place": F.row_number().over(w), "of": F.count("*").over(whole),
        "previous": F.coalesce(F.lag(id_).over(w), F.last(id_).over(whole)), "next": F.coalesce(F.lead(id_).over(w), F.first(id_).over(whole)),
    })
