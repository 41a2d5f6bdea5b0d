"""Workflow documents, boards, answers and scores: reading, checking, and the forms in which they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import col, or_else
from .heads import read_heads

DOCUMENT = """version double, name string,
  nodes array<struct<id: string, type: string, position: struct<x: double, y: double>, data: string>>,
  edges array<struct<id: string, source: string, target: string, sourceHandle: string, targetHandle: string>>"""

#: The listing's depth, skipped folders and the bytes it looks at.
MAX_DEPTH, HEAD_BYTES = 3, 1024
SKIPPED = ("node_modules", "__pycache__")
#: The longest preview and the mark behind a cut text.
PREVIEW, CUT = 90_000, "\n[…truncated]"
#: Extensions by priority, with their content types.
MEDIA = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif",
    "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime",
    "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac",
}


def read_workflows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all documents at a path; raw line breaks inside strings are allowed, and ``data`` stays JSON."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True, allowUnquotedControlChars=True, recursiveFileLookup=True)
    docs = docs.select(F.col("_metadata.file_path").alias("workflow_id"), "nodes", "edges")
    nodes = docs.select("workflow_id", F.posexplode("nodes").alias("ord", "n"))
    nodes = nodes.select("workflow_id", F.col("n.id").alias("node_id"), "n.type", F.col("n.position.x").alias("x"), F.col("n.position.y").alias("y"), "n.data", "ord")
    edges = docs.select("workflow_id", F.posexplode("edges").alias("ord", "e"))
    edges = edges.select("workflow_id", F.col("e.id").alias("edge_id"), "e.source", "e.target", F.col("e.sourceHandle").alias("source_handle"), F.col("e.targetHandle").alias("target_handle"), "ord")
    return nodes, edges


def list_documents(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(name, directory, modified) of one document for each folder, newest first.

    The first JSON file of a folder whose head names a version and nodes counts; HEAD_BYTES of each are
    read. Hidden and vendor folders, and those deeper than ``max_depth``, are left out.
    """
    files = read_heads(spark, root, suffix=".json", depth=max_depth, skipped=",".join(SKIPPED), bytes=HEAD_BYTES)
    files = files.select("path", "modified", F.make_valid_utf8(F.col("head").cast("string")).alias("head"), F.regexp_replace("path", "/[^/]*$", "").alias("directory"))
    files = files.where(F.col("head").contains('"version"') & F.col("head").contains('"nodes"'))
    first = files.groupBy("directory").agg(F.min_by(F.struct("head", "modified"), "path").alias("f")).select("directory", "f.*")
    name = or_else(F.regexp_extract("head", r'"name"\s*:\s*"([^"]*)"', 1), F.regexp_extract("directory", "([^/]*)$", 1))
    return first.select(name.alias("name"), "directory", "modified").orderBy(F.desc("modified"))


def newest_valid(files: DataFrame, directory: str = "directory", text: str = "text", modified: str = "modified") -> DataFrame:
    """The newest row of each directory whose text is JSON with a number as version and arrays of nodes and edges."""
    v = F.try_parse_json(col(text))
    kinds = [F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant")) for p in ("version", "nodes", "edges")]
    ok = kinds[0].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & kinds[1].startswith("ARRAY") & kinds[2].startswith("ARRAY")
    w = Window.partitionBy(directory).orderBy(F.desc(modified), text)
    return files.where(ok).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scan_boards(df: DataFrame, columns: list[str], data: str, order: list[Column], client: Column | None = None) -> DataFrame:
    """Columns and whether the row holds data, in order; only one client's where a condition is given."""
    out = df if client is None else df.where(client)
    return out.orderBy(*order).select(*columns, (F.coalesce(col(data), F.lit("")) != "").alias("has_workflow_data"))


def images_for_board(df: DataFrame, parent: str, key: str, blob: str, order: str) -> DataFrame:
    """Each parent's map from key to blob; of equal keys the last by ``order`` stays, of equally late ones the largest blob. The blobs of one parent make one row, so they must fit it; give references where they are large (``externalize``)."""
    last = df.where(F.col(key).isNotNull()).groupBy(parent, key).agg(F.max_by(blob, F.struct(order, blob)).alias(blob))
    return last.groupBy(parent).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, blob)))).alias("images"))


def retain_sessions(df: DataFrame, session: str, ts: str, n: int = 10) -> DataFrame:
    """Rows of the n newest sessions; the short list of sessions is broadcast."""
    keep = df.groupBy(session).agg(F.max(ts).alias("_t")).orderBy(F.desc("_t"), session).limit(n).select(session)
    return df.join(F.broadcast(keep), session, "left_semi")


def write_sessions(df: DataFrame, session: str, ts: str, folder: str, mirror: str | None = None, n: int = 10) -> DataFrame:
    """The n newest sessions as JSON in a folder and, where given, in a second one; returns the rows that were written."""
    kept = retain_sessions(df, session, ts, n)
    for place in filter(None, (folder, mirror)):
        kept.write.mode("overwrite").json(place)
    return kept


def read_clients(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """All records of all exported pages ({records: [{id, fields}]}) at a path: id, the fields as text, and the page's file."""
    cells = ", ".join(f"`{f}`: string" for f in fields)
    pages = spark.read.schema(f"records array<struct<id: string, fields: struct<{cells}>>>").json(path, multiLine=True, recursiveFileLookup=True)
    rows = pages.select(F.col("_metadata.file_name").alias("page"), F.explode("records").alias("r"))
    return rows.select("page", F.col("r.id").alias("id"), *[F.col("r.fields")[f].alias(f) for f in fields])


def resolve_media(ids: DataFrame, files: DataFrame, id_: str = "id") -> DataFrame:
    """Each id's file by the priority of extensions, its content type, and whether none was found."""
    order = F.create_map(*[F.lit(x) for i, e in enumerate(MEDIA) for x in (e, i)])
    kind = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    found = files.withColumn("_p", F.try_element_at(order, F.col("ext"))).where("_p is not null")
    found = found.groupBy(id_).agg(F.min_by("ext", "_p").alias("ext"))
    return ids.join(found, id_, "left").withColumns({"content_type": F.try_element_at(kind, F.col("ext")), "not_found": F.col("ext").isNull()})


def split_raw_preview(answers: DataFrame, text: str = "text", limit: int = PREVIEW) -> tuple[DataFrame, DataFrame]:
    """(rows as they are, rows with long texts cut and lists of citations and competitors as text)."""
    t = F.col(text)
    short = {text: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(CUT))).otherwise(t)}
    if "citations" in answers.columns:
        short["citations"] = F.concat_ws("\n", F.transform("citations", lambda c: c["url"]))
    if "competitors_mentioned" in answers.columns:
        short["competitors_mentioned"] = F.concat_ws(", ", "competitors_mentioned")
    return answers, answers.withColumns(short)


def encode_scores(scores: DataFrame, nested: list[str]) -> DataFrame:
    return scores.withColumns({c: F.to_json(c) for c in nested})


def decode_scores(scores: DataFrame, nested: list[str], brands: DataFrame | None = None, of: str = "map<string,double>") -> DataFrame:
    """JSON columns as maps, empty where the JSON is missing or bad; with the brand's name, if brands are given."""
    empty = F.create_map().cast(of)
    out = scores.withColumns({c: F.coalesce(F.from_json(F.when(F.try_parse_json(col(c)).isNotNull(), col(c)), of), empty) for c in nested})
    if brands is None:
        return out
    return out.join(brands.select("brand_id", "brand_name"), "brand_id", "left").withColumn("brand_name", or_else("brand_name", "Unknown Brand"))
