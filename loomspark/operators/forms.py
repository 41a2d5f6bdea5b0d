"""Cells of documents in other forms: placeholders for blobs, private contexts, defaults, citations, prompts, data URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import col

#: Fields that hold blobs by type of node, and fields that are left out.
BLOBS = {
    "imageInput": ["image"],
    "annotation": ["sourceImage", "outputImage"],
    "nanoBanana": ["inputImages", "outputImage"],
    "generateVideo": ["inputImages", "outputVideo"],
    "llmGenerate": ["inputImages"],
    "splitGrid": ["sourceImage"],
    "output": ["image", "video"],
}
LEFT_OUT = ["imageHistory", "videoHistory", "selectedHistoryIndex", "selectedVideoHistoryIndex", "imageRef", "outputImageRef", "sourceImageRef", "inputImageRefs", "outputVideoRef"]
#: Extensions of media types, those of a type's family, and those that count in addresses.
EXTENSIONS = {
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov",
    "model/gltf-binary": "glb", "model/gltf+json": "gltf", "model/obj": "obj", "model/vnd.usdz+zip": "usdz", "model/fbx": "fbx", "model/stl": "stl",
    "audio/mpeg": "mp3", "audio/wav": "wav", "audio/ogg": "ogg", "audio/flac": "flac", "audio/aac": "aac",
}
FAMILIES = {"image/": "png", "video/": "mp4", "model/": "glb", "audio/": "mp3"}
IN_ADDRESSES = ["glb", "gltf", "obj", "fbx", "usdz", "stl", "ply", "png", "jpg", "jpeg", "gif", "webp", "svg", "mp4", "webm", "mov"]
VIDEO_HINTS = [".mp4", ".webm", "fal.media"]
#: A prompt in a log is cut here.
PROMPT_LENGTH, CUT = 200, "...[truncated]"

_MAP = "map<string,string>"


def _kb(c: Column) -> Column:
    return F.floor(F.length(c) * 3 / 4 / 1024 + 0.5).cast("string")


def strip_blobs(nodes: DataFrame, data: str = "data") -> DataFrame:
    """Nodes whose JSON data became a map of text: histories and references left out, blobs as ``[image: context, nKB]``, lists of them as their number.

    The context is the chosen model's name or the size of an input image; null blobs stay null.
    """
    cells = F.coalesce(F.from_json(data, _MAP), F.create_map().cast(_MAP))
    model, size = F.get_json_object(data, "$.selectedModel.displayName"), F.concat_ws("x", F.get_json_object(data, "$.dimensions.width"), F.get_json_object(data, "$.dimensions.height"))
    context = F.when(F.col("type").isin("nanoBanana", "generateVideo"), model).when(F.col("type") == "imageInput", F.nullif(size, F.lit("")))
    blobs = F.try_element_at(F.create_map(*[x for k, v in BLOBS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("type"))

    def placeholder(k: Column, v: Column) -> Column:
        many = F.from_json(v, "array<string>")
        kind = F.when(F.lower(k).contains("video"), "video").otherwise("image")
        one = F.concat(F.lit("["), kind, F.lit(": "), F.coalesce(F.concat(context, F.lit(", ")), F.lit("")), _kb(v), F.lit("KB]"))
        return F.when(v.isNull(), v).when(v.startswith("["), F.when(F.size(many) > 0, F.concat(F.lit("["), F.size(many).cast("string"), F.lit(" image(s)]"))).otherwise("[no images]")).otherwise(one)

    kept = F.map_filter(cells, lambda k, v: ~k.isin(*LEFT_OUT))
    return nodes.withColumn(data, F.transform_values(kept, lambda k, v: F.when(F.coalesce(F.array_contains(blobs, k), F.lit(False)), placeholder(k, v)).otherwise(v)))


def image_metadata(uri: str | Column) -> Column:
    """A data URL as JSON of its format and size, without its content."""
    u = col(uri)
    kind, content = F.regexp_extract(u, r"^data:image/(\w+);base64,(.+)$", 1), F.regexp_extract(u, r"^data:image/(\w+);base64,(.+)$", 2)
    size = F.floor(F.length(content) * 0.75 / 1024 + 0.5).cast("int")
    return F.when(kind == "", F.lit('{"error":"Invalid image data URI"}')).otherwise(F.to_json(F.struct(kind.alias("format"), size.alias("sizeKB"), F.lit(True).alias("isDataURI"))))


def sanitize_context(context: str | Column, depth: int = 2) -> Column:
    """A log's context (JSON) as a map of text, its prompts cut and its images replaced by what they are; objects inside too, ``depth`` deep; lists of other things stay."""
    cells = F.coalesce(F.from_json(col(context), _MAP), F.create_map().cast(_MAP))

    def safe(k: Column, v: Column) -> Column:
        images = F.from_json(v, "array<string>")
        each = F.to_json(F.transform(images, lambda x: F.when(x.startswith("data:image"), image_metadata(x)).otherwise(x)))
        image = F.when(v.startswith("data:image"), image_metadata(v)).when(v.startswith("["), each).otherwise(v)
        prompt = F.when(F.length(v) > PROMPT_LENGTH, F.concat(F.substring(v, 1, PROMPT_LENGTH), F.lit(CUT))).otherwise(v)
        inner = F.to_json(sanitize_context(v, depth - 1)) if depth > 1 else v
        return F.when(k == "prompt", prompt).when(k.isin("image", "images"), image).when(v.startswith("{"), inner).otherwise(v)

    return F.transform_values(cells, safe)


def merge_defaults(nodes: DataFrame, defaults: DataFrame, data: str = "data") -> DataFrame:
    """Nodes whose map ``data`` got what their type's ``defaults`` (type, data) hold and they do not; own values, also null ones, stay."""
    own = F.coalesce(F.col(data), F.create_map().cast(_MAP))
    more = F.map_filter(F.coalesce("_defaults", F.create_map().cast(_MAP)), lambda k, v: ~F.map_contains_key(own, k))
    given = defaults.select("type", F.col("data").alias("_defaults")).dropDuplicates(["type"])
    return nodes.join(given, "type", "left").withColumn(data, F.map_concat(more, own)).drop("_defaults")


_CITATION = "struct<url:string,title:string,snippet:string>"


def normalize_citations(raw: str | Column, shape: str) -> Column:
    """Citations of an answer (JSON) as array<struct<url,title,snippet>>, each url once, without blank ones.

    ``annotations``: a list of {url, title} or {url_citation: {url, title}}. ``results``: search_results, else
    citations as a list of urls. ``chunks``: groundingChunks of {web: {uri, title}}.
    """
    c, none = col(raw), F.lit(None).cast("string")
    made = lambda u, t, s: F.struct(u.alias("url"), t.alias("title"), s.alias("snippet"))
    if shape == "annotations":
        rows = F.from_json(c, "array<struct<url:string,title:string,url_citation:struct<url:string,title:string>>>")
        out = F.transform(rows, lambda r: made(F.coalesce(r["url"], r["url_citation"]["url"]), F.coalesce(r["title"], r["url_citation"]["title"]), none))
    elif shape == "results":
        body = F.from_json(c, f"struct<search_results:array<{_CITATION}>,citations:array<string>>")
        out = F.coalesce(body["search_results"], F.transform(body["citations"], lambda u: made(u, none, none)))
    elif shape == "chunks":
        body = F.from_json(c, "struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>>")
        out = F.transform(body["groundingChunks"], lambda r: made(r["web"]["uri"], r["web"]["title"], none))
    else:
        raise ValueError(f"no shape {shape}")
    out = F.filter(F.coalesce(out, F.array().cast(f"array<{_CITATION}>")), lambda x: F.coalesce(x["url"], F.lit("")) != "")
    urls = F.transform(out, lambda x: x["url"])
    return F.filter(out, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def normalize_prompts(prompts: str | Column, n: int = 3) -> Column:
    """The first n of a list (JSON) of prompts, each a text or an object whose parts become sentences, the mood named."""
    def one(p: Column) -> Column:
        part = lambda f: F.nullif(F.get_json_object(p, f"$.{f}"), F.lit(""))
        mood = F.concat(F.lit("Mood: "), part("mood"))
        return F.when(p.startswith("{"), F.concat_ws(". ", part("openingShot"), part("movementAction"), part("closingShot"), mood)).otherwise(p)

    return F.transform(F.slice(F.coalesce(F.from_json(col(prompts), "array<string>"), F.array().cast("array<string>")), 1, n), one)


def parse_data_url(c: str | Column) -> Column:
    """struct(mime, content, size_kb) of a data URL; null for anything else."""
    u, pattern = col(c), r"(?s)^data:([^;]+);base64,(.+)$"
    content = F.regexp_extract(u, pattern, 2)
    return F.when(u.rlike(pattern), F.struct(F.regexp_extract(u, pattern, 1).alias("mime"), content.alias("content"), F.floor(F.length(content) * 0.75 / 1024 + 0.5).cast("int").alias("size_kb")))


def mime_to_ext(c: str | Column) -> Column:
    m, known = col(c), F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    family = reduce(lambda out, f: F.when(m.startswith(f), FAMILIES[f]).otherwise(out), FAMILIES, F.lit("bin"))
    return F.coalesce(F.try_element_at(known, m), family)


def url_ext(c: str | Column) -> Column:
    """The extension in an address's path if it is one of a known medium, else null."""
    ext = F.lower(F.regexp_extract(F.try_parse_url(col(c), F.lit("PATH")), r"\.([^.]+)$", 1))
    return F.when(ext.isin(*IN_ADDRESSES), ext)


def output_kind(audio: str | Column, videos: str | Column, images: str | Column) -> Column:
    """struct(kind, content) of lists of media: audio before video before image; an image that looks like a video is one."""
    first = lambda c: F.try_element_at(col(c), F.lit(1))
    a, v, i = first(audio), first(videos), first(images)
    moving = i.startswith("data:video/") | reduce(Column.__or__, [i.contains(h) for h in VIDEO_HINTS])
    kind = F.when(a.isNotNull(), "audio").when(v.isNotNull(), "video").when(i.isNotNull(), F.when(moving, "video").otherwise("image"))
    return F.struct(kind.alias("kind"), F.coalesce(a, v, i).alias("content"))


def first_pair(items: str | Column) -> Column:
    """struct(a, b) of a list's first two items, null where there are none."""
    c = col(items)
    return F.struct(F.try_element_at(c, F.lit(1)).alias("a"), F.try_element_at(c, F.lit(2)).alias("b"))


#: Fields that a proposal's parts need, and values that they may have.
PROPOSED_TYPES = ["imageInput", "annotation", "prompt", "nanoBanana", "generateVideo", "llmGenerate", "splitGrid", "output"]
CONNECTIONS, COLORS, COMPLEXITY = ["image", "text", "reference"], ["neutral", "blue", "green", "purple", "orange"], ["simple", "moderate", "complex"]


def proposal_errors(proposals: DataFrame, nodes: DataFrame, connections: DataFrame, groups: DataFrame, key: str = "proposal_id") -> DataFrame:
    """(key, message): the first thing wrong with each proposal, in the order of its parts.

    ``proposals``: name, description, complexity. ``nodes``: ord, id, type, purpose, title. ``connections``: ord,
    from_id, to_id, type, description. ``groups``: ord, name, color, has_nodes, purpose.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = lambda c, allowed: F.coalesce(~F.col(c).isin(*allowed), F.lit(True))
    at = lambda kind, text: F.concat(F.lit(f"{kind}["), F.col("ord").cast("string"), F.lit("]" + text))

    def found(df: DataFrame, part: int, rules: list[tuple[Column, Column]]) -> DataFrame:
        place = F.col("ord") if "ord" in df.columns else F.lit(0)
        message = reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), reversed(rules), F.lit(None).cast("string"))
        return df.select(key, F.lit(part).alias("part"), place.cast("long").alias("place"), message.alias("message")).where("message is not null")

    ids = nodes.select(key, "id").where("id is not null").distinct()
    linked = connections
    for end in ("from_id", "to_id"):
        linked = linked.join(ids.select(key, F.col("id").alias(end), F.lit(True).alias(f"{end}_known")), [key, end], "left")
    need = lambda kind, field, name: (blank(field), at(kind, f" must have {name} (string)"))
    unknown = lambda end, name: (F.col(f"{end}_known").isNull(), F.concat(at("connections", f".{name} references unknown node: "), F.col(end)))
    all_ = [
        found(proposals, 0, [(blank("name"), F.lit("Proposal must have a name (string)")), (blank("description"), F.lit("Proposal must have a description (string)"))]),
        found(nodes, 1, [need("nodes", "id", "an id"), (bad("type", PROPOSED_TYPES), at("nodes", f" must have a valid type ({', '.join(PROPOSED_TYPES)})")), need("nodes", "purpose", "a purpose"), need("nodes", "title", "a suggestedTitle")]),
        found(linked, 2, [need("connections", "from_id", "a 'from'"), need("connections", "to_id", "a 'to'"), (bad("type", CONNECTIONS), at("connections", f" must have a valid type ({', '.join(CONNECTIONS)})")), need("connections", "description", "a description"), unknown("from_id", "from"), unknown("to_id", "to")]),
        found(groups, 3, [need("groups", "name", "a name"), (bad("color", COLORS), at("groups", f" must have a valid color ({', '.join(COLORS)})")), (~F.coalesce(F.col("has_nodes"), F.lit(False)), at("groups", " must have a nodeIds array")), need("groups", "purpose", "a purpose")]),
        found(proposals, 4, [(bad("complexity", COMPLEXITY), F.lit(f"estimatedComplexity must be one of: {', '.join(COMPLEXITY)}"))]),
    ]
    w = Window.partitionBy(key).orderBy("part", "place")
    return reduce(DataFrame.union, all_).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "message")


def flatten_ok(branches: DataFrame, key: list[str], results: str, error: str) -> DataFrame:
    """The results of branches without an error, one row each, in order (``ord``)."""
    return branches.where(F.col(error).isNull()).select(*key, F.posexplode(results).alias("ord", "result"))


def same_ids(a: DataFrame, b: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Of each key whether both tables hold the same ids."""
    one, two = (x.select(*key, id_).distinct().withColumn(n, F.lit(True)) for x, n in ((a, "_a"), (b, "_b")))
    return one.join(two, [*key, id_], "full").groupBy(*key).agg(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("same"))


def beyond(df: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """Rows that are not among those kept."""
    return df.join(kept.select(*key).distinct(), key, "left_anti")

