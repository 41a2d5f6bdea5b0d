"""Model catalogs: normalising, search, facets and recent items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import col, or_else, trim_all

#: What each facet of the catalog search stands for.
FACETS = {
    "image": ["text-to-image", "image-to-image"],
    "video": ["text-to-video", "image-to-video", "audio-to-video"],
    "3d": ["text-to-3d", "image-to-3d"],
    "audio": ["text-to-audio"],
}


#: Categories of models that count, and the audio ones that are renamed.
CATEGORIES = ["text-to-image", "image-to-image", "text-to-video", "image-to-video", "text-to-3d", "image-to-3d", "text-to-speech", "text-to-music", "text-to-sound-effects", "audio-to-video"]
AUDIO = ["text-to-speech", "text-to-music", "text-to-sound-effects"]
#: Words by which a model's capability is told, in two variants of catalogs.
KEYWORDS = {
    "short": {
        "3d": ["3d", "mesh", "triposr", "tripo", "hunyuan3d", "instant-mesh", "point-e", "shap-e"],
        "audio": ["music", "audio", "tts", "text-to-speech", "speech", "sound effect", "voice", "bark", "xtts"],
        "video": ["video", "animate", "motion", "luma", "kling", "minimax"],
        "edit": ["img2img", "image-to-image", "inpaint", "controlnet", "upscale", "restore"],
    },
    "long": {
        "3d": ["3d", "mesh", "tripo", "hunyuan3d"],
        "audio": ["music", "audio", "tts", "text-to-speech", "speech", "sound effect", "voice"],
        "video": ["video", "animate", "motion", "wan", "kling", "luma", "minimax", "i2v", "t2v"],
        "edit": ["img2img", "image-to-image", "inpaint", "controlnet", "upscale", "edit", "kontext"],
    },
}
IMAGE_WORDS, STILL_WORDS = ["image", "img", "photo"], ["img2vid", "image-to-video", "i2v"]


def capabilities(text: Column, variant: str = "short") -> Column:
    """The capabilities that a model's text names: 3D before audio before video before image, the last with editing where it is named."""
    low, words = F.lower(text), KEYWORDS[variant]
    holds = lambda ws: reduce(Column.__or__, [low.contains(w) for w in ws])
    three = F.array(F.when(holds(IMAGE_WORDS), "image-to-3d").otherwise("text-to-3d"))
    video = F.array(F.when(holds(STILL_WORDS), "image-to-video").otherwise("text-to-video"))
    image = F.array_compact(F.array(F.lit("text-to-image"), F.when(holds(words["edit"]), F.lit("image-to-image"))))
    return F.when(holds(words["3d"]), three).when(holds(words["audio"]), F.array(F.lit("text-to-audio"))).when(holds(words["video"]), video).otherwise(image)


def normalize_catalog(df: DataFrame, shape: str, provider: str) -> DataFrame:
    """id, name, description, provider, capabilities, cover, price from one of three shapes of catalogs.

    ``owned``: owner, name, description, cover_image_url. ``endpoint``: endpoint_id, display_name,
    description, category, thumbnail_url; only categories that count. ``loose``: any of model_id, id,
    name, display_name, description, category, thumbnail_url, cover_image, amount.
    """
    have = lambda *names: [F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns]
    first = lambda *names: F.coalesce(*have(*names), F.lit(None).cast("string"))
    none = F.lit(None).cast("double")
    if shape == "owned":
        text = F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))
        cells = [F.concat_ws("/", "owner", "name"), F.col("name"), F.col("description"), capabilities(text), F.col("cover_image_url"), none]
    elif shape == "endpoint":
        df = relevant_only(df)
        cells = [F.col("endpoint_id"), F.col("display_name"), F.col("description"), F.array("capability"), F.col("thumbnail_url"), none]
    elif shape == "loose":
        text = F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (first("model_id"), first("name", "display_name"), first("description"), first("category", "type"))])
        name = F.coalesce(first("model_id", "id", "name"), F.lit("unknown"))
        cells = [name, F.coalesce(first("display_name", "name"), name), first("description"), capabilities(text, "long"), first("thumbnail_url", "cover_image"), F.coalesce(F.col("amount"), F.lit(0.0)) if "amount" in df.columns else none]
    else:
        raise ValueError(f"no shape {shape}")
    names = ["id", "name", "description", "capabilities", "cover", "price"]
    return df.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)], F.lit(provider).alias("provider"))


def relevant_only(df: DataFrame, category: str = "category") -> DataFrame:
    """Rows of the categories that count, with their capability: three audio categories are one."""
    c = F.col(category)
    return df.where(c.isin(*CATEGORIES)).withColumn("capability", F.when(c.isin(*AUDIO), "text-to-audio").otherwise(c))


def filter_category(presets: DataFrame, community: DataFrame, wanted: str = "all") -> DataFrame:
    """Presets and community rows (is_community) that a category shows: ``all`` both, ``community`` those alone, another one its presets."""
    a, b = presets.withColumn("is_community", F.lit(False)), community.withColumn("is_community", F.lit(True))
    if wanted == "community":
        return a.where("false").unionByName(b, allowMissingColumns=True)
    return a.unionByName(b, allowMissingColumns=True) if wanted == "all" else a.where(F.col("category") == wanted).unionByName(b.where("false"), allowMissingColumns=True)


def template_stats(templates: DataFrame, nodes: str = "nodes") -> DataFrame:
    return templates.withColumn("node_count", F.greatest(F.coalesce(F.size(nodes), F.lit(0)), F.lit(0)))


def union_tags(*tables: DataFrame, tags: str = "tags") -> DataFrame:
    """The different tags of all tables, sorted."""
    return reduce(DataFrame.union, [t.select(F.explode(tags).alias("tag")) for t in tables]).where("tag is not null").distinct().orderBy("tag")


def order_catalog(df: DataFrame, provider: str = "provider", name: str = "name") -> DataFrame:
    """By provider, then name, as people sort them: letters before case and accents."""
    return df.orderBy(F.expr(f"`{provider}` COLLATE UNICODE"), F.expr(f"`{name}` COLLATE UNICODE"))


def order_clients(df: DataFrame, status: str = "status", name: str = "name") -> DataFrame:
    """Active clients first, then by name."""
    return df.orderBy(F.when(F.col(status) == "Active", 0).otherwise(1), F.expr(f"`{name}` COLLATE UNICODE"))


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(ts), tie)


def source_summary(fetches: DataFrame, provider: str = "provider") -> DataFrame:
    """Of each provider: whether it answered, its number of models, whether all came from a cache, its first error; and whether all failed."""
    ok = F.bool_or(F.col("error").isNull())
    out = fetches.groupBy(provider).agg(ok.alias("success"), F.sum(F.when(F.col("error").isNull(), F.col("count")).otherwise(0)).alias("count"), F.bool_and("cached").alias("cached"), F.min("error").alias("error"))
    failed = out.agg((~F.bool_or("success")).alias("all_failed"))
    return out.crossJoin(failed)  # one row


def append_new(existing: DataFrame, incoming: DataFrame, key: str, ord_: str) -> DataFrame:
    """Incoming rows whose key is not yet there, each key once, beside the existing ones; is_new tells those that come first."""
    w = Window.partitionBy(key).orderBy(ord_)
    new = incoming.join(existing.select(key), key, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return new.withColumn("is_new", F.lit(True)).unionByName(existing.withColumn("is_new", F.lit(False)))


def find_by_name(df: DataFrame, column: str, names: DataFrame, ord_: str) -> DataFrame:
    """For each of ``names`` (name) the first row of that name, in any case."""
    wanted = names.select(F.col("name").alias("asked"), F.lower("name").alias("_name")).distinct()
    w = Window.partitionBy("asked").orderBy(ord_)
    return wanted.join(df.withColumn("_name", F.lower(F.col(column))), "_name").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_name")


def user_order(items: DataFrame, key: str, item: str, order: DataFrame, ord_: str, created: str) -> DataFrame:
    """``place`` of each item: where a key has an order (key, ids) its ids first, then the rest as they come; else by time of creation, missing as 0."""
    asked = order.select(key, F.posexplode("ids").alias("_pos", item)).groupBy(key, item).agg(F.min("_pos").alias("_pos"))
    known = order.where(F.size("ids") > 0).select(key, F.lit(True).alias("_asked")).distinct()
    rows = items.join(asked, [key, item], "left").join(known, key, "left")
    rest = F.when(F.col("_asked"), F.lit(0)).otherwise(F.coalesce(created, F.lit(0)))
    w = Window.partitionBy(key).orderBy(F.col("_pos").asc_nulls_last(), rest, ord_)
    return rows.withColumn("place", F.row_number().over(w)).drop("_pos", "_asked")


def order_params(params: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """``place`` of each parameter of a model: those in ``priority`` first, then by name."""
    w = Window.partitionBy(key).orderBy(F.when(F.col("name").isin(*priority), 0).otherwise(1), "name")
    return params.withColumn("place", F.row_number().over(w))


def order_inputs(inputs: DataFrame, key: str) -> DataFrame:
    """``place`` of each input of a model: required ones first, then images, audio, text, others, then by name."""
    kind = F.coalesce(F.nullif(F.array_position(F.array(F.lit("image"), F.lit("audio"), F.lit("text")), F.col("type")), F.lit(0)), F.lit(4))
    w = Window.partitionBy(key).orderBy(F.when(F.col("required"), 0).otherwise(1), kind, "name")
    return inputs.withColumn("place", F.row_number().over(w))


def round_robin(arrays: DataFrame, edges: DataFrame) -> DataFrame:
    """``item_index`` of the next edge from each array: its selection if valid, else one after the latest edge's, else the number of edges, modulo the items.

    ``arrays``: node_id, selected, n_items. ``edges``: source, ord, created_at, item_index.
    """
    latest = F.max_by(F.struct("item_index"), F.struct(F.coalesce("created_at", F.lit(-1)), -F.col("ord")))["item_index"]
    seen = edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("_edges"), latest.alias("_last"))
    chosen = (F.col("selected") >= 0) & ((F.col("n_items") == 0) | (F.col("selected") < F.col("n_items")))
    start = F.when(F.col("_last") >= 0, F.col("_last") + 1).otherwise(F.coalesce("_edges", F.lit(0)))
    index = F.when(chosen, F.col("selected")).when(F.col("n_items") > 0, F.pmod(start, F.greatest("n_items", F.lit(1)))).otherwise(0)
    return arrays.join(seen, "node_id", "left").withColumn("item_index", index.cast("int")).drop("_edges", "_last")


def status_text(c: str | Column) -> Column:
    """A status that is a JSON object with a name, or plain text, as text."""
    raw = col(c)
    return F.coalesce(F.when(raw.startswith("{"), F.coalesce(F.get_json_object(raw, "$.name"), F.lit(""))), raw, F.lit(""))


def merge_client_brand(clients: DataFrame, brands: DataFrame) -> DataFrame:
    """Each client with its brand: the brand table before the JSON of the client's own row before empty text.

    ``clients``: name, website, logo_url, status, brand_json. ``brands``: name, logo, primary_color, secondary_color,
    accent_color, dark_color, display_font, body_font, tagline, tone_tags; the first in order of ``ord``
    of a name, in any case, counts.
    """
    kind = "struct<brandName:string,website:string,logoUrl:string,colors:array<struct<hex:string>>,fonts:struct<display:string,body:string>,brandEssence:string,tones:array<string>>"
    j = F.from_json("brand_json", kind)
    w = Window.partitionBy(F.lower("name")).orderBy("ord")
    own = brands.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    own = own.select(F.lower("name").alias("_name"), *[F.col(c).alias(f"b_{c}") for c in own.columns if c not in ("name", "ord", "_n")])
    rows = clients.withColumn("_name", F.lower("name")).join(own, "_name", "left")
    pick = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    color = lambda i: F.try_element_at(j["colors"], F.lit(i))["hex"]
    fields = {
        "client_name": pick(F.col("name"), j["brandName"]), "website": pick(F.col("website"), j["website"]), "status": status_text("status"), "logo": pick(F.col("b_logo"), j["logoUrl"], F.col("logo_url")),
        **{f"{c}_color": pick(F.col(f"b_{c}_color"), color(i)) for i, c in enumerate(("primary", "secondary", "accent", "dark"), 1)},
        "display_font": pick(F.col("b_display_font"), j["fonts"]["display"]), "body_font": pick(F.col("b_body_font"), j["fonts"]["body"]), "tagline": pick(F.col("b_tagline"), j["brandEssence"]), "tone_tags": pick(F.col("b_tone_tags"), F.array_join(j["tones"], ", ")),
    }
    keep = [c for c in clients.columns if c not in (*fields, "name", "logo_url", "brand_json")]
    return rows.select(*keep, *[v.alias(k) for k, v in fields.items()])


def brand_context() -> Column:
    """A client's brand (columns of ``merge_client_brand``) as lines of text; what is missing is a dash."""
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—")))
    lines = [F.concat(F.lit("Brand: "), "client_name"), F.concat(F.lit("Website: "), "website"), line("Logo: ", "logo"), F.lit(""), F.lit("Colors:")]
    lines += [line(f"  {c.capitalize()}: ", f"{c}_color") for c in ("primary", "secondary", "accent", "dark")]
    lines += [F.lit(""), F.lit("Typography:"), line("  Display: ", "display_font"), line("  Body: ", "body_font"), F.lit(""), line("Tagline: ", "tagline"), line("Tone: ", "tone_tags")]
    return F.concat_ws("\n", *lines)


def unviewed(nodes: DataFrame, viewed: DataFrame, key: str, comment: str = "comment") -> DataFrame:
    """Nodes with a comment that is not blank and not yet viewed."""
    return nodes.where(F.coalesce(trim_all(comment), F.lit("")) != "").join(viewed.select(key).distinct(), key, "left_anti")


#: Folders below which nothing may lie.
SYSTEM = ["/etc", "/usr", "/bin", "/sbin", "/sys", "/proc", "/var/run", "/System", "/Library"]


def validate_path(path: str | Column) -> Column:
    """struct(valid, error): absolute, in its shortest form, outside the system's folders."""
    p = col(path)
    error = F.when(~p.startswith("/"), "Path must be absolute").when(p.rlike(r"//|(^|/)\.{1,2}(/|$)|.+/$"), "Path contains traversal sequences")
    for prefix in SYSTEM:
        error = error.when((p == prefix) | p.startswith(prefix + "/"), f"Access to {prefix} is not allowed")
    error = F.when(p.isNull(), "Path must be absolute").otherwise(error)
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def model_url(provider: str | Column, model: str | Column, page: str | Column, patterns: dict[str, str]) -> Column:
    """A model's page: the one given, else its provider's pattern with ``{id}`` (without a version behind a colon), else null."""
    out, name = F.lit(None).cast("string"), F.split(col(model), ":")[0]
    for who, pattern in patterns.items():
        out = F.when(col(provider) == who, F.replace(F.lit(pattern), F.lit("{id}"), name)).otherwise(out)
    return F.coalesce(F.nullif(col(page), F.lit("")), out)


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All catalogs below each other; ``source_ord`` is the place of a row's catalog in the call."""
    marked = [c.withColumn("source_ord", F.lit(i)) for i, c in enumerate(catalogs)]
    out = marked[0]
    for c in marked[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def apply_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: or_else(c, v) for c, v in defaults.items()})


def matches(q: str, columns: list[str]) -> Column:
    """Whether any column holds the text, in any case; an empty text is in all."""
    return reduce(Column.__or__, [F.coalesce(F.lower(col(c)).contains(q.lower()), F.lit(False)) for c in columns], F.lit(not q))


def search(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    return df.where(matches(q, columns))


def filter_any(df: DataFrame, array: str | Column, wanted: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap(col(array), F.array(*[F.lit(x) for x in wanted]))) if wanted else df


def expand_facet(name: str) -> list[str]:
    """Capabilities of a facet; any other name stands for audio."""
    return FACETS.get(name, FACETS["audio"])


def infer_capabilities(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """The first kind, in the order given, of which the text holds a keyword."""
    out = F.lit(default)
    for kind, words in reversed(list(keywords.items())):
        test = F.lit(False)
        for w in words:
            test = test | F.lower(text).contains(w)
        out = F.when(test, kind).otherwise(out)
    return out


def recent_models(recents: DataFrame, catalog: DataFrame, facet: str, n: int = 4) -> DataFrame:
    """The n latest items of each user that the facet allows; items outside the catalog only count without a facet."""
    joined = recents.join(catalog.select("model_id", "capability").withColumn("_known", F.lit(True)), "model_id", "left")
    allowed = F.lit(True) if facet == "all" else F.coalesce(F.col("_known") & F.col("capability").isin(*expand_facet(facet)), F.lit(False))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "model_id")
    return joined.where(allowed).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("_known")


def route(df: DataFrame, rules: list[tuple[str, Column]], key: str, paused: bool = False) -> DataFrame:
    """(key, output): each output whose rule matches; ``default`` where none does; all outputs while paused."""
    names = F.array(*[F.lit(n) for n, _ in rules], F.lit("default"))
    if paused:
        return df.select(key, F.explode(names).alias("output"))
    hits = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in rules]))
    return df.select(key, F.explode(F.when(F.size(hits) == 0, F.array(F.lit("default"))).otherwise(hits)).alias("output"))
