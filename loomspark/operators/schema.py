"""Parameters and inputs of models, read from their JSON schemas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import col

#: Names under which a schema may ask for a generic input, by preference.
PATTERNS = {
    "prompt": ["prompt", "text", "caption", "input_text", "description", "query"],
    "negativePrompt": ["negative_prompt", "negative", "neg_prompt", "negative_text"],
    "image": ["image_url", "image_urls", "image", "first_frame", "start_image", "init_image", "reference_image", "input_image", "image_input", "source_image", "img", "photo"],
    "aspectRatio": ["aspect_ratio", "ratio", "size", "dimensions", "output_size"],
    "duration": ["duration", "length", "num_frames", "seconds", "video_length"],
    "fps": ["fps", "frame_rate", "framerate", "frames_per_second"],
    "audio": ["audio_enabled", "with_audio", "enable_audio", "audio", "sound"],
    "seed": ["seed", "random_seed", "noise_seed"],
    "steps": ["steps", "num_steps", "num_inference_steps", "inference_steps"],
    "guidance": ["guidance_scale", "guidance", "cfg_scale", "cfg"],
    "scheduler": ["scheduler", "sampler", "sampler_name"],
    "strength": ["strength", "denoise", "denoising_strength"],
}
TYPES = ["string", "integer", "number", "boolean", "array", "object"]
#: Names and words of descriptions that mark an input, and names that are left out.
IMAGES = ["image_url", "image_urls", "image", "images", "image_input", "input_image", "first_frame", "last_frame", "tail_image_url", "start_image", "end_image", "reference_image", "init_image", "mask_image", "control_image"]
AUDIOS = ["audio_url", "audio_urls", "audio_input", "audio_file", "audio"]
TEXTS = ["prompt", "negative_prompt"]
IMAGE_WORDS = ["image url", "base64 image", "data uri", "image file", "url of the image", "path to image"]
AUDIO_WORDS = ["audio url", "audio file", "url of the audio"]
NOT_IMAGES, NOT_IMAGE_WORDS = ["image_size"], ["_images", "guidance", "generation", "_count", "_size", "_scale"]
HIDDEN = ["webhook", "webhook_events_filter", "sync_mode", "disable_safety_checker", "go_fast", "enable_safety_checker", "output_format", "output_quality", "request_id"]
#: Fields of a property that count as they stand there.
OWN = {"_items": "items.type", "_said": "description", "_minimum": "minimum", "_maximum": "maximum"}
PROPERTIES = "$.components.schemas.Input.properties"


def _json(c: Column, path: str | Column) -> Column:
    return F.call_function("get_json_object", c, path if isinstance(path, Column) else F.lit(path))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def properties(schema: str | Column, path: str = PROPERTIES) -> Column:
    """A schema's properties, name to JSON, in the order of the document; empty where there are none."""
    return F.coalesce(F.from_json(_json(col(schema), path), "map<string,string>"), F.create_map().cast("map<string,string>"))


def param_types(schema: str | Column) -> Column:
    """Name to declared type, for the properties that declare one of TYPES."""
    typed = F.transform_values(properties(schema), lambda k, v: _json(v, "$.type"))
    return F.map_filter(typed, lambda k, v: v.isin(*TYPES))


def param_mapping(schema: str | Column) -> Column:
    """Generic name to the schema's own name: of a group's patterns the first that a property has, is contained in, or (if longer than two) contains."""

    def mapping(names: Column) -> Column:
        def found(pattern: str) -> Column:
            near = lambda n: F.lower(n).contains(pattern) | (F.lit(pattern).contains(F.lower(n)) if len(pattern) >= 3 else F.lit(False))
            return F.coalesce(F.when(F.array_contains(names, pattern), F.lit(pattern)), F.try_element_at(F.filter(names, near), F.lit(1)))

        entries = [F.struct(F.lit(g).alias("key"), F.coalesce(*map(found, patterns)).alias("value")) for g, patterns in PATTERNS.items()]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    return once(F.map_keys(properties(schema)), mapping)


def coerce_param(value: str | Column, kind: str | Column) -> Column:
    """A text as JSON of its declared type: leading digits as an integer, a leading number, true or false; what does not parse stays text."""
    v, kind = col(value), col(kind)
    whole = F.nullif(F.regexp_extract(v, r"^\s*([+-]?\d+)", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit(""))
    quoted = F.to_json(F.array(v))
    text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    whole_text, number = whole.try_cast("bigint").cast("string"), number.cast("double")
    number_text = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return F.when(v.isNull(), None).when((kind == "integer") & whole_text.isNotNull(), whole_text).when((kind == "number") & number.isNotNull(), number_text).when(kind == "boolean", F.when(v == "true", "true").otherwise("false")).otherwise(text)


#: Most links of a chain of references; a ring of them ends there.
LINKS = 16


def _part(json: Column) -> Column:
    """A piece of a schema with the names of its own fields, so that only those it has are read."""
    return once(json, lambda p: F.struct(p.alias("json"), F.json_object_keys(p).alias("keys")))


def _field(part: Column, name: str, path: str | None = None) -> Column:
    return F.when(F.array_contains(part["keys"], name), _json(part["json"], path or f"$.{name}"))


def _referred(part: Column, definitions: Column) -> Column:
    """The definition that a part's $ref names, through further ones; null where it has none or it leads nowhere."""
    at = lambda p: F.struct(p.alias("part"), F.nullif(F.regexp_extract(F.coalesce(_field(p, "$ref", "$['$ref']"), F.lit("")), r"^#/components/schemas/(.+)$", 1), F.lit("")).alias("ref"))
    step = lambda x, _: F.when(x["ref"].isNotNull(), once(_part(F.try_element_at(definitions, x["ref"])), at)).otherwise(x)
    return F.when(F.array_contains(part["keys"], "$ref"), once(at(part), lambda x: F.when(x["ref"].isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(LINKS)), x, step)["part"])))


def _parts(prop: Column, definitions: Column) -> Column:
    """A property with what it refers to and its variants, each with what that refers to, looked up once for all fields."""
    both = lambda p: F.struct(p.alias("own"), _referred(p, definitions).alias("end"))
    variants = lambda p: F.flatten(F.array(*[F.coalesce(F.from_json(_field(p, w), "array<string>"), F.array().cast("array<string>")) for w in ("anyOf", "oneOf", "allOf")]))
    return once(_part(prop), lambda p: F.struct(p.alias("own"), _referred(p, definitions).alias("end"), F.transform(variants(p), lambda v: once(_part(v), both)).alias("variants")))


def _resolved(parts: Column, field: str) -> Column:
    """A property's field: its own, else the first of its variants that is not null, else of what it refers to."""
    values = F.transform(parts["variants"], lambda v: F.coalesce(_field(v["end"], field), _field(v["own"], field)))
    return F.coalesce(_field(parts["own"], field), F.try_element_at(F.filter(values, lambda x: x.isNotNull() & (x != "null")), F.lit(1)), _field(parts["end"], field))


def _any(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])


def schema_fields(schemas: DataFrame, key: str, schema: str = "schema") -> DataFrame:
    """(key, pos, name, input, type, is_array, required, label, description, default, minimum, maximum, enum), one row for each property that is not hidden.

    ``input`` is audio, image or text for what other nodes may feed (audio is tried first), null for
    parameters, whose type is string unless the schema says integer, number, boolean or array.
    """
    given = F.struct(
        F.map_entries(properties(schema)).alias("properties"), F.from_json(_json(F.col(schema), "$.components.schemas"), "map<string,string>").alias("definitions"),
        F.coalesce(F.from_json(_json(F.col(schema), "$.components.schemas.Input.required"), "array<string>"), F.array().cast("array<string>")).alias("required"),
    )

    def fields(e: Column, i: Column, d: Column) -> Column:
        read = lambda x: F.struct(
            i.alias("pos"), e["key"].alias("name"), F.coalesce(F.array_contains(d["required"], e["key"]), F.lit(False)).alias("required"), *[_field(x["own"], p.split(".")[0], f"$.{p}").alias(c) for c, p in OWN.items()],
            *[_resolved(x, f).alias(f"_{f}") for f in ("type", "format", "description", "default", "enum")],
        )
        return once(_parts(e["value"], d["definitions"]), read)

    # all of a document's properties are read in one expression: columns that hold these steps would be worked out again wherever they are named
    rows = schemas.select(key, F.inline(once(given, lambda d: F.transform(d["properties"], lambda e, i: fields(e, i, d)))))
    kind, n, items = F.col("_type"), F.col("name"), F.col("_items")
    textual = F.coalesce((kind == "string") | ((kind == "array") & F.coalesce(items == "string", F.lit(True))), F.lit(False))
    said = F.lower(F.coalesce("_said", F.lit("")))
    named = n.endswith("_image") | n.startswith("image_") | n.contains("_image_")
    linked = F.col("_format").isin("uri", "data-uri", "binary") & (n.isin(*IMAGES) | named)
    image = textual & ~n.isin(*NOT_IMAGES) & (F.coalesce(linked, F.lit(False)) | _any(said, IMAGE_WORDS) | n.isin(*IMAGES) | (~_any(n, NOT_IMAGE_WORDS) & named))
    audio = textual & (n.isin(*AUDIOS) | _any(said, AUDIO_WORDS) | n.endswith("_audio") | n.startswith("audio_"))
    fed = F.when(audio, "audio").when(image, "image").when(n.isin(*TEXTS), "text")
    label = F.regexp_replace(F.regexp_replace(n, "_url$", ""), "_", " ")
    label = F.array_join(F.transform(F.split(label, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))), " ")
    out = rows.select(
        key, "pos", "name", fed.alias("input"), F.when(kind.isin("integer", "number", "boolean", "array"), kind).otherwise("string").alias("type"), F.coalesce(kind == "array", F.lit(False)).alias("is_array"),
        "required", label.alias("label"), F.coalesce(F.nullif(F.col("_said"), F.lit("")), "_description").alias("description"), F.col("_default").alias("default"),
        F.col("_minimum").try_cast("double").alias("minimum"), F.col("_maximum").try_cast("double").alias("maximum"), F.col("_enum").alias("enum"),
    )
    return out.where(F.col("input").isNotNull() | ~F.col("name").isin(*HIDDEN))


def schema_inputs(schemas: DataFrame, key: str, schema: str = "schema") -> DataFrame:
    return schema_fields(schemas, key, schema).where("input is not null").select(key, "pos", "name", F.col("input").alias("type"), "required", "label", "description", "is_array")


def schema_params(schemas: DataFrame, key: str, schema: str = "schema") -> DataFrame:
    return schema_fields(schemas, key, schema).where("input is null").select(key, "pos", "name", "type", "required", "description", "default", "minimum", "maximum", "enum")
