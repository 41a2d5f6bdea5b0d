"""Checks and repair of workflow documents and of the edges in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import W

#: Node types and edge types that documents may hold.
NODE_TYPES = [
    "imageInput", "audioInput", "videoInput", "annotation", "prompt", "array", "promptConstructor", "nanoBanana", "generateVideo", "generate3d", "generateAudio", "llmGenerate",
    "splitGrid", "output", "outputGallery", "imageCompare", "videoStitch", "easeCurve", "videoTrim", "videoFrameGrab", "router", "switch", "conditionalSwitch", "glbViewer",
]
HANDLES = ["image", "text", "audio", "video", "easeCurve", "3d", "reference"]
#: Nodes that take a video.
VIDEO_TARGETS = ["generateVideo", "videoStitch", "easeCurve", "videoTrim", "videoFrameGrab", "videoInput", "output", "router"]


def _problems(df: DataFrame, rules: list[tuple[Column, Column, Column]]) -> DataFrame:
    """(workflow_id, path, message) for each of the (test, path, message) rules that a row breaks."""
    made = [F.when(F.coalesce(test, F.lit(False)), F.struct(path.alias("path"), message.alias("message"))) for test, path, message in rules]
    return df.select(W, F.inline(F.array_compact(F.array(*made))))


def _at(kind: str, field: str = "") -> Column:
    return F.concat(F.lit(f"{kind}["), F.col("ord").cast("string"), F.lit("]" + (f".{field}" if field else "")))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _mismatch() -> Column:
    s, t = F.col("source_handle"), F.col("target_handle")
    return ~_blank("source_handle") & ~_blank("target_handle") & (s != "reference") & (t != "reference") & (s != t)


def validate_documents(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, path, message) of all that is wrong with documents.

    ``documents``: version, name. ``nodes``: ord (from 0), node_id, type, x, y, has_position, has_data.
    ``edges``: ord, source, target, source_handle, target_handle.
    """
    say = lambda text, c: F.concat(F.lit(text), F.coalesce(F.col(c).cast("string"), F.lit("undefined")))
    top = _problems(documents, [
        (F.coalesce(F.col("version") != 1, F.lit(True)), F.lit("version"), F.lit("Version must be 1")),
        (_blank("name"), F.lit("name"), F.lit("Name must be a non-empty string")),
    ])
    again = F.row_number().over(Window.partitionBy(W, "node_id").orderBy("ord")) > 1
    per_node = _problems(nodes.withColumn("again", again), [
        (_blank("node_id"), _at("nodes", "id"), F.lit("Node must have a string id")),
        (~_blank("node_id") & F.col("again"), _at("nodes", "id"), say("Duplicate node id: ", "node_id")),
        (F.coalesce(~F.col("type").isin(*NODE_TYPES), F.lit(True)), _at("nodes", "type"), F.concat(say("Invalid node type: ", "type"), F.lit(". Valid types: " + ", ".join(NODE_TYPES)))),
        (~F.coalesce(F.col("has_position"), F.lit(False)), _at("nodes", "position"), F.lit("Node must have a position object")),
        (F.col("has_position") & (F.col("x").isNull() | F.col("y").isNull()), _at("nodes", "position"), F.lit("Position must have numeric x and y values")),
        (~F.coalesce(F.col("has_data"), F.lit(False)), _at("nodes", "data"), F.lit("Node must have a data object")),
    ])
    ids = nodes.where("node_id is not null").select(W, "node_id").distinct()
    known = edges
    for end in ("source", "target"):
        known = known.join(ids.select(W, F.col("node_id").alias(end), F.lit(True).alias(f"{end}_known")), [W, end], "left")
    rules = []
    for end in ("source", "target"):
        rules += [(_blank(end), _at("edges", end), F.lit(f"Edge must have a {end} id")), (~_blank(end) & F.col(f"{end}_known").isNull(), _at("edges", end), say(f"{end.capitalize()} node not found: ", end))]
    for h, name in (("source_handle", "sourceHandle"), ("target_handle", "targetHandle")):
        rules.append((~_blank(h) & ~F.col(h).isin(*HANDLES), _at("edges", name), say(f"Invalid {name}: ", h)))
    rules.append((_mismatch(), _at("edges"), F.concat(F.lit("Handle type mismatch: "), F.col("source_handle"), F.lit(" → "), F.col("target_handle"))))
    return top.union(per_node).union(_problems(known, rules))


def first_problem(problems: DataFrame, order: list[str]) -> DataFrame:
    """(workflow_id, path, message): of each document's problems the first by the columns of ``order``."""
    w = Window.partitionBy(W).orderBy(*order)
    return problems.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(W, "path", "message")


def repair_documents(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of a known type, with an id and a place; edges both of whose ends exist and whose handles agree, with an id.

    An unknown type becomes a prompt, a missing id its type and number, a missing place one in a row.
    """
    kind = F.when(F.col("type").isin(*NODE_TYPES), F.col("type")).otherwise("prompt")
    nodes = nodes.withColumn("type", kind)
    made = F.concat_ws("-", F.col("type"), (F.col("ord") + 1).cast("string"))
    nodes = nodes.withColumns({"node_id": F.when(_blank("node_id"), made).otherwise(F.col("node_id")), "x": F.coalesce("x", 50.0 + F.col("ord") * 400.0), "y": F.coalesce("y", F.lit(100.0))})
    ids = nodes.select(W, "node_id").distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), [W, end], "left_semi")
    edges = edges.where(~_mismatch())
    own = F.concat_ws("-", F.lit("edge"), "source", "target", *[F.when(_blank(h), "default").otherwise(F.col(h)) for h in ("source_handle", "target_handle")])
    return nodes, edges.withColumn("edge_id", F.when(_blank("edge_id"), own).otherwise(F.col("edge_id")) if "edge_id" in edges.columns else own)


def validate_inputs(workflows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, message): empty workflows, generating nodes without text, annotations without any image, outputs without input.

    ``nodes`` has own_image where an annotation brings one.
    """
    to = edges.select(W, F.col("target").alias("node_id"), ((F.col("target_handle") == "text") | F.col("target_handle").startswith("text-")).alias("is_text"))
    got = to.groupBy(W, "node_id").agg(F.bool_or(F.coalesce("is_text", F.lit(False))).alias("text"))
    n = nodes.join(got, [W, "node_id"], "left").withColumn("any", F.col("text").isNotNull())
    say = lambda a, b: F.concat(F.lit(f'{a} node "'), F.col("node_id").cast("string"), F.lit(f'" missing {b} input'))
    no_text = ~F.coalesce("text", F.lit(False))
    message = F.when((F.col("type") == "nanoBanana") & no_text, say("Generate", "text")).when((F.col("type") == "generateVideo") & no_text, say("Video", "text"))
    message = message.when((F.col("type") == "annotation") & ~F.col("any") & F.col("own_image").isNull(), say("Annotation", "image")).when((F.col("type") == "output") & ~F.col("any"), say("Output", "image"))
    empty = workflows.select(W).distinct().join(nodes.select(W).distinct(), W, "left_anti").select(W, F.lit("Workflow is empty").alias("message"))
    return n.select(W, message.alias("message")).where("message is not null").union(empty)


def handle_kind(handle: str | Column) -> Column:
    """The data type that a handle's name stands for; null for generic and unknown names."""
    h = F.col(handle) if isinstance(handle, str) else handle
    has = lambda *words: reduce(Column.__or__, [h.contains(w) for w in words])
    return (
        F.when(h.isin("generic-input", "generic-output"), None).when(h.isin("easeCurve", "3d", "video"), h).when(h.startswith("audio"), "audio").when(h.isin("image", "text"), h)
        .when(has("video"), "video").when(has("image", "frame"), "image").when(h.startswith("text-") | has("prompt"), "text")
    )


def compatible_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with ``compatible``: whether their handles' types may meet on these nodes.

    A switch takes anything and gives its input type; rule nodes deal in text; untyped handles meet
    all; curves, 3d and audio meet their like or a router (audio an output, too); video goes to the
    nodes that take it; otherwise types are equal. An end whose node is missing has no type of node.
    """
    ends = nodes.select(W, "node_id", "type", "input_type")
    e = edges.join(ends.select(W, F.col("node_id").alias("source"), F.col("type").alias("_from"), F.col("input_type").alias("_given")), [W, "source"], "left")
    e = e.join(ends.select(W, F.col("node_id").alias("target"), F.col("type").alias("_to")), [W, "target"], "left")
    s, t, no = handle_kind("source_handle"), handle_kind("target_handle"), lambda c: F.coalesce(c, F.lit(False))
    frm, to = F.col("_from"), F.col("_to")
    either = lambda k: no(s == k) | no(t == k)
    router = no(frm == "router") | no(to == "router")
    ok = (
        F.when((to == "switch") & (F.col("target_handle") == "generic-input"), True)
        .when(frm == "switch", F.when(~_blank("_given") & t.isNotNull(), F.col("_given") == t).otherwise(True))
        .when(to == "conditionalSwitch", no(s == "text")).when(frm == "conditionalSwitch", no(t == "text"))
        .when(s.isNull() | t.isNull(), True)
        .when(either("easeCurve"), router | ((s == t) & no(to == "easeCurve")))
        .when(s == "video", no(to.isin(*VIDEO_TARGETS)))
        .when(either("3d"), router | (s == t))
        .when(either("audio"), ((s == "audio") & no(to.isin("output", "router"))) | (s == t))
        .otherwise(s == t)
    )
    return e.withColumn("compatible", ok).drop("_from", "_to", "_given")
