"""Ordered edits of workflow graphs, their account in words, and listings of graphs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import W

#: Nodes whose output is an image.
IMAGE_SOURCES = ["imageInput", "annotation", "nanoBanana", "glbViewer", "videoFrameGrab"]


def _fold(nodes: list[dict], edges: list[dict], ops: list[dict]) -> tuple[list[dict], list[dict], int, list[str]]:
    """One workflow's nodes and edges after its edits, the number applied, and why others were skipped."""
    kept, skipped, applied = {n["node_id"]: n for n in nodes}, [], 0
    for place, op in enumerate(ops):
        kind, node = op["type"], op["node_id"]
        missing = None
        if kind in ("removeNode", "updateNode") and node not in kept:
            missing = f'{kind}: node "{node}" not found'
        elif kind == "addEdge":
            missing = next((f'addEdge: {end} node "{op[end]}" not found' for end in ("source", "target") if op[end] not in kept), None)
        elif kind == "removeEdge" and all(e["edge_id"] != op["edge_id"] for e in edges):
            missing = f'removeEdge: edge "{op["edge_id"]}" not found'
        if missing:
            skipped.append(missing)
            continue
        applied += 1
        if kind == "addNode":
            name = f"{op['node_type']}-ai-{place}"
            kept[name] = {"node_id": name, "type": op["node_type"], "data": op["data"] or "{}"}
        elif kind == "removeNode":
            del kept[node]
            edges = [e for e in edges if node not in (e["source"], e["target"])]
        elif kind == "updateNode":
            kept[node] = kept[node] | {"data": json.dumps(json.loads(kept[node]["data"] or "{}") | json.loads(op["data"] or "{}"))}
        elif kind == "addEdge":
            handle = f"-{op['source_handle']}" if op["source_handle"] else ""
            edges = [*edges, {"edge_id": f"edge-ai-{op['source']}-{op['target']}{handle}", "source": op["source"], "target": op["target"]}]
        else:
            edges = [e for e in edges if e["edge_id"] != op["edge_id"]]
    return list(kept.values()), edges, applied, skipped


def apply_edits(nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> DataFrame:
    """(workflow_id, applied, skipped, node_ids, edge_ids, data) after each workflow's edits in order of ``ord``.

    ``nodes``: node_id, type, data (JSON). ``edges``: edge_id, source, target. ``ops``: ord, type (addNode,
    removeNode, updateNode, addEdge, removeEdge), node_id, node_type, edge_id, source, target,
    source_handle, data. Edits depend on those before them, so a workflow is folded in one task; the
    order within a workflow is all that is kept together. A new node is named by its type and the
    edit's place. ``data`` maps each node to its JSON. Workflows without edits are not returned.
    """
    as_text = lambda df, *cs: df.select(F.col(W).cast("string").alias(W), *[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cs])
    numbered = ops.withColumn("place", F.row_number().over(Window.partitionBy(W).orderBy("ord")))
    fields = ("type", "node_id", "node_type", "edge_id", "source", "target", "source_handle", "data")
    rows = numbered.groupBy(F.col(W).cast("string").alias(W)).agg(F.array_sort(F.collect_list(F.struct("place", *[F.col(c).cast("string").alias(c) if c in ops.columns else F.lit(None).cast("string").alias(c) for c in fields]))).alias("ops"))
    n = as_text(nodes, "node_id", "type", "data").groupBy(W).agg(F.array_sort(F.collect_list(F.struct("node_id", "type", "data"))).alias("nodes"))
    e = as_text(edges, "edge_id", "source", "target").groupBy(W).agg(F.array_sort(F.collect_list(F.struct("edge_id", "source", "target"))).alias("edges"))
    whole = rows.join(n, W, "left").join(e, W, "left")

    def fold(batches):
        for pdf in batches:
            out = []
            for w, o, ns, es in zip(pdf[W], pdf["ops"], pdf["nodes"], pdf["edges"], strict=True):
                got = _fold(*[[dict(x) if isinstance(x, dict) else x.asDict() for x in (part if part is not None else [])] for part in (ns, es, o)])
                out.append((w, got[2], got[3], sorted(x["node_id"] for x in got[0]), sorted(x["edge_id"] for x in got[1]), {x["node_id"]: x["data"] for x in got[0]}))
            yield pd.DataFrame(out, columns=[W, "applied", "skipped", "node_ids", "edge_ids", "data"])

    return whole.select(W, "ops", "nodes", "edges").mapInPandas(fold, f"{W} string, applied int, skipped array<string>, node_ids array<string>, edge_ids array<string>, data map<string,string>")


def narrate_op() -> Column:
    """A sentence for an edit (columns type, node_type, node_id, source, target, edge_id)."""
    say = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts])
    kind = F.col("type")
    return (
        F.when(kind == "addNode", say("Added a ", "@node_type", " node")).when(kind == "removeNode", say("Removed node ", "@node_id")).when(kind == "updateNode", say("Updated ", "@node_id", " settings"))
        .when(kind == "addEdge", say("Connected ", "@source", " to ", "@target")).when(kind == "removeEdge", say("Removed connection ", "@edge_id"))
    )


def stale_inputs(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(workflow_id, node_id) of targets of removed edges to which no edge from an image node is left."""
    hit = removed.select(W, F.col("target").alias("node_id")).distinct().join(nodes.select(W, "node_id").distinct(), [W, "node_id"], "left_semi")
    images = nodes.where(F.col("type").isin(*IMAGE_SOURCES)).select(W, F.col("node_id").alias("source")).distinct()
    fed = edges.join(images, [W, "source"], "left_semi").select(W, F.col("target").alias("node_id"))
    return hit.join(fed, [W, "node_id"], "left_anti")


def describe_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, listing): a line for each node by its title, else its type, and an arrow for each edge."""
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("type").cast("string"))
    own = nodes.select(W, "node_id", name.alias("name"))
    a = own.select(W, F.struct(F.lit(0).alias("k"), F.col("node_id").cast("string").alias("i"), F.concat(F.lit("- "), "name").alias("line")).alias("x"))
    ends = [own.select(W, F.col("node_id").alias(end), F.col("name").alias(f"_{end}")) for end in ("source", "target")]
    e = edges.join(ends[0], [W, "source"]).join(ends[1], [W, "target"])
    b = e.select(W, F.struct(F.lit(1).alias("k"), F.concat_ws(">", "source", "target").alias("i"), F.concat("_source", F.lit(" → "), "_target").alias("line")).alias("x"))
    return a.union(b).groupBy(W).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("listing"))


def overlay(nodes: DataFrame, content: DataFrame) -> DataFrame:
    """Nodes with the content given for their (template, level, node): its prompt, or its image if there is one; others stay."""
    keys = ["template", "level", "node_id"]
    own = content.select(*keys, F.col("prompt").alias("_prompt"), F.col("image").alias("_image")).dropDuplicates(keys)
    return nodes.join(own, keys, "left").withColumns({"prompt": F.coalesce("_prompt", "prompt"), "image": F.coalesce("_image", "image")}).drop("_prompt", "_image")
