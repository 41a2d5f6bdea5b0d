"""What flows through workflow graphs: blocked branches, skipped nodes, resolved inputs."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import W, components, downstream, levels, settled, sized

#: What each type of node gives; other types give an image.
KINDS = {
    "imageInput": "image", "annotation": "image", "nanoBanana": "image", "videoFrameGrab": "image", "glbViewer": "image",
    "videoInput": "video", "generateVideo": "video", "videoStitch": "video", "easeCurve": "video", "videoTrim": "video",
    "audioInput": "audio", "generateAudio": "audio", "generate3d": "3d",
    "prompt": "text", "array": "text", "promptConstructor": "text", "llmGenerate": "text",
}
#: Nodes that hand on what they get.
PASSING = ("router", "switch")


def closed_outputs(switches: DataFrame, rules: DataFrame) -> DataFrame:
    """(workflow_id, source, source_handle) of outputs through which nothing flows.

    ``switches`` (node_id, handle, enabled) and ``rules`` (node_id, handle, matched, paused): a switch
    closes what is not enabled; a rule node closes what does not match and, where any rule matches, its
    ``default``; while paused it closes nothing.
    """
    off = switches.where(~F.col("enabled")).select(W, F.col("node_id").alias("source"), F.col("handle").alias("source_handle"))
    live = rules.where(~F.coalesce(F.col("paused"), F.lit(False)))
    unmatched = live.where(~F.col("matched")).select(W, F.col("node_id").alias("source"), F.col("handle").alias("source_handle"))
    default = live.where("matched").select(W, F.col("node_id").alias("source"), F.lit("default").alias("source_handle"))
    return off.union(unmatched).union(default).distinct()


def _rings(nodes: list, after: dict) -> list[list]:
    """The strongly connected components of a graph, sources first (Tarjan, without recursion)."""
    number, low, on, path, out = {}, {}, set(), [], []
    for start in nodes:
        work = [(start, iter(after.get(start, ())))] if start not in number else []
        if work:
            number[start] = low[start] = len(number)
            path.append(start)
            on.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    path.append(to)
                    on.add(to)
                    work.append((to, iter(after.get(to, ()))))
                    break
                if to in on:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    ring = [path.pop()]
                    while ring[-1] != node:
                        ring.append(path.pop())
                    on.difference_update(ring)
                    out.append(ring)
    return out[::-1]


def _blocked(edges: list[tuple]) -> list:
    """The blocked nodes of one workflow, from (source, target, target handle, closed)."""
    into, after = {}, {}
    for source, target, handle, closed in edges:
        into.setdefault(target, []).append((source, handle, closed))
        after.setdefault(source, []).append(target)
    found = dict.fromkeys(t for _, t, _, closed in edges if closed)
    todo = list(found)
    while todo:
        for to in after.get(todo.pop(), ()):
            if to not in found:
                found[to] = None
                todo.append(to)
    done: set = set()

    def dead(node) -> bool:
        own = [(h, closed or source in done) for source, h, closed in into[node] if h is not None]
        shut = {h for h, off in own if off}
        return bool(shut) and not any(h in shut for h, off in own if not off)

    for ring in _rings(list(found), {n: [t for t in after.get(n, ()) if t in found] for n in found}):
        while new := {n for n in ring if n not in done and dead(n)}:
            done |= new
            if len(ring) == 1:
                break
    return sorted(done, key=str)


def blocked_nodes(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """(workflow_id, node_id) behind closed outputs, unless a live input gives a type that is blocked.

    Nodes are judged after all that leads to them. A node is blocked if some handle gets something from a closed
    output or a blocked node, and none of these handles gets anything live. The nodes of a cycle are
    judged together, by what is blocked before them, and again until no more of them is; what lies behind a
    cycle comes after it. Edges without a target handle neither block nor rescue.

    Workflows of SMALL edges at most are solved whole, one in a group. Larger ones are solved over the cluster by levels,
    and the nodes on or behind their cycles together at the end, in rounds.
    """
    marked = edges.join(closed.withColumn("closed", F.lit(True)), [W, "source", "source_handle"], "left").select(W, "source", "target", "target_handle", F.coalesce("closed", F.lit(False)).alias("closed"))
    marked = settled(marked)
    marked = settled(marked.join(sized(marked), W))
    kinds = dict(marked.dtypes)

    def solve(rows: pa.Table) -> pa.Table:
        found = _blocked(list(zip(*(rows[c].to_pylist() for c in ("source", "target", "target_handle", "closed")), strict=True)))
        return pa.table({W: pa.array([rows[W][0].as_py()] * len(found), rows.schema.field(W).type), "node_id": pa.array(found, rows.schema.field("target").type)})

    small = marked.where("small").drop("small").groupBy(W).applyInArrow(solve, f"{W} {kinds[W]}, node_id {kinds['target']}")
    marked = marked.where("not small").drop("small")
    return small if marked.isEmpty() else small.union(_blocked_by_levels(marked))


def _blocked_by_levels(marked: DataFrame) -> DataFrame:
    maybe = downstream(marked, marked.where("closed").select(W, F.col("target").alias("node_id")))
    inner = marked.join(maybe.withColumnRenamed("node_id", "source"), [W, "source"], "left_semi").join(maybe.withColumnRenamed("node_id", "target"), [W, "target"], "left_semi")
    placed = settled(maybe.join(levels(maybe, inner), [W, "node_id"], "left"))
    into = settled(marked.where("target_handle is not null").join(placed.select(W, F.col("node_id").alias("target"), F.coalesce("level", F.lit(-1)).alias("level")), [W, "target"]))
    last = placed.agg(F.max("level").alias("level")).first()["level"]
    done, level = placed.select(W, "node_id").where("false"), 0
    while True:
        cyclic = level > (-1 if last is None else last)
        rows = into.where(F.col("level") == (-1 if cyclic else level)).join(done.select(W, F.col("node_id").alias("source"), F.lit(True).alias("blocked")), [W, "source"], "left")
        dead = F.col("closed") | F.coalesce("blocked", F.lit(False))
        by = rows.groupBy(W, F.col("target").alias("node_id"), "target_handle").agg(F.bool_or(dead).alias("dead"), F.bool_or(~dead).alias("live"))
        new = by.groupBy(W, "node_id").agg(F.bool_or("dead").alias("dead"), F.bool_or(F.col("dead") & F.col("live")).alias("rescued")).where("dead and not rescued").select(W, "node_id")
        new = settled(new.join(done, [W, "node_id"], "left_anti"))
        if cyclic and new.isEmpty():
            return done
        done, level = settled(done.union(new)), level + 1


def is_skippable(kind: str | Column, optional: str | Column, value: str | Column) -> Column:
    """Whether a node is optional and empty: no image, no audio, or a prompt of white space alone."""
    kind, optional, value = (F.col(c) if isinstance(c, str) else c for c in (kind, optional, value))
    text = F.coalesce(value, F.lit(""))
    empty = F.when(kind.isin("imageInput", "audioInput"), text == "").when(kind == "prompt", F.regexp_replace(text, r"(?U)\s+", "") == "").otherwise(F.lit(False))
    return F.coalesce(optional, F.lit(False)) & empty


def skipped_nodes(nodes: DataFrame, edges: DataFrame, halted: DataFrame | None = None) -> DataFrame:
    """Empty optional nodes (is_skippable) and all that any skipped node leads to.

    Nodes in ``halted`` (blocked, or in a locked group) do not run: they are not skipped and pass no skip on.
    """
    seeds = nodes.where("is_skippable").select(W, "node_id")
    if halted is not None:
        stop = halted.select(W, "node_id").distinct()
        seeds = seeds.join(stop, [W, "node_id"], "left_anti")
        edges = edges.join(stop.withColumnRenamed("node_id", "target"), [W, "target"], "left_anti")
    return downstream(edges, seeds)


def _image_handle(h: Column) -> Column:
    return F.coalesce((h == "image") | h.startswith("image-") | h.contains("frame"), F.lit(False))


def _text_handle(h: Column) -> Column:
    return F.coalesce((h == "text") | h.startswith("text-") | h.contains("prompt"), F.lit(False))


#: Kinds that pass-through nodes hand on as lists; of the others the last counts.
LISTED = ("image", "video", "audio")
CURVE = "easeCurve"


def _handed_on(into: dict, root) -> list[tuple]:
    """(ord, kind, value), in order, of what a node gets from its pass-through sources.

    ``into``: of each node its edges (source or None, ord, kind, value) in order, where an edge without a source
    gives a value itself. A pass-through node is opened once, by the first edge that asks for it; other
    nodes find it empty, while further edges of the one that opened it get the same again. So diamonds give a
    value once, cycles end, and time is linear in the edges.
    """
    fresh = lambda: {k: [] for k in LISTED}
    seen, out, stack = {root}, [], [[root, 0, fresh(), {}]]
    while stack:
        node, at, held, known = frame = stack[-1]
        edges = into.get(node, ())
        if at == len(edges):
            stack.pop()
            if held.get("own") and not held.get(CURVE):
                held[CURVE] = held["own"]
            if stack:
                stack[-1][3][node] = held
            continue
        source, ord_, kind, value = edges[at]
        if source is not None and source not in known:
            if source not in seen:
                seen.add(source)
                stack.append([source, 0, fresh(), {}])
                continue
            known[source] = fresh()
        frame[1] += 1
        if source is None:
            got = [value]
        else:
            got = known[source].get(kind) or []
            got = got if kind in LISTED else [got] if got else []
            if node == root and len(stack) == 1:
                out += [(ord_, kind, v) for v in got]
        if kind in LISTED:
            held[kind] += got
        elif kind == "batch":
            held.setdefault("text", value)
        elif kind != "own" or "own" not in held:
            held |= {kind: v for v in got}
    return out


def _through(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """What nodes get through routers and switches: (workflow_id, target, ord, place, kind, value), one group for each part of a workflow."""

    def solve(rows: pa.Table) -> pa.Table:
        into: dict = {}
        for source, target, ord_, kind, value in sorted(zip(*(rows[c].to_pylist() for c in ("source", "target", "ord", "kind", "value")), strict=True), key=lambda r: r[2]):
            into.setdefault(target, []).append((source, ord_, kind, value))
        out = [(t, o, i, k, v) for t, edges in into.items() if any(e[0] is not None for e in edges) for i, (o, k, v) in enumerate(_handed_on(into, t))]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [rows.schema.field("target").type, pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.table({W: pa.array([rows[W][0].as_py()] * len(out), rows.schema.field(W).type)} | {n: pa.array(c, t) for n, c, t in zip(("target", "ord", "place", "kind", "value"), columns, types, strict=True)})

    return found.groupBy(W, "part").applyInArrow(solve, f"{W} {kinds[W]}, target {kinds['node_id']}, ord long, place int, kind string, value string")


def resolve_inputs(nodes: DataFrame, edges: DataFrame, closed: DataFrame, blocked: DataFrame | None = None, schema: DataFrame | None = None) -> DataFrame:
    """What each node gets: images, videos, audio, model3d, text, text_items, ease_curve and dynamic (schema name to values).

    ``nodes``: node_id, type, value, items (of an array), batch, input_type (of a switch) and perhaps curve (of an
    ease curve). ``edges``: ord, source, source_handle, target, target_handle, item_index. ``schema``: node_id, pos,
    name, kind.

    Routers and switches hand on what they get, of the kind that the edge's source handle, or the
    switch's input type, names; closed outputs and blocked sources give nothing; a rule node gives
    nothing in any case. Seen from one node, a router or switch is opened once (``_handed_on``): a value that could come by
    two ways comes by the first. Of several texts the last by edge order counts; an array in batch mode gives
    all its items, and its first as text where there is no other text. Other arrays give the item of the
    edge's index (modulo their number), else of the handle ``text-N``, else their value. A node of a
    switch whose output is not listed counts as open. The ease curve is the last that comes through, else that of
    the first edge at the handle ``easeCurve``, closed or not, if an ease curve is its source.

    Routers and switches of a workflow of SMALL edges at most are solved in one group, of a larger one in a group for each
    set of them that hang together (``components``), found over the cluster.
    """
    e = edges.join(closed.withColumn("_closed", F.lit(True)), [W, "source", "source_handle"], "left").where("_closed is null").drop("_closed")
    if blocked is not None:
        e = e.join(blocked.select(W, F.col("node_id").alias("source")).distinct(), [W, "source"], "left_anti")
    src = nodes.select(W, F.col("node_id").alias("source"), "type", "value", "items", "batch", "input_type", (F.col("curve") if "curve" in nodes.columns else F.lit(None)).cast("string").alias("curve"))
    e = settled(e.join(src, [W, "source"]).where("type <> 'conditionalSwitch'").withColumn("ord", F.col("ord").cast("long")))
    kind = reduce(lambda a, k: F.when(F.col("type").isin(*[t for t, x in KINDS.items() if x == k]), k).otherwise(a), ["video", "audio", "3d", "text"], F.lit("image"))
    batch = F.coalesce((F.col("type") == "array") & F.col("batch"), F.lit(False))
    n, handle = F.size("items"), F.try_to_number(F.regexp_extract("source_handle", r"^text-(\d{1,9})$", 1), F.lit("999999999")).cast("int")
    item = F.when((F.col("item_index") >= 0) & (n > 0), F.try_element_at("items", (F.col("item_index") % n + 1).cast("int"))).when((F.col("item_index") >= 0), F.lit(None).cast("string")).when(handle.isNotNull(), F.try_element_at("items", handle + 1)).otherwise(F.col("value"))
    value = F.when(batch, F.try_element_at("items", F.lit(1))).when(F.col("type") == "array", item).otherwise(F.col("value"))
    h = F.col("target_handle")
    routed = F.when(kind.isin("3d", "video", "audio"), kind).when((kind == "text") | _text_handle(h), "text").when(_image_handle(h) | h.isNull() | (h == ""), "image")
    direct = e.where(~F.col("type").isin(*PASSING)).select(W, "target", F.when(batch, "batch").otherwise(routed).alias("kind"), value.alias("value"), F.when(batch, F.col("items")).alias("items"), h.alias("handle"), "ord", F.lit(-1).alias("place"))
    direct = direct.where("kind is not null and (coalesce(value, '') <> '' or kind = 'batch' and size(items) > 0)")
    first = edges.where(h == CURVE).groupBy(W, "target").agg(F.min_by("source", "ord").alias("source"))
    own = first.join(src.where(F.col("type") == CURVE), [W, "source"]).where("curve <> ''").select(W, "target", F.lit("own").alias("kind"), F.col("curve").alias("value"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("handle"), F.lit(-1).cast("long").alias("ord"), F.lit(-1).alias("place"))
    direct = direct.union(own)

    carried = F.when(F.col("type") == "router", F.col("source_handle")).otherwise(F.col("input_type"))
    passing = e.where(F.col("type").isin(*PASSING)).select(W, "source", "target", "ord", F.when(carried.isin(*LISTED, "3d", "text", CURVE), carried).alias("kind"), F.lit(None).cast("string").alias("value"))
    asked = passing.select(W, F.col("source").alias("node_id")).distinct()
    large = settled(sized(e).where("not small").select(W))
    parts = asked.select(W, "node_id", F.lit(None).cast(nodes.schema["node_id"].dataType).alias("part"))
    if not large.isEmpty():
        inner = passing.join(large, W, "left_semi").join(asked.withColumnRenamed("node_id", "target"), [W, "target"], "left_semi")
        apart = components(inner)
        alone = asked.join(large, W, "left_semi").join(apart, [W, "node_id"], "left_anti")
        parts = asked.join(large, W, "left_anti").join(parts, [W, "node_id"]).union(apart).union(alone.withColumn("part", F.col("node_id")))
    given = direct.select(W, F.lit(None).cast(nodes.schema["node_id"].dataType).alias("source"), "target", "ord", "kind", "value").join(parts.withColumnRenamed("node_id", "target"), [W, "target"])
    ways = passing.join(parts.withColumnRenamed("node_id", "source"), [W, "source"])
    through = _through(given.unionByName(ways), dict(nodes.select(W, "node_id").dtypes))

    nothing = [F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("handle")]
    found = direct.select(W, "target", "kind", "value", "items", "handle", "ord", "place").union(through.select(W, "target", "kind", "value", *nothing, "ord", "place"))
    rows = found.select(W, F.col("target").alias("node_id"), "kind", "value", "items", "handle", F.struct("ord", "place").alias("ord"))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "value")))), lambda x: x["value"])
    latest = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("ord")))
    weak = F.min_by(F.when(F.col("kind") == "batch", F.col("value")), F.when(F.col("kind") == "batch", F.col("ord")))
    items = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("ord", "items")))), lambda x: x["items"]))
    out = rows.groupBy(W, "node_id").agg(listed("image").alias("images"), listed("video").alias("videos"), listed("audio").alias("audio"), latest("3d").alias("model3d"), F.coalesce(latest("text"), weak).alias("text"), items.alias("text_items"), F.coalesce(latest(CURVE), latest("own")).alias("ease_curve"))
    if schema is None:
        return out
    place = F.row_number().over(Window.partitionBy(W, "node_id", "kind").orderBy("pos")) - 1
    names = schema.withColumn("place", place).select(W, "node_id", "name", F.concat_ws("-", "kind", "place").alias("handle"), "kind", "place")
    names = names.select(W, "node_id", "name", F.explode(F.when(F.col("place") == 0, F.array("handle", "kind")).otherwise(F.array("handle"))).alias("handle"))
    given = rows.where("kind <> 'batch'").join(names, [W, "node_id", "handle"]).groupBy(W, "node_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))
    given = given.groupBy(W, "node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("dynamic"))
    return out.join(given, [W, "node_id"], "left")


def text_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, node_id, source): the nodes that give a node its text, seen through routers and switches by their text input.

    What a pass-through node stands for is found by doubling: each round follows what the round before has
    found, so a chain of routers takes the logarithm of its length in jobs.
    """
    passing = settled(nodes.where(F.col("type").isin(*PASSING)).select(W, F.col("node_id").alias("source")).distinct())
    real = nodes.where(~F.col("type").isin(*PASSING)).select(W, F.col("node_id").alias("source"))
    text = edges.where("target_handle = 'text'").select(W, "source", F.col("target").alias("via")).distinct()
    behind = settled(text.join(passing.withColumnRenamed("source", "via"), [W, "via"], "left_semi").select(W, "via", "source"))
    inner = settled(behind.join(passing, [W, "source"], "left_semi").select(W, "via", "source"))
    while True:
        further = inner.select(W, F.col("via").alias("source"), F.col("source").alias("further"))
        new = settled(inner.join(further, [W, "source"]).select(W, "via", F.col("further").alias("source")).distinct().join(inner, [W, "via", "source"], "left_anti"))
        if new.isEmpty():
            break
        inner = settled(inner.union(new))
    stands = inner.select(W, "via", F.col("source").alias("at")).union(passing.select(W, F.col("source").alias("via"), F.col("source").alias("at")))
    given = stands.join(behind.select(W, F.col("via").alias("at"), "source"), [W, "at"]).select(W, "via", "source")
    near = edges.select(W, F.col("target").alias("node_id"), "source").distinct()
    seen = near.union(near.withColumnRenamed("source", "via").join(given, [W, "via"]).select(W, "node_id", "source")).distinct()
    return seen.join(real, [W, "source"], "left_semi").select(W, "node_id", "source")
