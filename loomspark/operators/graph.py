"""Workflow graphs, many at once, keyed by workflow_id."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "workflow_id"


#: Edges up to which a workflow's levels are found in one task, together with others; larger ones are solved level by level over the cluster.
SMALL = 20_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's checkpoint folder; a temporary one where that is unset on a single machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's checkpoint folder and read again, so that loops keep a short lineage."""
    path = shared_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(nodes: list, edges: list) -> dict:
    """Level of each node that has one, for one workflow."""
    open_, after = dict.fromkeys(nodes, 0), defaultdict(list)
    for source, target in set(edges):
        if target in open_:
            open_[target] += 1
            after[source].append(target)
    front, level, out = [n for n, k in open_.items() if not k], 0, {}
    while front:
        out |= dict.fromkeys(front, level)
        freed = []
        for n in front:
            for t in after[n]:
                open_[t] -= 1
                if not open_[t]:
                    freed.append(t)
        front, level = freed, level + 1
    return out


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, node_id, level): 0 without incoming edges, else one more than the deepest source.

    Nodes on or behind a cycle get no level, nor do targets of an edge from a missing source; edges to
    missing targets are ignored. Workflows of SMALL edges and nodes at most are solved whole, one in a
    group; of larger ones, each round over the cluster resolves the nodes whose sources are resolved.
    """
    nodes, edges = nodes.select(W, "node_id").distinct(), edges.select(W, "source", "target").distinct()
    size = sized(nodes, edges)
    nodes, edges = (settled(x.join(size, W)) for x in (nodes, edges))
    kind = nodes.schema
    out = f"{W} {kind[W].dataType.simpleString()}, node_id {kind['node_id'].dataType.simpleString()}, level int"

    def solve(n: pa.Table, e: pa.Table) -> pa.Table:
        found = _ranked(n["node_id"].to_pylist(), list(zip(e["source"].to_pylist(), e["target"].to_pylist(), strict=True)))
        key = n[W][0] if found else None
        return pa.table({W: pa.array([key.as_py()] * len(found) if found else [], n.schema.field(W).type), "node_id": pa.array(list(found), n.schema.field("node_id").type), "level": pa.array(list(found.values()), pa.int32())})

    small = [x.where("small").drop("small").groupBy(W) for x in (nodes, edges)]
    done = small[0].cogroup(small[1]).applyInArrow(solve, out)
    left, edges = (x.where("not small").drop("small") for x in (nodes, edges))
    if left.isEmpty():
        return done
    needs = edges.groupBy(W, F.col("target").alias("node_id")).agg(F.count("*").alias("open"))
    left, level = settled(left.join(needs, [W, "node_id"], "left").fillna(0, ["open"])), 0
    while True:
        front = left.where("open = 0").select(W, "node_id", F.lit(level).alias("level"))
        if front.isEmpty():
            return done
        done = done.union(front)
        freed = front.join(edges.withColumnRenamed("source", "node_id"), [W, "node_id"]).groupBy(W, F.col("target").alias("node_id")).agg(F.count("*").alias("freed"))
        left = settled(left.where("open > 0").join(freed, [W, "node_id"], "left").select(W, "node_id", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")))
        level += 1


def topo_order(nodes: DataFrame, edges: DataFrame, subset: DataFrame) -> DataFrame:
    """(workflow_id, node_id, place): the nodes of a subset with sources before targets, by level and id; those on cycles come last."""
    ids = subset.select(W, "node_id").distinct()
    inner = split_edges(edges, ids).where("side = 'inside'")
    found = ids.join(levels(ids, inner), [W, "node_id"], "left")
    return found.select(W, "node_id", F.row_number().over(Window.partitionBy(W).orderBy(F.col("level").asc_nulls_last(), "node_id")).alias("place"))


#: Hops of a closure that one job takes, in workflows too large for one task.
HOPS = 4


def sized(*tables: DataFrame) -> DataFrame:
    """(workflow_id, small): whether a workflow's rows in all tables are SMALL at most."""
    rows = tables[0].select(W)
    for t in tables[1:]:
        rows = rows.union(t.select(W))
    return rows.groupBy(W).agg((F.count("*") <= SMALL).alias("small"))


def _led_to(seeds: list, edges: list) -> list:
    """The seeds and all that they lead to, in one workflow."""
    after = defaultdict(list)
    for source, target in edges:
        after[source].append(target)
    found, todo = dict.fromkeys(seeds), list(seeds)
    while todo:
        for target in after.get(todo.pop(), ()):
            if target not in found:
                found[target] = None
                todo.append(target)
    return list(found)


def downstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and all that they lead to. Workflows of SMALL rows at most are solved whole, one in a group; larger ones over the cluster, HOPS hops a job."""
    edges, seeds = edges.select(W, F.col("source").alias("node_id"), "target").distinct(), seeds.select(W, "node_id").distinct()
    size = settled(sized(edges, seeds))
    edges, seeds = (settled(x.join(size, W)) for x in (edges, seeds))
    kind = seeds.schema

    def solve(s: pa.Table, e: pa.Table) -> pa.Table:
        found = _led_to(s["node_id"].to_pylist(), list(zip(e["node_id"].to_pylist(), e["target"].to_pylist(), strict=True)))
        key = s[W][0].as_py() if found else None
        return pa.table({W: pa.array([key] * len(found), s.schema.field(W).type), "node_id": pa.array(found, s.schema.field("node_id").type)})

    small = [x.where("small").drop("small").groupBy(W) for x in (seeds, edges)]
    done = small[0].cogroup(small[1]).applyInArrow(solve, f"{W} {kind[W].dataType.simpleString()}, node_id {kind['node_id'].dataType.simpleString()}")
    if size.where("not small").isEmpty():
        return done
    edges, found = (x.where("not small").drop("small") for x in (edges, seeds))
    front = found
    while True:
        near = front
        for _ in range(HOPS):
            front = front.join(edges, [W, "node_id"]).select(W, F.col("target").alias("node_id")).distinct()
            near = near.union(front)
        front = settled(near.distinct().join(found, [W, "node_id"], "left_anti"))
        if front.isEmpty():
            return done.union(found)
        found = settled(found.union(front))


def components(edges: DataFrame) -> DataFrame:
    """(workflow_id, node_id, part): the least node of each node's connected component, whatever the edges' direction.

    Each round hooks a component's label to the least label beside it and then lets every label point to what its
    own label points to until nothing moves, so a chain takes a round and the logarithm of its length in jobs.
    """
    ends = edges.select(W, F.col("source").alias("a"), F.col("target").alias("b"))
    links = settled(ends.union(ends.select(W, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(links.select(W, F.col("a").alias("node_id"), F.col("a").alias("part")).distinct())
    while True:
        of = lambda end: labels.select(W, F.col("node_id").alias(end), F.col("part").alias(f"of_{end}"))  # noqa: E731, B023
        hooks = links.join(of("a"), [W, "a"]).join(of("b"), [W, "b"]).where("of_b < of_a").groupBy(W, F.col("of_a").alias("part")).agg(F.min("of_b").alias("to"))
        hooks = settled(hooks)
        if hooks.isEmpty():
            return labels
        while True:
            further = hooks.select(W, F.col("part").alias("to"), F.col("to").alias("further"))
            jumped = settled(hooks.join(further, [W, "to"], "left").select(W, "part", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            hooks = jumped.select(W, "part", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = settled(labels.join(hooks, [W, "part"], "left").select(W, "node_id", F.coalesce("to", "part").alias("part")))


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select(W, "node_id").distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), [W, end], "left_semi")
    return edges


def split_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges that touch a selection: side is inside, outgoing or incoming."""
    out = edges
    for end in ("source", "target"):
        out = out.join(selected.select(W, F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")).distinct(), [W, end], "left")
    side = F.when(F.col("_source") & F.col("_target"), "inside").when(F.col("_source"), "outgoing").when(F.col("_target"), "incoming")
    return out.withColumn("side", side).where("side is not null").drop("_source", "_target")


def overlap(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """The nodes that a selection names, each once, however often it names them; names without a node are ignored."""
    return nodes.join(selected.select(W, "node_id"), [W, "node_id"], "left_semi")


def type_counts(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Nodes outside a selection, by type."""
    return nodes.join(selected.select(W, "node_id"), [W, "node_id"], "left_anti").groupBy(W, "type").agg(F.count("*").alias("n"))


def copy_paste(nodes: DataFrame, edges: DataFrame, selected: DataFrame, suffix: str = "-copy", offset: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Copies of the selected nodes, moved by an offset, and of the edges among them."""
    ids = selected.select(W, "node_id").distinct()
    copies = nodes.join(ids, [W, "node_id"], "left_semi").withColumns({"node_id": F.concat(F.col("node_id").cast("string"), F.lit(suffix)), "x": F.col("x") + offset, "y": F.col("y") + offset})
    inner = split_edges(edges, ids).where("side = 'inside'").drop("side")
    return copies, inner.withColumns({e: F.concat(F.col(e).cast("string"), F.lit(suffix)) for e in ("source", "target")})


def subgraph(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges with their side, counts by type of the other nodes); a workflow without a selection is whole."""
    picked = selected.select(W, "node_id").distinct()
    rest = nodes.join(picked.select(W).distinct(), W, "left_anti").select(W, "node_id")
    picked = settled(picked.union(rest))
    return nodes.join(picked, [W, "node_id"], "left_semi"), split_edges(edges, picked), type_counts(nodes, picked)


#: Fixed value: the space between placed items.
GAP = 20.0


def stack(items: DataFrame, key: list[str], ord_: list[str], size: str, gap: float = GAP) -> DataFrame:
    """Each item's offset behind those before it, with a gap between two."""
    before = Window.partitionBy(*key).orderBy(*ord_).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("offset", F.coalesce(F.sum(F.col(size) + gap).over(before), F.lit(0.0)))


def grid(items: DataFrame, key: list[str], ord_: list[str]) -> DataFrame:
    """Row and column of each item in the smallest square grid that holds them all."""
    w = Window.partitionBy(*key)
    place, columns = F.row_number().over(w.orderBy(*ord_)) - 1, F.ceil(F.sqrt(F.count("*").over(w)))
    return items.withColumns({"row": F.floor(place / columns), "column": place % columns})
