"""Queries on workflow graphs: workflows of 50 parts each, a tree with some edges across."""

from pyspark.sql import functions as F

from ..operators import dedup, edits, flow, graph, validate
from ..registry import query, table


def derived_graph(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("workflow_id"), (F.col("p_partkey") % 50).alias("node_id"), (F.col("p_size") % 6).alias("type"), "p_size")
    tree = p.where("node_id >= 1").select("workflow_id", F.floor((F.col("node_id") - 1) / 2).alias("source"), F.col("node_id").alias("target"))
    skip = p.where("node_id >= 3 and p_size % 2 = 0").select("workflow_id", (F.col("node_id") - 3).alias("source"), F.col("node_id").alias("target"))
    return p.select("workflow_id", "node_id", "type"), tree.union(skip)


GRAPH_SQL = """WITH RECURSIVE p AS (SELECT (p_partkey // 50)::BIGINT AS workflow_id, p_partkey % 50 AS node_id, p_size % 6 AS type, p_size FROM part),
e AS (SELECT workflow_id, (node_id - 1) // 2 AS source, node_id AS target FROM p WHERE node_id >= 1 UNION ALL SELECT workflow_id, node_id - 3, node_id FROM p WHERE node_id >= 3 AND p_size % 2 = 0)"""


@query(GRAPH_SQL + ", l AS (SELECT workflow_id, node_id, 0 AS level FROM p WHERE node_id = 0 UNION SELECT l.workflow_id, e.target, l.level + 1 FROM l JOIN e ON e.workflow_id = l.workflow_id AND e.source = l.node_id) SELECT workflow_id, node_id, max(level)::INT AS level FROM l GROUP BY 1, 2")
def graph_levels(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    return graph.levels(nodes, edges)


@query(GRAPH_SQL + ", r AS (SELECT workflow_id, node_id FROM p WHERE node_id = 5 UNION SELECT r.workflow_id, e.target FROM r JOIN e ON e.workflow_id = r.workflow_id AND e.source = r.node_id) SELECT workflow_id, node_id FROM r")
def graph_downstream(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    return graph.downstream(edges, nodes.where("node_id = 5").select("workflow_id", "node_id"))


@query(GRAPH_SQL + " SELECT workflow_id, type, count(*) AS n FROM p WHERE node_id >= 10 GROUP BY 1, 2")
def graph_type_counts(spark, sf_dir):
    nodes, _ = derived_graph(spark, sf_dir)
    return graph.type_counts(nodes, nodes.where("node_id < 10").select("workflow_id", "node_id"))


@query(GRAPH_SQL + " SELECT workflow_id, source, target, CASE WHEN source < 10 AND target < 10 THEN 'inside' WHEN source < 10 THEN 'outgoing' ELSE 'incoming' END AS side FROM e WHERE source < 10 OR target < 10")
def graph_subgraph_edges(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    return graph.split_edges(edges, nodes.where("node_id < 10").select("workflow_id", "node_id")).select("workflow_id", "source", "target", "side")


@query(GRAPH_SQL + " SELECT workflow_id, source, target, n FROM (SELECT workflow_id, source, target, row_number() OVER (PARTITION BY workflow_id, source, target) AS n FROM e) WHERE n > 1")
def graph_duplicate_edges(spark, sf_dir):
    _, edges = derived_graph(spark, sf_dir)
    return dedup.duplicate_ids(edges, ["workflow_id", "source", "target"], ["source"]).withColumnRenamed("occurrence", "n")


# -- what flows through them: types of nodes, handles of edges and closed outputs from the keys ------

TYPES = ["prompt", "imageInput", "router", "switch", "nanoBanana", "output"]
FLOW_SQL = f"""WITH RECURSIVE p AS (SELECT (p_partkey // 50)::BIGINT AS workflow_id, p_partkey % 50 AS node_id, {TYPES}[p_size % 6 + 1] AS type, p_size FROM part),
n AS (SELECT *, CASE WHEN type IN ('prompt', 'imageInput') AND node_id % 7 <> 3 THEN 'v' || node_id ELSE '' END AS value, CASE WHEN node_id % 2 = 0 THEN 'text' ELSE 'image' END AS input_type FROM p),
t AS (SELECT workflow_id, (node_id - 1) // 2 AS source, node_id AS target, node_id * 2 AS ord FROM p WHERE node_id >= 1 UNION ALL SELECT workflow_id, node_id - 3, node_id, node_id * 2 + 1 FROM p WHERE node_id >= 3 AND p_size % 2 = 0),
e AS (SELECT t.*, n.type AS from_type, n.input_type, n.value, CASE WHEN from_type = 'switch' THEN 's' || (t.target % 2) WHEN (t.source + t.target) % 2 = 0 THEN 'text' ELSE 'image' END AS source_handle, CASE WHEN (t.source + t.target) % 2 = 0 THEN 'text' ELSE 'image' END AS target_handle,
  from_type = 'switch' AND t.target % 2 = 1 AND t.source % 3 = 0 AS closed FROM t JOIN n ON n.workflow_id = t.workflow_id AND n.node_id = t.source)"""


def flow_graph(spark, sf_dir):
    """(nodes, edges, closed outputs)."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("workflow_id"), (F.col("p_partkey") % 50).alias("node_id"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("p_size") % 6 + 1).cast("int")).alias("type"), "p_size")
    given = F.when(F.col("type").isin("prompt", "imageInput") & (F.col("node_id") % 7 != 3), F.concat(F.lit("v"), "node_id")).otherwise("")
    nodes = p.select("workflow_id", "node_id", "type", given.alias("value"), F.lit(None).cast("array<string>").alias("items"), F.lit(False).alias("batch"), F.when(F.col("node_id") % 2 == 0, "text").otherwise("image").alias("input_type"), F.lit(None).cast("string").alias("own_image"))
    tree = p.where("node_id >= 1").select("workflow_id", F.floor((F.col("node_id") - 1) / 2).alias("source"), F.col("node_id").alias("target"), (F.col("node_id") * 2).alias("ord"))
    across = p.where("node_id >= 3 and p_size % 2 = 0").select("workflow_id", (F.col("node_id") - 3).alias("source"), F.col("node_id").alias("target"), (F.col("node_id") * 2 + 1).alias("ord"))
    kind = F.when((F.col("source") + F.col("target")) % 2 == 0, "text").otherwise("image")
    edges = tree.union(across).join(p.select("workflow_id", F.col("node_id").alias("source"), F.col("type").alias("from_type")), ["workflow_id", "source"])
    edges = edges.select("workflow_id", "source", "target", "ord", F.when(F.col("from_type") == "switch", F.concat(F.lit("s"), F.col("target") % 2)).otherwise(kind).alias("source_handle"), kind.alias("target_handle"), F.lit(None).cast("int").alias("item_index"))
    switches = nodes.where("type = 'switch'").select("workflow_id", "node_id", F.lit("s1").alias("handle"), (F.col("node_id") % 3 != 0).alias("enabled"))
    rules = nodes.where("false").select("workflow_id", "node_id", F.lit("").alias("handle"), F.lit(True).alias("matched"), F.lit(False).alias("paused"))
    return nodes, edges, flow.closed_outputs(switches, rules)


@query(GRAPH_SQL + ", l AS (SELECT workflow_id, node_id, 0 AS level FROM p WHERE node_id = 0 UNION SELECT l.workflow_id, e.target, l.level + 1 FROM l JOIN e ON e.workflow_id = l.workflow_id AND e.source = l.node_id WHERE e.target < 25), m AS (SELECT workflow_id, node_id, max(level) AS level FROM l GROUP BY 1, 2) SELECT workflow_id, node_id, row_number() OVER (PARTITION BY workflow_id ORDER BY level, node_id) AS place FROM m")
def graph_topo_order(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    return graph.topo_order(nodes, edges, nodes.where("node_id < 25"))


@query(GRAPH_SQL + " SELECT workflow_id, source, target, count(*) AS n FROM e WHERE source % 5 <> 4 AND target % 5 <> 4 GROUP BY 1, 2, 3")
def graph_resolved_edges(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    return graph.resolve_edges(nodes.where("node_id % 5 <> 4"), edges).groupBy("workflow_id", "source", "target").agg(F.count("*").alias("n"))


@query(GRAPH_SQL + " SELECT workflow_id, 'node' AS kind, (node_id || '-copy') AS a, NULL AS b FROM p WHERE node_id < 10 UNION ALL SELECT workflow_id, 'edge', source || '-copy', target || '-copy' FROM e WHERE source < 10 AND target < 10")
def graph_copy(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    placed = nodes.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    n, e = graph.copy_paste(placed, edges, nodes.where("node_id < 10"))
    return n.select("workflow_id", F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b")).union(e.select("workflow_id", F.lit("edge"), "source", "target"))


@query(GRAPH_SQL + " SELECT workflow_id, 'inside' AS part, count(*) AS n FROM p WHERE node_id < 10 OR workflow_id % 2 = 1 GROUP BY 1 UNION ALL SELECT workflow_id, CASE WHEN workflow_id % 2 = 1 OR source < 10 AND target < 10 THEN 'edge inside' WHEN source < 10 THEN 'edge outgoing' ELSE 'edge incoming' END, count(*) FROM e WHERE source < 10 OR target < 10 OR workflow_id % 2 = 1 GROUP BY 1, 2 UNION ALL SELECT workflow_id, 'other type ' || type, count(*) FROM p WHERE node_id >= 10 AND workflow_id % 2 = 0 GROUP BY 1, 2")
def graph_subgraph(spark, sf_dir):
    nodes, edges = derived_graph(spark, sf_dir)
    inside, touching, rest = graph.subgraph(nodes, edges, nodes.where("node_id < 10 and workflow_id % 2 = 0"))
    a = inside.groupBy("workflow_id").agg(F.lit("inside").alias("part"), F.count("*").alias("n"))
    b = touching.groupBy("workflow_id", F.concat(F.lit("edge "), "side").alias("part")).agg(F.count("*").alias("n"))
    return a.union(b).union(rest.select("workflow_id", F.concat(F.lit("other type "), "type").alias("part"), "n"))


@query()
def graph_blocked(spark, sf_dir):
    _, edges, closed = flow_graph(spark, sf_dir)
    return flow.blocked_nodes(edges, closed)


@query(FLOW_SQL + ", s AS (SELECT workflow_id, node_id FROM n WHERE type IN ('prompt', 'imageInput') AND value = '' AND node_id % 10 <> 0 UNION SELECT s.workflow_id, e.target FROM s JOIN e ON e.workflow_id = s.workflow_id AND e.source = s.node_id WHERE e.target % 10 <> 0) SELECT workflow_id, node_id FROM s")
def graph_skipped(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    marked = nodes.withColumn("is_skippable", flow.is_skippable("type", F.lit(True), "value"))
    return flow.skipped_nodes(marked, edges, nodes.where("node_id % 10 = 0"))


#: From each node, the ways through routers and switches; of the ways to one of them the least by edge order opens it. Values then come along these alone.
INPUTS_SQL = FLOW_SQL + """, q AS (SELECT *, CASE WHEN from_type = 'router' THEN source_handle ELSE input_type END AS carried FROM e WHERE NOT closed AND from_type IN ('router', 'switch')),
f AS (SELECT workflow_id, target, 'image' AS kind, value, ord FROM e WHERE NOT closed AND from_type = 'imageInput' AND value <> '' AND target_handle = 'image' UNION ALL SELECT workflow_id, target, 'text', value, ord FROM e WHERE NOT closed AND value <> '' AND (from_type = 'prompt' OR from_type = 'imageInput' AND target_handle = 'text')),
w AS (SELECT workflow_id, target AS t, source AS r, target AS opener, [ord] AS o FROM q UNION ALL SELECT w.workflow_id, w.t, q.source, q.target, w.o || [q.ord] FROM w JOIN q ON q.workflow_id = w.workflow_id AND q.target = w.r),
m AS (SELECT workflow_id, t, r, arg_min(opener, o) AS opener FROM w GROUP BY 1, 2, 3),
y AS (SELECT q.workflow_id, q.target AS t, q.source AS r, q.carried AS kind, [q.ord] AS o FROM q JOIN m ON m.workflow_id = q.workflow_id AND m.t = q.target AND m.r = q.source AND m.opener = q.target
  UNION ALL SELECT y.workflow_id, y.t, q.source, y.kind, y.o || [q.ord] FROM y JOIN q ON q.workflow_id = y.workflow_id AND q.target = y.r AND q.carried = y.kind JOIN m ON m.workflow_id = y.workflow_id AND m.t = y.t AND m.r = q.source AND m.opener = y.r),
r AS (SELECT workflow_id, target, kind, value, [ord] AS o FROM f UNION ALL SELECT y.workflow_id, y.t, y.kind, f.value, y.o || [f.ord] FROM y JOIN f ON f.workflow_id = y.workflow_id AND f.target = y.r AND f.kind = y.kind)
"""


@query(INPUTS_SQL + "SELECT workflow_id, target AS node_id, array_to_string(coalesce(list(value ORDER BY o) FILTER (kind = 'image'), []), ',') AS images, arg_max(value, o) FILTER (kind = 'text') AS text FROM r GROUP BY 1, 2")
def graph_inputs(spark, sf_dir):
    nodes, edges, closed = flow_graph(spark, sf_dir)
    return flow.resolve_inputs(nodes, edges, closed).select("workflow_id", "node_id", F.array_join("images", ",").alias("images"), "text")


@query(FLOW_SQL + ", r AS (SELECT workflow_id, target AS node_id, source FROM e UNION SELECT r.workflow_id, r.node_id, e.source FROM r JOIN e ON e.workflow_id = r.workflow_id AND e.target = r.source AND e.target_handle = 'text' JOIN n ON n.workflow_id = r.workflow_id AND n.node_id = r.source AND n.type IN ('router', 'switch')) SELECT r.workflow_id, r.node_id, r.source FROM r JOIN n ON n.workflow_id = r.workflow_id AND n.node_id = r.source WHERE n.type NOT IN ('router', 'switch')")
def graph_text_sources(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    return flow.text_sources(nodes, edges)


@query(FLOW_SQL + """ SELECT workflow_id, CASE type WHEN 'nanoBanana' THEN 'Generate node "' || node_id || '" missing text input' ELSE 'Output node "' || node_id || '" missing image input' END AS message FROM n
WHERE type = 'nanoBanana' AND NOT EXISTS (SELECT 1 FROM e WHERE e.workflow_id = n.workflow_id AND e.target = n.node_id AND e.target_handle = 'text') OR type = 'output' AND NOT EXISTS (SELECT 1 FROM e WHERE e.workflow_id = n.workflow_id AND e.target = n.node_id)""")
def graph_missing_inputs(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    return validate.validate_inputs(nodes.select("workflow_id"), nodes, edges)


@query(FLOW_SQL + """, w AS (SELECT DISTINCT workflow_id FROM p) SELECT workflow_id, 'name' AS path, 'Name must be a non-empty string' AS message FROM w WHERE workflow_id % 3 = 0 UNION ALL
SELECT workflow_id, 'nodes[' || node_id || '].id', 'Duplicate node id: 7' FROM p WHERE node_id = 8 UNION ALL SELECT workflow_id, 'nodes[' || node_id || '].position', 'Position must have numeric x and y values' FROM p WHERE node_id % 9 = 0 UNION ALL
SELECT workflow_id, 'edges[' || ord || '].source', 'Source node not found: 8' FROM e WHERE source = 8 UNION ALL SELECT workflow_id, 'edges[' || ord || '].target', 'Target node not found: 8' FROM e WHERE target = 8 UNION ALL
SELECT workflow_id, 'edges[' || ord || '].sourceHandle', 'Invalid sourceHandle: ' || source_handle FROM e WHERE from_type = 'switch' UNION ALL SELECT workflow_id, 'edges[' || ord || ']', 'Handle type mismatch: ' || source_handle || ' → ' || target_handle FROM e WHERE source_handle <> target_handle""")
def graph_problems(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    docs = nodes.select("workflow_id").distinct().withColumns({"version": F.lit(1), "name": F.when(F.col("workflow_id") % 3 != 0, "flow")})
    n = nodes.select("workflow_id", F.col("node_id").alias("ord"), F.when(F.col("node_id") == 8, 7).otherwise(F.col("node_id")).cast("string").alias("node_id"), "type", F.when(F.col("node_id") % 9 != 0, 1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(True).alias("has_position"), F.lit(True).alias("has_data"))
    e = edges.select("workflow_id", "ord", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "source_handle", "target_handle")
    return validate.validate_documents(docs, n, e)


@query(FLOW_SQL + """ SELECT workflow_id, count(*) AS nodes, count(*) FILTER (node_id % 4 = 1 OR type = 'prompt') AS prompts, sum(CASE WHEN node_id % 9 = 0 THEN 50 + node_id * 400 ELSE 1 END)::DOUBLE AS x,
(SELECT count(*) FROM e WHERE e.workflow_id = n.workflow_id AND e.source % 5 <> 0 AND e.target % 5 <> 0 AND e.source_handle = e.target_handle) AS edges FROM n GROUP BY workflow_id""")
def graph_repaired(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    n = nodes.select("workflow_id", F.col("node_id").alias("ord"), F.when(F.col("node_id") % 5 != 0, F.col("node_id").cast("string")).alias("node_id"), F.when(F.col("node_id") % 4 == 1, "odd").otherwise(F.col("type")).alias("type"), F.when(F.col("node_id") % 9 != 0, 1.0).alias("x"), F.lit(1.0).alias("y"))
    e = edges.select("workflow_id", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "source_handle", "target_handle")
    n, e = validate.repair_documents(n, e)
    a = n.groupBy("workflow_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "prompt").alias("prompts"), F.sum("x").alias("x"))
    return a.join(e.groupBy("workflow_id").agg(F.count("*").alias("edges")), "workflow_id", "left").fillna(0, ["edges"])


@query(FLOW_SQL + " SELECT e.workflow_id, e.ord, CASE WHEN from_type = 'switch' THEN input_type = target_handle ELSE source_handle = target_handle END AS compatible FROM e")
def graph_compatible(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    return validate.compatible_edges(nodes, edges).select("workflow_id", "ord", "compatible")


@query(GRAPH_SQL + """ SELECT workflow_id::VARCHAR AS workflow_id, CASE WHEN workflow_id % 2 = 0 THEN 3 ELSE 4 END AS applied, CASE WHEN workflow_id % 2 = 0 THEN 'updateNode: node "5" not found' ELSE '' END AS skipped, (SELECT count(*) FROM p p2 WHERE p2.workflow_id = p.workflow_id) + workflow_id % 2 AS n_nodes,
(SELECT count(*) FROM e WHERE e.workflow_id = p.workflow_id AND source <> 5 AND target <> 5 OR e.workflow_id = p.workflow_id AND p.workflow_id % 2 = 1) + 1 AS n_edges FROM p WHERE node_id = 0""")
def graph_edits(spark, sf_dir):
    """Even workflows lose node 5 before it is changed, odd ones change it; all get a node and an edge, and a change of node 6."""
    nodes, edges = derived_graph(spark, sf_dir)
    w = nodes.select("workflow_id").distinct()
    op = lambda i, kind, **c: F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("type"), *[(v if not isinstance(v, str | None) else F.lit(v).cast("string")).alias(k) for k, v in ({"node_id": None, "node_type": None, "source": None, "target": None, "data": None} | c).items()])
    first = F.when(F.col("workflow_id") % 2 == 0, op(0, "removeNode", node_id="5")).otherwise(op(0, "updateNode", node_id="5", data='{"a": 1}'))
    ops = w.select("workflow_id", F.explode(F.array(first, op(1, "updateNode", node_id="5", data='{"b": 2}'), op(2, "addNode", node_type="prompt"), op(3, "addEdge", source="1", target="2"))).alias("o")).select("workflow_id", "o.*")
    ids = edges.withColumn("edge_id", F.concat_ws("-", "source", "target"))
    done = edits.apply_edits(nodes.withColumn("data", F.lit("{}")), ids, ops)
    return done.select("workflow_id", "applied", F.array_join("skipped", "; ").alias("skipped"), F.size("node_ids").cast("long").alias("n_nodes"), F.size("edge_ids").cast("long").alias("n_edges"))


@query(FLOW_SQL + " SELECT DISTINCT workflow_id, target AS node_id FROM e WHERE ord % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.workflow_id = e.workflow_id AND x.target = e.target AND x.ord % 2 = 1 AND x.from_type IN ('imageInput', 'nanoBanana'))")
def graph_stale_inputs(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    return edits.stale_inputs(nodes, edges.where("ord % 2 = 1"), edges.where("ord % 2 = 0"))


@query(FLOW_SQL + """, l AS (SELECT workflow_id, 0 AS k, node_id::VARCHAR AS i, '- ' || CASE WHEN node_id % 2 = 0 THEN 'T' || node_id ELSE type END AS line FROM n UNION ALL
SELECT e.workflow_id, 1, e.source || '>' || e.target, CASE WHEN e.source % 2 = 0 THEN 'T' || e.source ELSE e.from_type END || ' → ' || CASE WHEN e.target % 2 = 0 THEN 'T' || e.target ELSE n.type END FROM e JOIN n ON n.workflow_id = e.workflow_id AND n.node_id = e.target)
SELECT workflow_id, string_agg(line, chr(10) ORDER BY k, i, line) AS listing FROM l GROUP BY 1""")
def graph_listing(spark, sf_dir):
    nodes, edges, _ = flow_graph(spark, sf_dir)
    return edits.describe_graph(nodes.withColumn("title", F.when(F.col("node_id") % 2 == 0, F.concat(F.lit("T"), "node_id"))), edges)


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'Added a prompt node' WHEN 'error' THEN 'Removed node ' || user_id WHEN 'click' THEN 'Updated ' || user_id || ' settings' WHEN 'view' THEN 'Connected ' || user_id || ' to ' || event_id ELSE 'Removed connection ' || event_id END AS line FROM events")
def edit_sentences(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "addNode", "error", "removeNode", "click", "updateNode", "view", "addEdge", "purchase", "removeEdge")])
    e = table(spark, sf_dir, "events").select("event_id", kind[F.col("event_type")].alias("type"), F.lit("prompt").alias("node_type"), F.col("user_id").alias("node_id"), F.col("user_id").alias("source"), F.col("event_id").alias("target"), F.col("event_id").alias("edge_id"))
    return e.select("event_id", edits.narrate_op().alias("line"))


@query("SELECT workflow_id, node_id, CASE WHEN node_id % 3 = 0 THEN 'new ' || node_id ELSE 'old' END AS prompt, CASE WHEN node_id % 6 = 0 THEN 'img' END AS image FROM (SELECT p_partkey // 50 AS workflow_id, p_partkey % 50 AS node_id FROM part)")
def template_overlay(spark, sf_dir):
    nodes = derived_graph(spark, sf_dir)[0].select("workflow_id", "node_id", F.col("workflow_id").alias("template"), F.lit("full").alias("level"), F.lit("old").alias("prompt"), F.lit(None).cast("string").alias("image"))
    content = nodes.where("node_id % 3 = 0").select("template", "level", "node_id", F.concat(F.lit("new "), "node_id").alias("prompt"), F.when(F.col("node_id") % 6 == 0, "img").alias("image"))
    return edits.overlay(nodes, content).select("workflow_id", "node_id", "prompt", "image")


@query(GRAPH_SQL + " SELECT p.workflow_id, p.node_id, p.type FROM p WHERE EXISTS (SELECT 1 FROM e WHERE e.workflow_id = p.workflow_id AND e.target = p.node_id AND e.source % 3 = 1)")
def graph_overlap(spark, sf_dir):
    """The nodes that edges from every third node lead to."""
    nodes, edges = derived_graph(spark, sf_dir)
    return graph.overlap(nodes, edges.where("source % 3 = 1").select("workflow_id", F.col("target").alias("node_id")))
