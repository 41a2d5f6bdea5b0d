"""Inputs through routers and switches, and closures, against brute force: diamonds, cycles, long chains, large workflows."""

import random

import pytest

from loomspark.operators import flow, graph

NODES = "workflow_id long, node_id long, type string, value string, items array<string>, batch boolean, input_type string, curve string"
EDGES = "workflow_id long, ord long, source long, source_handle string, target long, target_handle string, item_index int"
CLOSED = "workflow_id long, source long, source_handle string"
KINDS = ["image", "text", "video", "audio", "3d", "easeCurve"]


def opened(node, nodes, edges, closed, seen):
    """What a node gets, by recursion: {kind: list or last}, where ``seen`` nodes give nothing."""
    got, kept, batch = {"image": [], "video": [], "audio": [], "3d": None, "text": None, "easeCurve": None, "items": []}, {}, None
    if node in seen:
        return got
    seen.add(node)
    for source, handle, target, into in edges:
        if target != node or (source, handle) in closed:
            continue
        kind, value, items, input_type, _ = nodes[source]
        if kind in ("router", "switch"):
            if source not in kept:
                kept[source] = opened(source, nodes, edges, closed, seen)
            carried = handle if kind == "router" else input_type
            if carried in ("image", "video", "audio"):
                got[carried] += kept[source][carried]
            elif carried in ("3d", "text", "easeCurve") and kept[source][carried]:
                got[carried] = kept[source][carried]
        elif kind == "array":
            if items:
                got["items"] += items
                batch = items[0] if got["text"] is None and batch is None else batch
                got["text"] = items[0] if got["text"] is None else got["text"]
        elif value:
            own = {"imageInput": "image", "videoInput": "video", "audioInput": "audio", "generate3d": "3d", "prompt": "text", "easeCurve": "video"}[kind]
            if own == "image" and into == "text":
                own = "text"
            if own in ("3d", "text"):
                got[own] = value
            elif own != "image" or into in ("image", None):
                got[own].append(value)
    if not got["easeCurve"]:
        first = next((e for e in edges if e[2] == node and e[3] == "easeCurve"), None)
        if first and nodes[first[0]][0] == "easeCurve":
            got["easeCurve"] = nodes[first[0]][4]
    return got


def drawn(draw, n, m):
    kinds = ["router"] * 5 + ["switch"] * 3 + ["imageInput", "prompt", "videoInput", "audioInput", "generate3d", "easeCurve", "array"]
    nodes = []
    for i in range(n):
        kind = draw.choice(kinds)
        nodes.append((kind, f"v{i}" if draw.random() < 0.8 else "", [f"x{i}", f"y{i}"] if kind == "array" else None, draw.choice(KINDS) if kind == "switch" else None, f"c{i}" if kind == "easeCurve" else None))
    edges = [(draw.randrange(n), draw.choice([*KINDS, "image", "text", None]), draw.randrange(n), draw.choice(["image", "text", "video", "easeCurve", None])) for _ in range(m)]
    closed = {(s, h) for s, h, *_ in edges if h is not None and draw.random() < 0.05}
    return nodes, edges, closed


def asked(spark, flows):
    nodes = [(w, i, k, v, items, k == "array", t, c) for w, (ns, _, _) in flows.items() for i, (k, v, items, t, c) in enumerate(ns)]
    edges = [(w, o, s, h, t, th, None) for w, (_, es, _) in flows.items() for o, (s, h, t, th) in enumerate(es)]
    closed = [(w, *c) for w, (_, _, cs) in flows.items() for c in cs]
    frames = (spark.createDataFrame(rows, schema) for rows, schema in ((nodes, NODES), (edges, EDGES), (closed, CLOSED)))
    return {(r["workflow_id"], r["node_id"]): r for r in flow.resolve_inputs(*frames).collect()}


@pytest.mark.parametrize("small", [20_000, 12])
def test_inputs_against_recursion(spark, monkeypatch, small):
    """Random graphs with diamonds, double edges and cycles, solved by workflow and by connected part."""
    monkeypatch.setattr(graph, "SMALL", small)
    draw = random.Random(6)
    flows = {w: drawn(draw, 14, draw.choice([8, 20, 30])) for w in range(60)}
    got, some = asked(spark, flows), 0
    for w, (nodes, edges, closed) in flows.items():
        for i in range(len(nodes)):
            want, r = opened(i, nodes, edges, closed, set()), got.get((w, i))
            given = (r["images"], r["videos"], r["audio"], r["model3d"], r["text"], r["text_items"], r["ease_curve"]) if r else ([], [], [], None, None, [], None)
            assert given == (want["image"], want["video"], want["audio"], want["3d"], want["text"], want["items"], want["easeCurve"]), (w, i)
            some += bool(r)
    assert some > 100


def test_diamonds_and_chains(spark, monkeypatch):
    """A value comes once through thirty diamonds, and through two thousand routers in a few jobs."""
    picture, router, node = ("imageInput", "PIC", None, None, None), ("router", None, None, None, None), ("nanoBanana", None, None, None, None)
    stacked = [(0, None, 1, "image")]
    for k in range(30):
        a = 1 + 3 * k
        stacked += [(a, "image", a + 1, "image"), (a, "image", a + 2, "image"), (a + 1, "image", a + 3, "image"), (a + 2, "image", a + 3, "image")]
    stacked.append((91, "image", 92, "image"))
    chain = [(0, None, 1, "image"), *[(i, "image", i + 1, "image") for i in range(1, 2_001)]]
    calls = []
    monkeypatch.setattr(graph, "SMALL", 1_000)
    own = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: calls.append(1) or own(df))
    got = asked(spark, {1: ([picture, *[router] * 91, node], stacked, set()), 2: ([picture, *[router] * 2_000, node], chain, set())})
    assert got[1, 92]["images"] == ["PIC"] and got[2, 2_001]["images"] == ["PIC"]
    assert len(calls) < 25


@pytest.mark.parametrize("small", [20_000, 5])
def test_closures(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    draw = random.Random(7)
    edges = [(w, draw.randrange(25), draw.randrange(25)) for w in range(8) for _ in range(draw.choice([3, 25, 40]))]
    e = spark.createDataFrame(edges, "workflow_id long, source long, target long")
    want = set()
    for w in range(8):
        found = {3, 4}
        while more := {t for v, s, t in edges if v == w and s in found} - found:
            found |= more
        want |= {(w, n) for n in found}
    seeds = spark.createDataFrame([(w, n) for w in range(8) for n in (3, 4, 4)], "workflow_id long, node_id long")
    assert sorted(map(tuple, graph.downstream(e, seeds).collect())) == sorted(want)
    parts = {(r["workflow_id"], r["node_id"]): r["part"] for r in graph.components(e).collect()}
    for w in range(8):
        label = {n: n for v, s, t in edges if v == w for n in (s, t)}
        for _ in range(30):
            for v, s, t in edges:
                if v == w:
                    label[s] = label[t] = min(label[s], label[t])
        assert {n: parts[w, n] for n in label} == label


def blocked_by_hand(edges, closed):
    """Components by reachability; the nodes of one together, until no more are blocked."""
    maybe = {t for s, h, t, _ in edges if (s, h) in closed}
    while more := {t for s, _, t, _ in edges if s in maybe} - maybe:
        maybe |= more
    reach = {n: {t for s, _, t, _ in edges if s == n and t in maybe} for n in maybe}
    for _ in maybe:
        for n in maybe:
            reach[n] |= {t for m in reach[n] for t in reach[m]}
    left, done = set(maybe), set()
    while left:
        first = next(n for n in sorted(left) if all(n in reach[m] and m in reach[n] or n not in reach[m] for m in left))
        ring = {m for m in left if m == first or first in reach[m] and m in reach[first]}
        while True:
            new = set()
            for n in ring - done:
                own = [(th, (s, h) in closed or s in done) for s, h, t, th in edges if t == n and th]
                shut = {th for th, off in own if off}
                if shut and not any(th in shut for th, off in own if not off):
                    new.add(n)
            if not new:
                break
            done |= new
        left -= ring
    return done


@pytest.mark.parametrize("small", [20_000, 3])
def test_blocked_with_cycles(spark, monkeypatch, small):
    """Large workflows, by levels, are the same where they have no cycle."""
    monkeypatch.setattr(graph, "SMALL", small)
    draw, rows, off, want = random.Random(9), [], [], set()
    for w in range(50):
        pairs = [(draw.randrange(12), draw.randrange(12)) for _ in range(draw.choice([10, 20]))]
        edges = [(s, f"s{draw.randrange(2)}", t, draw.choice(["image", "text", None])) for s, t in pairs if small > 3 or s < t]
        closed = {(draw.randrange(6), f"s{draw.randrange(2)}") for _ in range(3)}
        rows += [(w, *e) for e in edges]
        off += [(w, *c) for c in closed]
        want |= {(w, n) for n in blocked_by_hand(edges, closed)}
    e = spark.createDataFrame(rows, "workflow_id long, source long, source_handle string, target long, target_handle string")
    got = flow.blocked_nodes(e, spark.createDataFrame(off, "workflow_id long, source long, source_handle string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
