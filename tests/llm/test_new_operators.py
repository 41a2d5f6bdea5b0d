"""Centroid clustering, conversation repair and exact deduplication against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import centroids, conversation_repair, exact_dedup, queries
from loomspark.llm.conversation_repair import Lattice, cheapest, faults_of

# -- exact deduplication ---------------------------------------------------------------------------

LONG = "word and  word\t" * 40_000
DOCS = [
    (1, "a  b", "x"), (2, "a b", "y"), (3, "a\n\t b", None), (3, "a\n\t b", None), (9, " a b", "x"), (8, None, "x"), (7, "", "x"), (6, " \r\n ", "x"), (5, " ", "x"), (4, "\x85\xa0", "x"),
    (None, "a b", "x"), (None, "lost", "x"), (None, "lost", "x"), (12, LONG, "x"), (11, LONG.replace("\t", " "), "x"), (1, "a b", "other text of a used id"), (20, "é\0", "x"), (21, "é\0", "x"),
]


def copies_by_hand(rows):
    groups = {}
    for i, text, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(norm, []).append(i)
    out = []
    for norm, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            out.append((i, least, len(ids), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, weak):
    """Also with a hash that collides: the first character's, and one hash for everything."""
    rows = [(*r, "h", 5, True) for r in DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, norm string, hash string, row int, kept boolean").repartition(3)
    for digest in ([lambda c: F.md5(F.substring(c, 1, 1)), lambda c: F.md5(F.lit("one"))] if weak else [F.md5]):
        got = exact_dedup.group_copies(docs, digest=digest)
        assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
        assert sorted(map(tuple, got.collect()), key=repr) == copies_by_hand(DOCS)
    assert exact_dedup.group_copies(docs.where("false")).collect() == []


def test_a_hot_group_is_whole(spark):
    """A third of all rows are one text."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same  text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    got = exact_dedup.group_copies(docs)
    assert got.where("kept").count() == 2_001 and got.where("group_size = 1000 and keep_id = 0").count() == 1_000


# -- conversation repair ---------------------------------------------------------------------------


def least_edits(initials, faults):
    """All states turn by turn, with the least (cost, audit) of each."""
    after, new = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}, {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = new[state]
                best[to] = min(best.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return best

    for initial, fault in zip(initials, faults, strict=True):
        out = {}
        for state, (cost, audit) in inserted(best).items():
            options = [(state, cost + 4, "D")]
            if fault in (0, 3):
                more = 3 if fault == 3 else 0
                options.append((new[state], cost + 3 + more, "R"))
                if (state, initial) in after:
                    options.append((after[state, initial], cost + more, "K"))
            for to, total, edit in options:
                out[to] = min(out.get(to, (10**9, "")), (total, audit + edit))
        best = out
    best = inserted(best)
    return min(best[x] for x in ("", "a") if x in best)


def test_cheapest_edits_have_the_least_audit():
    draw = random.Random(12)
    for _ in range(3_000):
        n = draw.randrange(12)
        initials, faults = [draw.choice(["s", "u", "u", "a", "a", " ", ""]) for _ in range(n)], [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        cost, audit, _ = cheapest(Lattice(initials, faults))
        assert (cost, audit) == least_edits(initials, faults)
    initials, faults = [draw.choice("sua") for _ in range(20_000)], [draw.choice([0, 0, 1, 3]) for _ in range(20_000)]
    assert cheapest(Lattice(initials, faults))[:2] == least_edits(initials, faults)


def test_faults():
    assert faults_of([("user", "a."), ("user", "a."), ("user", " \v"), ("user", "b"), ("user", "b! \n"), ("assistant", "a."), ("user", "\x85"), ("user", " \v")]) == [0, 2, 1, 3, 0, 0, 3, 1]


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 3, "assistant", "Yes"), (1, 4, "user", "Hi!"), (1, None, "user", None), (1, 9, None, "Who?"),
    (2, 5, "assistant", "One."), (2, 5, "assistant", "One."), (2, 2, "user", "Two? "), (3, None, "tool", "x."), (None, 1, "user", "A."), (None, 2, "assistant", "B."), (4, 0, "user", "long. " * 50_000), (5, 1, "user", ""),
]


def repaired_by_hand(rows):
    """{conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, text)} of (key, turn, role, text, copies)."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key for _ in range(r[4])), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", " " if r[3] is None else r[3]))
        own = [(t, " " if a is None else a, " " if b is None else b) for _, t, a, b, _ in own]
        faults, initials, numbers = faults_of([(a, b) for _, a, b in own]), [a[:1] for _, a, _ in own], {t for t, *_ in own if t is not None}
        cost, audit = least_edits(initials, faults)
        at, kept, last = iter(own), [], ""
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(at)[1:]
            if edit != "D":
                if edit != "K":
                    role = "assistant" if last == "u" else "user"
                last = role[:1]
                kept.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[key] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, "\n".join(kept))
    return out


def found(df):
    return {r["conv_id"]: (*r[1:8], "\n".join(f"{t['role']}:{t['text']}" for t in r["turns"])) for r in df.collect()}


def test_conversations(spark):
    rows = [(*r, 1, "clash") for r in TURNS]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int, audit string").repartition(3)
    want = repaired_by_hand([r[:5] for r in rows])
    assert found(conversation_repair.repair(table)) == want and len(want) == 6
    none = conversation_repair.repair(table.withColumn("copies", F.lit(0)), copies="copies")
    assert found(none) == {k: (0, 0, 0, 0, 0, 0, "", "") for k in want}
    assert conversation_repair.repair(table.where("false")).collect() == []


def test_damage(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").union(spark.createDataFrame([(None, None, None, None), (7_000, None, None, "A!b?c.")], "conv_id long, turn long, role string, text string"))
    rows = []
    for r in table.collect():
        key, turn, role, text = (" " if x is None else str(x) for x in r)
        case = zlib.crc32(f"{key}:{turn}".encode()) % 20
        text = "" if case in (0, 1) else re.sub("[.!?]", "", text) if case == 2 else text
        rows.append((r[0], r[1], "user" if case == 4 else role, text, {0: 0, 3: 2}.get(case, 1)))
    damaged = conversation_repair.damage(table)
    assert sorted(map(tuple, damaged.collect()), key=repr) == sorted(rows, key=repr)
    assert found(conversation_repair.repair(damaged, copies="copies")) == repaired_by_hand(rows)


# -- centroid clustering ---------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 3), (3, 2), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    """Every cell once, and each one step from the next."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=lambda i: keys[i])].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_leave_every_nearest_centroid():
    draw = np.random.default_rng(3)
    for size in (3, 1000, 1 << 26):
        for _ in range(200):
            v, c = draw.integers(-size, size, (9, 4)) // 8 + draw.integers(-size, size, 4), draw.integers(-size, size, (7, 4))
            far = ((v[:, None].astype(object) - c) ** 2).sum(2)
            at, distance = centroids.nearest(v, v.min(0), v.max(0), c)
            assert at.tolist() == far.argmin(1).tolist() and distance.tolist() == far.min(1).tolist()


def clusters_by_hand(rows, k, rounds, dims):
    own = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v)]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cs[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in own]
    return sorted(((i, n, d, sum(x[2] for x in got if x[1] == n), sum(x[2] for x in got), cs[n]) for i, n, d in got), key=repr)


def test_clusters(spark):
    draw = np.random.default_rng(1)
    middle = draw.normal(0, 3, (4, 5))
    rows = [(int(i), [float(np.float32(x)) for x in middle[i % 4] + draw.normal(0, 0.3, 5)]) for i in range(600)]
    rows += [(1_000 + i, rows[3][1]) for i in range(300)] + [rows[5]] * 3 + [(None, rows[7][1])]
    rows += [(1, None), (2, []), (3, [1.0] * 4), (4, [None] + [1.0] * 4), (5, [float("nan")] + [1.0] * 4), (6, [float("inf")] + [1.0] * 4), (7, [1e30] + [1.0] * 4)]
    table = spark.createDataFrame([(i, v, 9, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int, q int").repartition(5)
    got = centroids.cluster(table, k=6, rounds=3, dims=5, block=16)
    assert sorted(map(tuple, got.collect()), key=repr) == clusters_by_hand(rows, 6, 3, 5)
    assert centroids.cluster(table.where("vec_id < 3"), k=6, rounds=2, dims=5).count() == 3
    assert centroids.cluster(table.where("vec_id < 0"), dims=5).collect() == []


# -- the queries -----------------------------------------------------------------------------------

OWN = {
    "op11_centroid_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.mark.parametrize("name", list(OWN))
def test_queries_match_their_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    assert got.dtypes == [tuple(x.split()) for x in OWN[name].split(", ")]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
