"""Repair of conversations by the cheapest edits, found from both ends of the edit lattice (operator 12)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A repaired conversation is nothing, or perhaps a system turn and then user and assistant in turns. States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The state that a new role leads to from each state, and that role: there is one.
NEXT, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
BEFORE = {2: (0, 1, 3), 3: (2,)}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\v\f\r"
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Conversations' characters after which a worker hands on what it has.
FLUSH = 1_000_000


class Lattice:
    """Nodes are 4 * turns consumed + state; an edge is (initial of the edit, cost, node)."""

    def __init__(self, initials: list[str], faults: list[int]):
        self.initials, self.faults, self.n = initials, faults, len(initials)

    def ends(self) -> tuple[int, int]:
        return 4 * self.n, 4 * self.n + 3

    def _kept(self, i: int) -> tuple[bool, int]:
        """Whether turn i may stay, and what that adds."""
        return self.faults[i] in (SOUND, CUT), TRUNCATED if self.faults[i] == CUT else 0

    def after(self, node: int) -> Iterator[tuple[str, int, int]]:
        """The edges out of a node, by their initials."""
        i, state = divmod(node, 4)
        if i < self.n:
            yield "D", DELETE, node + 4
        yield "I", INSERT, 4 * i + NEXT[state]
        if i < self.n:
            stays, more = self._kept(i)
            if stays:
                if to := KEPT.get((state, self.initials[i])):
                    yield "K", more, 4 * i + 4 + to
                yield "R", REROLE + more, 4 * i + 4 + NEXT[state]

    def before(self, node: int) -> Iterator[tuple[str, int, int]]:
        """The edges into a node, with the nodes they come from."""
        i, state = divmod(node, 4)
        for old in BEFORE.get(state, ()):
            yield "I", INSERT, 4 * i + old
        if i:
            yield "D", DELETE, node - 4
            stays, more = self._kept(i - 1)
            if stays:
                for (old, initial), to in KEPT.items():
                    if to == state and initial == self.initials[i - 1]:
                        yield "K", more, 4 * i - 4 + old
                for old in BEFORE.get(state, ()):
                    yield "R", REROLE + more, 4 * i - 4 + old


def cheapest(lattice: Lattice) -> tuple[int, str, list[int]]:
    """(cost, audit, states after each edit) of the cheapest edits whose audit is least in ASCII order.

    A heap from the start and one from the ends take turns, the cheaper first, until their tops add up to more
    than the best crossing, so every crossing of that cost is known. All audits that lead through these
    crossings are then compared at once: a walk from the start takes at each node the least initial that
    still leads through one of them. Edges out of a node have different initials and no cheapest audit is the
    start of another, so the walk gives the least audit in time linear in its length.
    """
    there, back = {0: 0}, dict.fromkeys(lattice.ends(), 0)
    heaps = [[(0, 0, 0)], [(0, 0, x) for x in lattice.ends()]]
    sides = ((there, back, lattice.after, 1), (back, there, lattice.before, -1))
    settled: tuple[set, set] = (set(), set())
    best = min((there[x] + back[x] for x in there if x in back), default=None)
    while all(heaps) and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0] < heaps[0][0])
        known, other, edges, way = sides[side]
        cost, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        for _, more, to in edges(node):
            total = cost + more
            if total < known.get(to, total + 1):
                known[to] = total
                heapq.heappush(heaps[side], (total, way * (to // 4), to))  # at equal cost, edges that cost nothing lead on
                if to in other and (best is None or total + other[to] < best):
                    best = total + other[to]
    marked = [x for x, cost in there.items() if x in back and cost + back[x] == best]
    first = set(marked)
    while marked:
        node = marked.pop()
        for _, more, old in lattice.before(node):
            if old not in first and there.get(old, best + 1) + more == there[node]:
                first.add(old)
                marked.append(old)
    node, cost, audit, states = 0, 0, [], []
    while cost < best or node not in lattice.ends():
        for initial, more, to in lattice.after(node):
            total = cost + more
            if to in first and there[to] == total or to in back and total + back[to] == best:
                audit.append(initial)
                states.append(to % 4)
                node, cost = to, total
                break
    return best, "".join(audit), states


def faults_of(turns: list[tuple[str, str]]) -> list[int]:
    """Each turn's first fault: blank, a role and text seen before, or an end without a full stop."""
    seen, out = set(), []
    for turn in turns:
        text = turn[1].rstrip(SPACE)
        out.append(BLANK if not text else DUPLICATE if turn in seen else CUT if text[-1] not in ".!?" else SOUND)
        seen.add(turn)
    return out


def _repaired(rows: list[tuple]) -> dict:
    numbers = {r[1] for r in rows if r[1] is not None}
    turns = [(r[2], r[3]) for r in rows]
    faults, initials = faults_of(turns), [role[:1] for role, _ in turns]
    cost, audit, states = cheapest(Lattice(initials, faults))
    kept, at = [], iter(turns)
    for edit, state in zip(audit, states, strict=True):
        role, text = (ROLE[state], "") if edit == "I" else next(at)
        if edit != "D":
            kept.append({"role": ROLE[state] if edit == "R" else role, "text": text})
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "turns": kept,
    }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, key: str = "conv_id", copies: str | None = None) -> DataFrame:
    """One row per conversation: its key, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (role, text).

    Turns come by number, those without one first; of one number by role and text. A null role or text is one
    space. Edits: keep a turn, give it the role user or assistant, delete it (a must for blank and repeated
    ones), insert an empty turn anywhere; audit holds their initials. ``copies`` names a column that says how
    often a row counts; a conversation whose rows all count 0 times gives zeros, an empty audit and no turns.

    Conversations are dealt out by key and sorted by Spark; a worker reads them as a stream, one at a time.
    As its repaired turns are one row, a conversation must fit a task: time and memory grow with its turns
    (four nodes a turn), never with their square. A null key is a conversation of its own. Other columns are
    ignored; an empty table gives no rows.
    """
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col(key).alias("_key"), F.col("turn").cast("long").alias("turn"), *words, (F.col(copies) if copies else F.lit(1)).cast("int").alias("_copies"))
    rows = rows.repartition("_key").sortWithinPartitions("_key", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = None, [], 0
        turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

        def each() -> Iterator[tuple]:
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([(key, b.schema.field(0).type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("turns", turns)])
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for k, group in groupby(each(), key=lambda r: r[0]):
            found = _repaired([r for r in group for _ in range(r[4])])
            out.append({key: k} | found)
            held += sum(len(t["text"]) + 100 for t in found["turns"]) + 500
            if held > FLUSH:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns array<struct<role:string,text:string>>")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it counts 0 times), 1 empties its text, 2 removes full stops, 3 counts it twice, 4 makes it the user's. Nulls are one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20
    text = F.when(case.isin(0, 1), "").when(case == 2, F.regexp_replace(say("text"), "[.!?]", "")).otherwise(say("text"))
    role = F.when(case == 4, "user").otherwise(say("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"))
