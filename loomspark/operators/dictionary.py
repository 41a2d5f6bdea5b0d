"""Texts against dictionaries of any size: names as whole words, terms as parts of texts.

A dictionary of bounded measured size is carried to every task and read against each text once. A larger
one stays a table: texts and entries meet by each entry's rarest unit (a word, or three characters), counted
over all texts, and only such meetings are verified.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import WHITE, col, trim_all
from .graph import settled

#: Characters of names that an automaton in every task may hold (about 100,000 names), and terms that one expression may test.
MOST_NAMES, MOST_TERMS = 2_000_000, 1_000
#: Slots of the bitmap of a dictionary's units: 1 MB, whatever the dictionary's size.
SLOTS = 1 << 23
_TOKEN = re.compile(rf"[^\W_]+|[{re.escape(WHITE)}]+|.", re.S)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, single other characters, and one space for any run of white space."""
    return [" " if t[0] in WHITE else t for t in _TOKEN.findall((text or "").lower())]


class Automaton:
    """Aho-Corasick over tokens: all names that a text holds, in one pass over it.

    One dictionary holds the steps of all states, keyed by state and token number; what each name and state has besides is in arrays. A name that starts or ends with a letter
    or digit is bounded by its tokens; beside another character no letter or digit may stand, as for whole names.
    """

    def __init__(self, names: list[str]) -> None:
        self.ids: dict[str, int] = {}
        for n in names:
            for t in tokens(n.strip(WHITE)):
                self.ids.setdefault(t, len(self.ids))
        self.width = max(1, len(self.ids))
        self.step: dict[int, int] = {}
        self.last: dict[int, int] = {}  # a state's last name, from which `same` leads to the others
        self.same, self.size, self.opens, self.closes = array("i"), array("i"), bytearray(), bytearray()
        parent, by, depth = array("i", [0]), array("i", [0]), array("i", [0])
        for number, name in enumerate(names):
            state, own = 0, tokens(name.strip(WHITE))
            for t in own:
                key = state * self.width + self.ids[t]
                if key not in self.step:
                    self.step[key] = len(parent)
                    parent.append(state)
                    by.append(self.ids[t])
                    depth.append(depth[state] + 1)
                state = self.step[key]
            self.same.append(self.last.get(state, -1))
            self.size.append(len(own))
            self.opens.append(bool(own) and not own[0][0].isalnum())
            self.closes.append(bool(own) and not own[-1][0].isalnum())
            if own:
                self.last[state] = number
        self.fail, self.shorter = (array("i", bytes(4 * len(parent))) for _ in range(2))
        for state in np.argsort(np.frombuffer(depth, np.int32), kind="stable")[1:]:  # by depth, so that a shorter state's links are known
            state = int(state)
            if parent[state]:
                self.fail[state] = self._next(self.fail[parent[state]], by[state])
            back = self.fail[state]
            self.shorter[state] = back if back in self.last else self.shorter[back]

    def _next(self, state: int, token: int) -> int:
        while (to := self.step.get(state * self.width + token)) is None and state:
            state = self.fail[state]
        return to or 0

    def find(self, text: str | None) -> set[int]:
        """Numbers of the names that the text holds."""
        found, state, own = set(), 0, tokens(text)
        for at, t in enumerate(own):
            token = self.ids.get(t)
            state = 0 if token is None else self._next(state, token)
            end = state if state in self.last else self.shorter[state]
            while end:
                number = self.last[end]
                while number >= 0:
                    before, behind = at - self.size[number], at + 1
                    if not (self.opens[number] and before >= 0 and own[before][0].isalnum()) and not (self.closes[number] and behind < len(own) and own[behind][0].isalnum()):
                        found.add(number)
                    number = self.same[number]
                end = self.shorter[end]
        return found


def trigrams(text: str | None, sizes: tuple[int, ...] = (3,)) -> set[str]:
    """The parts of a text of the given sizes; of size 0, the empty one."""
    t = text or ""
    return {t[i : i + n] for n in sizes for i in range(len(t) - n + 1)}


def _wanted(units: DataFrame) -> np.ndarray:
    """The bitmap of the units' hashes, of fixed size."""
    slot = F.crc32(F.encode("unit", "utf-8")) % SLOTS + 1
    rows = units.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * len(bits) :][: len(bits)] = bits
    return out


def _meetings(texts: DataFrame, entries: DataFrame, units_of: Callable[[str | None], set[str]], entry_units_of: Callable[[str | None], set[str]]) -> DataFrame:
    """(key, entry) of the texts (key, text) that hold the rarest unit of an entry (entry, word).

    One scan writes each text's units that the bitmap of all entries' units lets through; their counts over
    all texts choose each entry's anchor. Entries with a unit that no text holds meet none.
    """
    kinds = {c: t for c, t in [*texts.dtypes, *entries.dtypes] if c in ("key", "entry")}

    def entry_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(entry_units_of(w)) for w in b.column("word").to_pylist()]
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column("entry").take(pa.array(row)), pa.array([u for x in found for u in x], pa.string())], ["entry", "unit"])

    parts = settled(entries.select("entry", "word").mapInArrow(entry_units, f"entry {kinds['entry']}, unit string"))
    wanted = _wanted(parts.select("unit").distinct())

    def text_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 64):  # few texts at a time: their units take more room than they do
                part = b.slice(first, 64)
                found = []
                for t in part.column("text").to_pylist():
                    hashes = ((u, zlib.crc32(u.encode("utf-8", "surrogatepass")) % SLOTS) for u in units_of(t))
                    found.append([u for u, h in hashes if wanted[h >> 3] >> (h & 7) & 1])
                row = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array([u for x in found for u in x], pa.string())], ["key", "unit"])

    postings = settled(texts.select("key", "text").mapInArrow(text_units, f"key {kinds['key']}, unit string"))
    counts = postings.groupBy("unit").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = ranked.groupBy("entry").agg(F.min(F.struct("n", "unit")).alias("a")).where("a.n > 0").select("entry", F.col("a.unit").alias("unit"))
    return postings.join(anchors, "unit").select("key", "entry").distinct()


def mentions_of(df: DataFrame, key: str, text: str, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(key, name), once each, of the names that a text mentions, for a table of names (column name) of any size.

    A name is found as a whole: in any case, white space inside it as any white space, with no letter or digit on
    either side. Names of ``most`` characters in all become one automaton in every task, which
    reads each text once; more names meet the texts by their rarest word. Blank and null names are left out, null
    texts mention nothing, and rows without a key are left out.
    """
    known = names.select("name").where(F.coalesce(trim_all("name"), F.lit("")) != "").distinct()
    texts = df.select(F.col(key).alias("key"), col(text).alias("text")).where("key is not null and text is not null")
    kind = texts.schema["key"].dataType.simpleString()

    def answer(b: pa.RecordBatch, found: list[list[str]]) -> pa.RecordBatch:
        row = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), pa.array([n for x in found for n in x], pa.string())], ["key", "name"])

    if (known.agg(F.sum(F.length("name"))).first()[0] or 0) <= most:
        words = [r["name"] for r in known.collect()]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(words)
            for b in batches:
                for first in range(0, b.num_rows, 64):  # few texts at a time: a batch holds thousands
                    part = b.slice(first, 64)
                    yield answer(part, [[words[i] for i in automaton.find(t)] for t in part.column("text").to_pylist()])

        out = texts.mapInArrow(read, f"key {kind}, name string")
    else:
        solid = lambda t: {x for x in tokens(t) if x != " "}
        met = _meetings(texts, known.select(F.col("name").alias("entry"), F.col("name").alias("word")), solid, solid)
        asked = texts.join(met.groupBy("key").agg(F.collect_list("entry").alias("names")), "key")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = zip(b.column("text").to_pylist(), b.column("names").to_pylist(), strict=True)
                yield answer(b, [[own[i] for i in Automaton(own).find(t)] for t, own in pairs])

        out = asked.select("key", "text", "names").mapInArrow(verify, f"key {kind}, name string")
    return out.distinct().withColumnRenamed("key", key)


def _parts_in(needles: list[str]) -> Callable[[str], list[int]]:
    """A function that tells the numbers of the needles in a text: those whose chosen three characters it holds, and all shorter ones, are looked for."""
    shared: dict[str, int] = defaultdict(int)
    for n in needles:
        for u in trigrams(n):
            shared[u] += 1
    by: dict[str, list[int]] = defaultdict(list)
    short = []
    for i, n in enumerate(needles):
        units = trigrams(n)
        (by[min(units, key=lambda u: (shared[u], u))] if units else short).append(i)

    def find(text: str) -> list[int]:
        met = [i for u in by.keys() & trigrams(text) for i in by[u]]
        return [i for i in [*short, *met] if needles[i] in text]

    return find


def contains_terms(df: DataFrame, key: str, text: str, terms: DataFrame, most: int = MOST_TERMS, characters: int = MOST_NAMES) -> DataFrame:
    """(key, group, term, ord) of the terms whose needle the text holds, in any case, for a table of terms (group, term, needle, ord) of any size.

    Up to ``most`` terms become one expression over each text, without a join or a shuffle. Up to ``characters``
    characters of terms go to every task, and only the numbers of those found in a text are shuffled, once. More
    meet the texts by the rarest three characters of their needle (all of a shorter one); what meets is
    verified by ``contains``. Null needles are in no text; an empty one is in all. With many terms, rows without a key or that share one
    count as one text each key: a term is listed once.
    """
    rows = terms.select("group", "term", F.col("ord").cast("int").alias("ord"), F.lower("needle").alias("needle")).where("needle is not null")
    low = df.select(key, F.lower(col(text)).alias("_t"))
    first = rows.limit(most + 1).collect()
    if len(first) <= most:
        entry = lambda r: F.struct(F.lit(r["group"]).alias("group"), F.lit(r["term"]).alias("term"), F.lit(r["ord"]).cast("int").alias("ord"))
        none = F.array().cast("array<struct<group:string,term:string,ord:int>>")
        hits = F.array_compact(F.array(*[F.when(F.col("_t").contains(r["needle"]), entry(r)) for r in first])) if first else none
        return low.select(key, F.inline(hits))
    texts = low.select(F.col(key).alias("key"), F.col("_t").alias("text")).where("key is not null and text is not null")
    if (rows.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in ("needle", "group", "term")))).first()[0] or 0) <= characters:
        known = [r["needle"] for r in rows.select("needle").distinct().collect()]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _parts_in(known)
            for b in batches:
                for first in range(0, b.num_rows, 64):
                    part = b.slice(first, 64)
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([find(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], ["key", "found"])

        hits = texts.mapInArrow(read, f"key {texts.schema['key'].dataType.simpleString()}, found array<int>").where(F.size("found") > 0)
        each = hits.groupBy("key").agg(F.collect_list("found").alias("all")).select("key", F.explode(F.array_distinct(F.flatten("all"))).alias("number"))
        numbered = df.sparkSession.createDataFrame(list(enumerate(known)), "number int, needle string").join(rows, "needle")
        return each.join(F.broadcast(numbered), "number").select(F.col("key").alias(key), "group", "term", "ord")
    needles = settled(rows.select("needle").distinct())
    sizes = tuple(sorted(r[0] for r in needles.select(F.least(F.length("needle"), F.lit(3))).distinct().collect()))  # four at most
    texts = low.select(F.col(key).alias("key"), F.col("_t").alias("text")).where("key is not null and text is not null")
    met = _meetings(texts, needles.select(F.col("needle").alias("entry"), F.col("needle").alias("word")), lambda t: trigrams(t, sizes), lambda n: trigrams(n, (min(3, len(n)),)))
    found = texts.join(met, "key").where(F.contains("text", "entry")).select("key", F.col("entry").alias("needle")).distinct()
    return found.join(rows, "needle").select(F.col("key").alias(key), "group", "term", "ord")
