"""Log-probabilities of texts under a hierarchical Pitman-Yor model of words in context (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, durable, text_buffers
from .words import mix, word_hashes

#: The context of a text's first token; any other token's context is the word before it.
START = np.uint64(0x57A2_7000_0000_0001)
#: Pairs of context and word whose scores are sent to the scoring tasks are 16 times as many at most; the others are joined.
HOT_WORDS = 65_536
#: Sweeps of the sampler before and while its states are averaged; strengths of both levels.
BURN_IN, SAMPLES, STRENGTH, ROOT_STRENGTH, ROOT_DISCOUNT = 2, 2, 20.0, 50.0, 0.7
#: Customers of one dish that are seated one by one; the rest come in batches of an eighth of those seated.
SINGLY = 12
#: Pairs that a counting task holds before it passes its partial counts on.
HELD_PAIRS = 1_000_000
END = np.uint64(0x5E17_0F7E_11D0_0D1E)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens of each text); each text's last token is its end."""
    words, first, _, _ = word_hashes(data, offsets)
    count = np.diff(first) + 1
    out = np.full(len(words) + len(count), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(count) - 1] = False
    out[keep] = words
    return out, count


def contexts(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Context of each token: the token before it, or START."""
    out = np.empty(len(token), np.uint64)
    out[1:] = token[:-1]
    out[np.cumsum(count) - count] = START
    return out


def pair_ids(word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(word ^ mix(ctx + np.uint64(3)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a flag (training or not) to counts of (word, context), combined within a task up to a bound.

    Pairs of other texts count 0: they are scored, too, but the model does not learn them.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def combined():
        word, ctx, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ctx, word))
        word, ctx, n = word[order], ctx[order], n[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])
        at = np.flatnonzero(new)
        return word[at], ctx[at], np.add.reduceat(n, at)

    def sent(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].view(np.int64)), pa.array(x[2])], ["word", "ctx", "n"])

    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        train = np.asarray(batch.column(1).cast(pa.int64()))
        for first, last in chunks(offsets):
            token, count = tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            held.append((token, contexts(token, count), np.repeat(train[first:last], count)))
            size += len(token)
            if size > 2 * HELD_PAIRS:
                held = [combined()]
                size = len(held[0][0])
                if size > HELD_PAIRS:
                    yield sent(held[0])
                    held, size = [], 0
    if held:
        yield sent(combined())


class Draws:
    """Draws for the dishes of ``seat`` that depend on each dish's key alone, whatever rows stand beside it."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        self.key, self.step = key[np.argsort(-n, kind="stable")], 0

    def random(self, size: int) -> np.ndarray:
        self.step += 1
        return (mix(self.key[:size] + np.uint64(self.step) * np.uint64(0x9E3779B97F4A7C15 >> 8 | 1)) >> np.uint64(11)) * 2.0**-53

    def binomial(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By inversion, in parts with a mean of 200 at most."""
        n, rare = n.astype(np.int64), np.minimum(p, 1 - p)
        out, parts = np.zeros(len(n), np.int64), np.maximum(np.ceil(n * rare / 200).astype(np.int64), 1)
        for j in range(int(parts.max())):
            size = int(np.flatnonzero(parts > j)[-1]) + 1
            m = np.where(parts[:size] > j, n[:size] * (j + 1) // parts[:size] - n[:size] * j // parts[:size], 0)
            out[:size] += self._inverted(m, rare[:size], self.random(size))
        return np.where(p > 0.5, n - out, out)

    @staticmethod
    def _inverted(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        out, term, k = np.zeros(len(n), np.int64), np.exp(n * np.log1p(-p)), 0
        upto, live = term.copy(), np.flatnonzero((u > term) & (n > 0))
        while len(live):
            term[live] *= (n[live] - k) / (k + 1) * (p[live] / (1 - p[live]))
            upto[live] += term[live]
            k += 1
            out[live] = k
            live = live[(u[live] > upto[live]) & (n[live] > k)]
        return out


def seat(n: np.ndarray, base: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables that n customers of a dish take in their restaurant, by the seating rule.

    ``base`` is (strength + discount * tables) * parent probability of the dish; the next customer
    opens a table with chance base / (base + seated - discount * tables).
    """
    tables, order = np.ones(len(n), np.int64), np.argsort(-n, kind="stable")
    size, base, t, seated = n[order], base[order], np.ones(len(n)), 1
    while len(size) and seated < size[0]:
        active = int(np.searchsorted(-size, -seated, side="left"))  # those with more customers than are seated
        chance = base[:active] / (base[:active] + np.maximum(seated - discount * t[:active], 1e-12))
        batch = 1 if seated < SINGLY else seated // 8
        left = np.minimum(batch, size[:active] - seated)
        t[:active] += draw.random(active) < chance if batch == 1 else draw.binomial(left, np.minimum(chance, 1.0))
        seated += batch
    tables[order] = t.astype(np.int64)
    return tables


def _seated(discount: float, s: int):
    """Rows of pairs with ``base`` to the same pairs with their tables t; ``taken`` adds up t over the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, ctx, n, taken, base = (np.asarray(c) for c in batch.columns)
            t = np.zeros(0, np.int64)
            if len(word):
                t = seat(n, base, discount, Draws(mix(pair_ids(word.view(np.uint64), ctx.view(np.uint64)) + np.uint64(s)), n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(t), pa.array(taken + t * (s >= BURN_IN))], ["word", "ctx", "n", "t", "taken"])

    return run


def _rooted(base: float, s: int):
    """Words with the tables of all their contexts (``joined``) to the same with their tables in the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, joined = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            root = np.zeros(0, np.int64)
            if len(word):
                root = seat(joined, np.full(len(word), base), ROOT_DISCOUNT, Draws(mix(word.view(np.uint64) + np.uint64(1000 + s)), joined))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(root), *batch.columns[4:]], ["word", "c", "ones", "joined", "root", *[f"{x}{i}" for i in range(max(s - BURN_IN, 0)) for x in "jr"]])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, ctx = (np.asarray(c).view(np.uint64) for c in batch.columns[:2])
        yield pa.RecordBatch.from_arrays([pa.array(pair_ids(word, ctx).view(np.int64)), *batch.columns[2:]], ["pair", "c", "score"])


def _apply(hot: np.ndarray, count: np.ndarray, scores: np.ndarray, total: float):
    """Texts to sums over the hot pairs, one row each (known not null), and one row for each other (text, pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10((count + 1) / total)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in chunks(offsets):
                token, n = tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                pair = pair_ids(token, contexts(token, n))
                row = np.repeat(np.arange(first, last), n)
                at = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
                hit = hot[at] == pair if len(hot) else np.zeros(len(pair), bool)
                h, r = at[hit], row[hit] - first
                sums = [np.bincount(r, weights=x[h], minlength=last - first).astype(float) for x in (count > 0, base, scores)]
                ids, keys = batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, keys, keys, pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], NAMES)
                rest = np.flatnonzero(~hit)
                if len(rest):
                    order = rest[np.lexsort((pair[rest], row[rest]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (row[order][1:] != row[order][:-1]) | (pair[order][1:] != pair[order][:-1])
                    start = np.flatnonzero(new)
                    k = np.diff(np.append(start, len(order)))
                    o = order[start]
                    none = pa.nulls(len(o), pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[o])), batch.column(2).take(pa.array(row[o])), pa.array(pair[o].view(np.int64)), pa.array(k), pa.nulls(len(o), pa.int64()), none, none], NAMES)

    return run


NAMES = ["doc_id", "key", "pair", "k", "known", "base", "score"]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model: one restaurant for each context (every training word as the word before, and a text's
    start) over a parent restaurant that all contexts share, over a uniform base of V + 1 words. A
    context without training tokens backs off to the parent. Pairs of (context, word) are counted
    over the whole corpus and kept in a table; contexts and words are tables of their own, joined to
    the pairs. Each sweep reseats the customers of every dish given its context's tables and its
    word's parent probability of the sweep before; a pair that occurs once has one table and needs
    no reseating. Customers beyond SINGLY of one dish are seated in growing batches. Predictive
    probabilities are averaged over the last SAMPLES sweeps. Words and pairs are held as 64-bit hashes.

    Training takes texts whose crc32 of the id as text, modulo 7, is not 2 (a null id: none of them,
    held_out false). Null and empty texts are one end token. Rows with the same id and text share a
    result each. Without training tokens, every word has probability 1 / (V + 1) with V = 0. Other columns are
    ignored; an empty table gives no rows.
    """
    crc = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = rows.select("text", (F.col("doc_id").isNotNull() & ~F.coalesce(crc, F.lit(False))).alias("train")).mapInArrow(_pairs, "word long, ctx long, n long")
    pairs = durable(counted.groupBy("word", "ctx").agg(F.sum("n").alias("n")), "pairs")
    n = F.col("n")
    seen = pairs.where(n > 0)
    first = F.least(n, 1 + F.floor(n * 0.3))
    sides = [F.sum("n").alias("c"), F.count_if(n == 1).alias("ones")]
    words = durable(seen.groupBy("word").agg(*sides, F.sum(first).alias("joined"), F.lit(1).cast("long").alias("root")), "words")
    ctxs = durable(seen.groupBy("ctx").agg(*sides, (F.sum("n") * 0.3).alias("t")), "contexts")
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    rare = seen.agg(F.count_if(n == 1).alias("one"), F.count_if(n == 2).alias("two")).first()
    one, two, v = rare["one"], rare["two"], facts["v"]
    discount = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
    held, roots = 0.3 * facts["n"], 0.3 * v
    unknown, helds, kept = [], [], []
    many = pairs.where(n > 1).withColumn("taken", F.lit(0).cast("long"))
    for s in range(BURN_IN + SAMPLES):
        fresh = (ROOT_STRENGTH + ROOT_DISCOUNT * roots) / (v + 1)
        parent = (F.greatest(F.col("joined") - ROOT_DISCOUNT * F.col("root"), F.lit(0.0)) + fresh) / (ROOT_STRENGTH + held)
        of = many.select("word", "ctx", "n", "taken").join(ctxs.select("ctx", F.col("t").alias("ctx_t")), "ctx").join(words.select("word", parent.alias("parent")), "word")
        base = of.select("word", "ctx", "n", "taken", ((STRENGTH + discount * F.col("ctx_t")) * F.col("parent")).alias("base"))
        many = durable(base.mapInArrow(_seated(discount, s), "word long, ctx long, n long, t long, taken long"), "many")
        old = list(kept)
        got = words.select("word", "c", "ones", *old).join(many.groupBy("word").agg(F.sum("t").alias("m")), "word", "left")
        got = got.select("word", "c", "ones", (F.col("ones") + F.coalesce("m", F.lit(0))).alias("joined"), *old)
        kind = "".join(f", {x} long" for x in old)
        words = got.mapInArrow(_rooted(fresh, s), f"word long, c long, ones long, joined long, root long{kind}")
        own = ctxs.join(many.groupBy("ctx").agg(F.sum("t").alias("m")), "ctx", "left").withColumn("t", F.col("ones") + F.coalesce("m", F.lit(0))).drop("m")
        if s >= BURN_IN:
            i = s - BURN_IN
            words = words.withColumns({f"j{i}": F.col("joined"), f"r{i}": F.col("root")})
            own = own.withColumn(f"t{i}", F.col("t"))
            kept += [f"j{i}", f"r{i}"]
        words, ctxs = durable(words, "words"), durable(own, "contexts")
        sums = words.agg(F.coalesce(F.sum("joined"), F.lit(0)).alias("t"), F.coalesce(F.sum("root"), F.lit(0)).alias("r")).first()
        held, roots = float(sums["t"]), float(sums["r"])
        if s >= BURN_IN:
            helds.append(held)
            unknown.append((ROOT_STRENGTH + ROOT_DISCOUNT * roots) / (ROOT_STRENGTH + held) / (v + 1))
    cells = pairs.where(n < 2).select("word", "ctx", "n", (n * SAMPLES).alias("taken")).union(many.select("word", "ctx", "n", "taken"))
    total = float(facts["n"] + v + 1)

    def scored(of: DataFrame) -> DataFrame:
        """pair, c (of the word), score of each pair."""
        x = of.join(ctxs.select("ctx", F.col("c").alias("cc"), *[f"t{i}" for i in range(SAMPLES)]), "ctx", "left").join(words.select("word", "c", *kept), "word", "left")
        customers = STRENGTH + F.coalesce("cc", F.lit(0))
        mine = (n - F.col("taken") * discount / SAMPLES) / customers
        p = [F.greatest(F.coalesce(F.col(f"j{i}") - ROOT_DISCOUNT * F.col(f"r{i}"), F.lit(0.0)), F.lit(0.0)) / (ROOT_STRENGTH + helds[i]) + unknown[i] for i in range(SAMPLES)]
        up = sum(p[i] * (STRENGTH + discount * F.coalesce(f"t{i}", F.lit(0))) / customers for i in range(SAMPLES)) / SAMPLES
        return x.select("word", "ctx", F.coalesce("c", F.lit(0)).alias("c"), F.log10(mine + up).alias("score")).mapInArrow(_named, "pair long, c long, score double")

    # a bound on n that at most 16 * HOT_WORDS pairs reach, in steps of a sixteenth of a doubling
    step = F.floor(F.log2(n) * 16)
    least, held_pairs = None, 0
    for r in seen.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held_pairs += r["count"]
        if held_pairs > 16 * HOT_WORDS:
            break
        least = r["step"]
    is_hot = F.lit(False) if least is None else F.when(n > 0, step >= least).otherwise(False)
    top = scored(cells.where(is_hot)).toArrow()
    hot = np.asarray(top["pair"].combine_chunks()).view(np.uint64)
    order = np.argsort(hot)
    count, scores = (np.asarray(top[x].combine_chunks()).astype(float)[order] for x in ("c", "score"))
    spread = rows.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("key"))
    parts = spread.mapInArrow(_apply(hot[order], count, scores, total), "doc_id long, key long, pair long, k long, known long, base double, score double")
    # a row that sums hot pairs has its text's key in place of a pair, so that such rows spread; what it may meet is not used
    k, whole = F.col("k"), F.col("known").isNotNull()
    joined = parts.join(scored(cells.where(~is_hot)).withColumnRenamed("score", "each"), "pair", "left").select(
        "doc_id", "key",
        F.when(whole, k).alias("n"),
        F.when(whole, F.col("known")).otherwise(F.when(F.col("c") > 0, k).otherwise(0)).alias("known"),
        F.when(whole, F.col("base")).otherwise(k * F.log10((F.col("c") + 1) / F.lit(total))).alias("base"),
        F.when(whole, F.col("score")).otherwise(k * F.col("each")).alias("score"),
    )
    sums = joined.groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.count("n").alias("rows"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    r = F.col("rows")
    return each.select(
        "doc_id", F.coalesce(crc, F.lit(False)).alias("held_out"), (F.col("n") / r).cast("long").alias("n_tokens"), (F.col("known") / r).cast("long").alias("n_known"),
        F.lit(int(facts["n"])).cast("long").alias("train_tokens"), (F.col("base") / r).alias("base_score"), (F.col("score") / r).alias("score"),
    )
