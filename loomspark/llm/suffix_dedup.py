"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_array, chunks, durable, ragged, text_buffers
from .words import mix

#: Length of the repeated strings, and of the grams among which each string has its anchor.
LENGTH, GRAM = 400, 32
#: Grams are counted in this many cells; the anchors avoid cells that many texts share. This steers
#: only how the work is dealt out: any fixed preference gives the same result.
CELL_BITS, CELL_BYTES, CELL_IN_CHUNK, CELL_HOT = 22, 2_000_000, 5, 64
#: Bytes of text that one step of a task holds with its hashes.
STEP_BYTES = 250_000
#: Nearly all anchors are below this, a twentieth of the hash range.
RARE = np.uint64(2**63 // 20)
#: Bytes of one suffix array, and most different pieces with one anchor in it.
SHARD_BYTES, SHARD_PIECES = 1_500_000, 2_000
_MUL = np.random.default_rng(99).integers(1, 2**62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(order + "u8"), (len(data),), (1,)).astype(np.uint64)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; positions less than GRAM before the end are left out."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    e = eights(data)
    total = e[:n] * _MUL[0]
    for k in (1, 2, 3):
        total += mix(e[8 * k : 8 * k + n]) * _MUL[k]
    return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None, length: int = LENGTH):
    """Pieces of many texts: (text, anchor, two hashes of the piece, first window, number of windows, own repeats, right, left).

    The anchor of a window of ``length`` bytes is the least of its grams' hashes, so equal windows have
    equal anchors. A piece is a run of windows of one text with one anchor: the windows of a text are
    split among its pieces, and equal windows can only lie in pieces with the same anchor, or in one
    piece that holds its anchor's gram more than once (own repeats). A window reaches half its rest
    beyond the gram on one side at least: ``right`` and ``left`` are hashes of the gram with that much
    behind or before it, 0 where the piece has no such window, so pieces with equal windows and without
    own repeats agree in one of the two.
    """
    h = grams(data) >> np.uint64(1)
    if hot is not None and len(h):
        h |= hot[h >> np.uint64(63 - CELL_BITS)].astype(np.uint64) << np.uint64(63)
    width = length - GRAM + 1
    if len(h) < width:
        return [np.zeros(0, np.int64)] * 9
    least = sliding_min(h, width)
    size = np.diff(offsets)
    own = np.flatnonzero(size >= length)
    windows = size[own] - length + 1
    at = ragged(offsets[:-1][own], windows)
    owner = np.repeat(own, windows)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    parts = -(-run // width)  # a long run, as in a periodic text, is cut
    first = np.repeat(first, parts) + width * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    run = np.minimum(width, np.repeat(np.append(np.flatnonzero(new)[1:], len(at)), parts) - first)
    start = at[first]
    place = np.arange(len(h), dtype=np.uint64)
    one, two = np.concatenate([[np.uint64(0)], np.cumsum(h)]), np.concatenate([[np.uint64(0)], np.cumsum(h * place)])
    end = start + run + length - 1 - GRAM + 1
    a = one[end] - one[start]
    b = two[end] - two[start] - start.astype(np.uint64) * a
    anchor = value[first]
    again, pos = np.zeros(len(first), bool), start.copy()
    common, few = np.arange(len(h)), np.flatnonzero(h < RARE)
    for group, places in ((np.flatnonzero(anchor < RARE), few), (np.flatnonzero(anchor >= RARE), common)):
        low, high = np.searchsorted(places, start[group]), np.searchsorted(places, start[group] + run[group] + width - 1)
        at_ = places[ragged(low, high - low)]
        same, piece = h[at_] == np.repeat(anchor[group], high - low), np.repeat(np.arange(len(group)), high - low)
        again[group] = np.bincount(piece, weights=same, minlength=len(group)) > 1
        pos[group[piece[same]]] = at_[same]
    half = (length - GRAM) // 2

    def side(begin: np.ndarray, there: np.ndarray) -> np.ndarray:
        begin = begin[there]
        x = one[begin + half + 1] - one[begin]
        out = np.zeros(len(first), np.uint64)
        out[there] = mix(x ^ mix(two[begin + half + 1] - two[begin] - begin.astype(np.uint64) * x)) | np.uint64(1)
        return out

    right, left = side(pos, pos + half + GRAM <= start + run + length - 1), side(pos - half, pos - half >= start)
    return owner[first], anchor, a, b, start - offsets[:-1][owner[first]], run, again, right, left


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of the bytes from them to the end of their piece; equal rests by position.

    Groups of equal 8-byte prefixes are refined by the ranks 8, 16, 32 ... positions ahead; a group
    that holds one position is settled and takes no further part.
    """
    n = len(data)
    key = eights(data, ">")
    left = ends - np.arange(n)
    short = left < 8
    key[short] &= ~((np.uint64(1) << ((8 - left[short]).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
    order = np.argsort(key)
    sorted_key = key[order]
    begins = np.ones(n, bool)
    begins[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    slots, h, longest = np.arange(n), 8, int(left.max()) if n else 0
    while True:
        alone = begins.copy()
        alone[:-1] &= begins[1:]
        slots = slots[~alone]
        if not len(slots):
            break
        if h >= longest:
            pos = order[slots]
            order[slots] = pos[np.argsort(rank[pos] * (n + 1) + pos)]
            break
        pos = order[slots]
        ahead = np.where(pos + h < ends[pos], rank[np.minimum(pos + h, n - 1)] + 1, 0)
        now = rank[pos]
        shuffle = np.argsort(now * (n + 1) + ahead)
        pos, now, ahead = pos[shuffle], now[shuffle], ahead[shuffle]
        order[slots] = pos
        begins = np.ones(len(slots), bool)
        begins[1:] = (now[1:] != now[:-1]) | (ahead[1:] != ahead[:-1])
        rank[pos] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(slots)), 0))]
        h *= 2
    return order


def common_prefix(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common prefix of suffixes a (of the eights x) and b (of y), from ``known`` bytes on, up to ``limit``."""
    out = np.minimum(known, limit)
    open_ = np.flatnonzero(out < limit)
    while len(open_):
        at = out[open_]
        differ = x[a[open_] + at] ^ y[b[open_] + at]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))
        bits = np.where(same, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        out[open_] = np.minimum(at + bits, limit[open_])
        open_ = open_[same & (out[open_] < limit[open_])]
    return out


def repeated(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions whose ``length`` bytes also start elsewhere in these pieces.

    Prefixes shared with the predecessor in the suffix array are found in text order by Kasai's rule:
    one byte on, at most one byte is lost. All pieces advance together.
    """
    ends = np.repeat(starts + lens, lens)
    order = suffix_array(data, ends)
    before = np.empty(len(data), np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    words = eights(data)
    out = np.zeros(len(data), bool)
    by_run = np.argsort(-lens, kind="stable")
    s, runs = starts[by_run], (lens - length + 1)[by_run]
    known = np.zeros(len(s), np.int64)
    for j in range(int(runs[0]) if len(runs) else 0):
        n = int(np.searchsorted(-runs, -j, side="left"))
        i = s[:n] + j
        p = before[i]
        limit = np.where(p < 0, 0, np.minimum(length, ends[np.maximum(p, 0)] - p))
        known[:n] = common_prefix(words, words, i, np.maximum(p, 0), np.maximum(known[:n] - 1, 0), limit)
        hit = known[:n] >= length
        out[i[hit]] = True
        out[p[hit]] = True
    return out


def found_in(data: np.ndarray, order: np.ndarray, other: np.ndarray, ask: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of another shard in a shard's sorted windows ``order``, by binary search: (found, which windows are hit)."""
    x, y, n = eights(data), eights(other), len(order)
    low, high = np.zeros(len(ask), np.int64), np.full(len(ask), n)
    full = np.full(len(ask), length)
    hit = np.full(len(ask), -1)
    while True:
        open_ = np.flatnonzero((low < high) & (hit < 0))
        if not len(open_):
            break
        mid = (low[open_] + high[open_]) // 2
        same = common_prefix(x, y, order[mid], ask[open_], np.zeros(len(open_), np.int64), full[open_])
        equal = same >= length
        hit[open_[equal]] = mid[equal]
        at = np.minimum(same, length - 1)
        less = data[order[mid] + at] < other[ask[open_] + at]
        low[open_[less & ~equal]] = mid[less & ~equal] + 1
        high[open_[~less & ~equal]] = mid[~less & ~equal]
    return hit >= 0, hit


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for first, last in chunks(offsets, CELL_BYTES):
            steps = range(int(offsets[first]), int(offsets[last]), STEP_BYTES)
            cells = [(grams(data[at : min(at + STEP_BYTES + GRAM - 1, offsets[last])]) >> np.uint64(64 - CELL_BITS)).astype(np.int32) for at in steps]
            cell, n = np.unique(np.concatenate(cells or [np.zeros(0, np.int32)]), return_counts=True)
            often = n >= CELL_IN_CHUNK
            yield pa.RecordBatch.from_arrays([pa.array(cell[often]), pa.array(n[often])], ["cell", "n"])


def _pieces(hot: np.ndarray, length: int):
    packed = np.packbits(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        avoid = np.unpackbits(packed)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for first, last in chunks(offsets, STEP_BYTES):
                owner, anchor, a, b, start, run, again, right, left = anchored(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], avoid, length)
                if len(owner):
                    rows = pa.array(owner + first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x.view(np.int64)) for x in (anchor, a, b)), pa.array(start.astype(np.int32)), pa.array(run.astype(np.int32)), pa.array(again), pa.array(right.view(np.int64)), pa.array(left.view(np.int64))], ["id", "key", "anchor", "a", "b", "start", "run", "again", "right", "left"])

    return run


def _cut(length: int):
    """Rows (text, pieces of it) to one row for each piece with its bytes and each block that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            lists = batch.column(1)
            lens = np.diff(np.asarray(lists.offsets))
            item = lists.flatten()
            text = np.repeat(np.arange(len(lens)), lens)
            fields = {name: item.field(name) for name in ("block", "side", "anchor", "a", "b", "run", "n", "start")}
            size = np.asarray(fields["run"]).astype(np.int64) + length - 1
            at, upto = offsets[text] + np.asarray(fields["start"]), np.concatenate([[0], np.cumsum(size)])
            for first, last in chunks(upto, STEP_BYTES):
                bytes_ = binary_array(data[ragged(at[first:last], size[first:last])], upto[first : last + 1] - upto[first], pa.binary())
                yield pa.RecordBatch.from_arrays([*(fields[x].slice(first, last - first) for x in ("block", "side", "anchor", "a", "b", "run", "n")), bytes_], ["block", "side", "anchor", "a", "b", "run", "n", "bytes"])

    return run


def _sort(length: int):
    """Pieces, in order of block, to the runs of their windows that repeat: (anchor, a, b, run, from, to)."""

    def spans(table: pa.RecordBatch, mask: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        flat = mask[ragged(starts, runs)]
        edge = np.zeros(len(flat), bool)
        begin = np.cumsum(runs) - runs
        edge[begin] = True
        prev = np.zeros(len(flat), bool)
        prev[1:] = flat[:-1]
        follow = np.zeros(len(flat), bool)
        follow[:-1] = flat[1:]
        last = np.zeros(len(flat), bool)
        last[begin + runs - 1] = True
        first, end = np.flatnonzero(flat & (edge | ~prev)), np.flatnonzero(flat & (last | ~follow))
        piece = np.searchsorted(begin, first, side="right") - 1
        rows = pa.array(piece)
        return pa.RecordBatch.from_arrays([*(table.column(x).take(rows) for x in ("anchor", "a", "b", "run")), pa.array((first - begin[piece]).astype(np.int32)), pa.array((end - begin[piece] + 1).astype(np.int32))], ["anchor", "a", "b", "run", "low", "high"])

    def solve(table: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffers(table.column("bytes"))
        starts, lens = offsets[:-1], np.diff(offsets)
        runs, side = lens - length + 1, np.asarray(table.column("side"))
        mask = np.zeros(len(data), bool)
        if (side >= 0).any():  # a pair of shards: the windows of the second are looked up among those of the first
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(left) and len(right):
                one = ragged(starts[left], lens[left])
                ends = np.repeat(np.cumsum(lens[left]), lens[left])
                order = suffix_array(data[one], ends)
                order = order[ends[order] - order >= length]
                ask = ragged(starts[right], runs[right])
                found, hit = found_in(data[one], order, data, ask, length)
                mask[ask[found]] = True
                # every window equal to one that is hit lies next to it
                near = np.zeros(len(order), bool)
                near[hit[found]] = True
                words = eights(data[one])
                same = np.zeros(len(order), bool)
                if len(order) > 1:
                    same[1:] = common_prefix(words, words, order[1:], order[:-1], np.zeros(len(order) - 1, np.int64), np.full(len(order) - 1, length)) >= length
                group = np.cumsum(~same)
                mask[one[order[np.isin(group, group[near])]]] = True
        else:
            mask = repeated(data, starts, lens, length)
            many = np.flatnonzero(np.asarray(table.column("n")) > 1)  # the same piece stands in several places
            mask[ragged(starts[many], runs[many])] = True
        return spans(table, mask, starts, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, key, key_pair = 0, None, False
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            if not len(blocks):
                continue
            # whole blocks share a suffix array up to its size; a pair of shards has one to itself
            cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            _, offsets = text_buffers(batch.column(7))
            side = np.asarray(batch.column(1))
            begin = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pending = size + int(offsets[a] - offsets[begin])
                if (held or begin < a) and blocks[a] != key and (pending > SHARD_BYTES or side[a] >= 0 or key_pair):
                    if begin < a:
                        held.append(batch.slice(begin, a - begin))
                    yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size, begin = [], 0, a
                key, key_pair = blocks[a], side[a] >= 0
            held.append(batch.slice(begin))
            size += int(offsets[-1] - offsets[begin])
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _remove(length: int):
    """Rows (doc_id, text, windows that repeat) to what is left and what was removed."""

    def cut(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n = len(offsets) - 1
        lists = batch.column(3)
        lens = np.diff(np.asarray(lists.offsets))
        item = lists.flatten()
        low, high = (np.asarray(item.field(x)).astype(np.int64) for x in ("low", "high"))
        base = offsets[np.repeat(np.arange(n), lens)]
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, base + low, 1)
        np.add.at(depth, base + high + length - 1, -1)
        gone = np.cumsum(depth[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])
        removed = upto[offsets[1:]] - upto[offsets[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        lead = offsets[:-1][np.diff(offsets) > 0]
        begins[lead] = gone[lead]
        opens = np.flatnonzero(begins)
        closing = gone.copy()
        closing[:-1] &= ~gone[1:]
        tail = offsets[1:][np.diff(offsets) > 0] - 1
        closing[tail] = gone[tail]
        closes = np.flatnonzero(closing) + 1
        per = np.searchsorted(opens, offsets)
        owner = np.repeat(np.arange(n), np.diff(per))
        spans = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays([pa.array(opens - offsets[owner]), pa.array(closes - offsets[owner])], ["start", "end"]))
        kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), spans, binary_array(data[~gone], kept, pa.binary()), batch.column(2)], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in chunks(offsets, STEP_BYTES):
                yield cut(batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes), kept (the remaining bytes) of every row.

    Columns named in ``carry`` come along as the struct ``rest``.

    1. Every window of ``length`` bytes is given an anchor by its content; runs of windows with one
       anchor make pieces (about one for each 190 bytes). Grams that many texts share are avoided as
       anchors, so a piece at the edge of a common passage is anchored in its own text.
    2. Pieces are counted by anchor and content. Only anchors that occur twice, or pieces with repeats of
       their own, matter; of equal pieces one goes on, with their number. Of those, only pieces that
       agree with another in what lies right or left of the anchor can share a window with it; all
       windows of the others repeat if the piece itself does, and none if not.
    3. Those pieces' bytes are dealt out by anchor to shards of bounded size, each with a suffix array
       and common prefixes. Where one anchor has more pieces than a shard takes, its shards are merged
       in pairs by binary search.
    4. Windows that repeat go back to all texts that hold the piece, and their bytes are removed.

    A null or empty text has nothing to remove; texts shorter than ``length`` stay whole. Repeated rows
    are texts of their own, so both repeat each other. Null ids and other columns make no difference;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), rest.alias("rest"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("key"), "text", "rest")
    long_ = keyed.where(F.octet_length("text") >= length)
    cells = long_.select("text").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= CELL_HOT).select("cell").toArrow()
    hot = np.zeros(1 << CELL_BITS, bool)
    hot[np.asarray(cells["cell"].combine_chunks()) if cells.num_rows else []] = True
    pieces = long_.select("id", "key", "text").mapInArrow(_pieces(hot, length), "id long, key long, anchor long, a long, b long, start int, run int, again boolean, right long, left long")
    pieces = durable(pieces, "pieces")
    what = ["anchor", "a", "b", "run"]
    different = pieces.groupBy(*what).agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "start")).alias("at"), F.bool_or("again").alias("again"), F.max("right").alias("right"), F.max("left").alias("left"))
    anchors = different.groupBy("anchor").agg(F.sum("n").alias("total"), F.bool_or("again").alias("own")).where("total > 1 or own")
    chosen = different.join(anchors, "anchor")
    meets = F.col("own")
    for c in ("right", "left"):
        meets = meets | ((F.col(c) != 0) & (F.count("*").over(Window.partitionBy("anchor", c)) > 1))
    chosen = chosen.withColumn("meets", meets).where("meets or n > 1").withColumn("m", F.count_if("meets").over(Window.partitionBy("anchor")))
    chosen = durable(chosen.select(*what, "n", "at", "meets", F.ceil(F.col("m") / SHARD_PIECES).alias("parts")), "chosen")
    copies = chosen.where("not meets").select(*what, F.lit(0).alias("low"), F.col("run").alias("high"))
    chosen = chosen.where("meets")
    common = [*what, "n", "at"]
    one = chosen.where("parts <= 1").select(*common, F.col("anchor").alias("block"), F.lit(-1).alias("side"))
    many = chosen.where("parts > 1").withColumn("s", F.pmod(F.xxhash64("a", "b"), F.col("parts")))
    alone = many.select(*common, F.xxhash64("anchor", "s").alias("block"), F.lit(-1).alias("side"))
    facing = many.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("t <> s")
    facing = facing.select(*common, F.xxhash64("anchor", F.least("s", "t"), F.greatest("s", "t")).alias("block"), F.when(F.col("s") < F.col("t"), 0).otherwise(1).alias("side"))
    dealt = one.union(alone).union(facing)
    wanted = dealt.groupBy(F.col("at.id").alias("id"), F.col("at.key").alias("key")).agg(F.collect_list(F.struct("block", "side", *what, "n", F.col("at.start").alias("start"))).alias("pieces"))
    # rows with the same id and text give the same bytes: one of them is enough
    cut = long_.join(wanted, ["id", "key"]).dropDuplicates(["id", "key"]).select("text", "pieces").mapInArrow(_cut(length), "block long, side int, anchor long, a long, b long, run int, n long, bytes binary")
    found = cut.repartition("block").sortWithinPartitions("block").mapInArrow(_sort(length), "anchor long, a long, b long, run int, low int, high int")
    found = durable(found.union(copies), "repeats")
    by_text = pieces.join(found, what).select("id", "key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    by_text = by_text.groupBy("id", "key").agg(F.collect_list(F.struct("low", "high")).alias("windows"))
    whole = keyed.join(by_text, ["id", "key"], "left").select("doc_id", "text", "rest", F.coalesce("windows", F.array().cast("array<struct<low:int,high:int>>")).alias("windows"))
    kind = whole.schema["rest"].dataType.simpleString()
    out = whole.mapInArrow(_remove(length), f"doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, rest {kind}")
    return out if carry else out.drop("rest")
