"""Texts as FLAC media columns: 8-bit mono streams of fixed 576-sample blocks (operator 4).

Encoding and decoding treat the frames of many streams at once: a step of the bit reader advances
every frame by one sample, so the Python cost does not depend on the number of frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, chunks, ragged, text_buffers

BLOCK = 576
RATE = 8000
PAD = 255
#: Predictors that the encoder tries on each frame: (subframe code, order, coefficients, shift).
PREDICTORS = ((8, 0, (), 0), (9, 1, (1,), 0), (32, 1, (8,), 4))
PRECISION = 5
RICE = range(2, 9)


def crc_table(width: int, polynomial: int) -> np.ndarray:
    """CRC of every byte value, from the rule of the checksum."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = np.zeros(256, np.int64)
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        table[i] = c
    return table


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


#: Leading zeros of every 16-bit value.
ZEROS = (16 - np.ceil(np.log2(np.arange(65536) + 1.0))).astype(np.int32)


@lru_cache(maxsize=1)
def crc16_pairs() -> np.ndarray:
    """CRC-16 of every pair of bytes, so that a step takes two bytes."""
    pair = np.arange(65536)
    c = CRC16[pair >> 8]
    return ((c << 8) & 0xFFFF ^ CRC16[(c >> 8) ^ (pair & 255)]).astype(np.uint16)


def crc16(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte runs, two bytes of every run at each step; an odd run has a zero byte in front."""
    order = np.argsort(-lens, kind="stable")
    s, n = starts[order] - (lens[order] & 1), lens[order] + (lens[order] & 1)
    table, crc = crc16_pairs(), np.zeros(len(s), np.uint16)
    odd = (lens[order] & 1).astype(bool)
    active = np.searchsorted(-n, -np.arange(2, (int(n[0]) if len(n) else 0) + 2, 2), side="right")
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    for step, k in enumerate(active):
        at = s[:k] + 2 * step
        high = padded[at].astype(np.uint16)
        if step == 0:
            high[odd[:k]] = 0
        crc[:k] = table[crc[:k] ^ (high << 8 | padded[at + 1])]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def frame_header(number: int) -> bytes:
    """Sync code, block size 576, 8 kHz, mono, 8 bits, the frame number in its variable-length code, CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        rest = []
        while number >= 1 << (6 - len(rest)) or not rest:
            rest.insert(0, 0x80 | number & 63)
            number >>= 6
        coded = bytes([(0xFF00 >> (len(rest) + 1)) & 0xFF | number, *rest])
    head, c = b"\xff\xf8\x24\x02" + coded, 0
    for x in head:
        c = int(CRC8[c ^ x])
    return head + bytes([c])


_headers: list[bytes] = []


def headers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat bytes, starts and lengths of the headers of frames 0 to n - 1."""
    while len(_headers) < n:
        _headers.append(frame_header(len(_headers)))
    lens = np.fromiter(map(len, _headers[:n]), np.int64, n)
    return np.frombuffer(b"".join(_headers[:n]), np.uint8), np.cumsum(lens) - lens, lens


def residual(x: np.ndarray, order: int, coefs: tuple, shift: int) -> np.ndarray:
    if not order:
        return x
    predicted = sum(x[:, order - 1 - j : x.shape[1] - 1 - j] * np.int16(c) for j, c in enumerate(coefs)) >> shift
    return x[:, order:] - predicted


def put_bits(buffer: np.ndarray, at: np.ndarray, value: np.ndarray, width) -> None:
    """Add values of up to 9 bits at bit positions of a float64 byte buffer; no two overlap, so adding is or-ing."""
    byte, shifted = at >> 3, value << (16 - width - (at & 7))
    buffer += np.bincount(byte, weights=shifted >> 8, minlength=len(buffer))
    buffer += np.bincount(byte + 1, weights=shifted & 255, minlength=len(buffer))


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the signed samples x [frames, 576] with their numbers in their streams: (bytes, length of each)."""
    frames = len(x)
    cost = np.stack([np.abs(residual(x, *p[1:])).sum(axis=1, dtype=np.int32) + 40 * (i > 0) for i, p in enumerate(PREDICTORS)])
    best = np.argmin(cost, axis=0)
    same = (x == x[:, :1]).all(axis=1)
    plans, bits = [], np.zeros(frames, np.int64)
    for i, (code, order, coefs, shift) in enumerate(PREDICTORS):
        rows = np.flatnonzero((best == i) & ~same)
        if not len(rows):
            continue
        r = residual(x[rows], order, coefs, shift)
        u = (r << 1) ^ (r >> 15)
        near = np.clip(np.log2(u.mean(axis=1) + 1).astype(np.int16), RICE[0] + 1, RICE[-1])
        size = np.stack([(u >> k[:, None]).sum(axis=1, dtype=np.int64) + u.shape[1] * (k + 1) for k in (near - 1, near)])
        pick = np.argmin(size, axis=0)
        extra = 9 + PRECISION * order if code >= 32 else 0
        total = 8 + 8 * order + extra + 10 + size[pick, np.arange(len(rows))]
        verbatim = total >= 8 + 8 * BLOCK
        bits[rows] = np.where(verbatim, 8 + 8 * BLOCK, total)
        plans.append((rows[~verbatim], code, order, coefs, shift, u[~verbatim], (near - 1 + pick)[~verbatim].astype(np.int32)))
        if verbatim.any():
            plans.append((rows[verbatim], 1, 0, (), 0, None, None))
    bits[same] = 16
    flat, head_at, head_len = headers(int(number.max()) + 1)
    lens = head_len[number] + (bits + 7 >> 3) + 2
    starts = np.cumsum(lens) - lens
    buffer = np.zeros(int(lens.sum()) + 2)
    body = 8 * (starts + head_len[number])
    if same.any():
        buffer[(body[same] >> 3) + 1] = x[same, 0] & 255
    for rows, code, order, coefs, shift, u, k in plans:
        if not len(rows):
            continue
        at = body[rows]
        buffer[at >> 3] = code << 1
        at = at + 8
        if code == 1:
            where = (at >> 3)[:, None] + np.arange(BLOCK)
            buffer[where] = x[rows] & 255
            continue
        for j in range(order):
            buffer[at >> 3] = x[rows, j] & 255
            at = at + 8
        if code >= 32:
            put_bits(buffer, at, np.full(len(rows), PRECISION - 1), 4)
            put_bits(buffer, at + 4, np.full(len(rows), shift), 5)
            at = at + 9
            for c in coefs:
                put_bits(buffer, at, np.full(len(rows), c & (1 << PRECISION) - 1), PRECISION)
                at = at + PRECISION
        put_bits(buffer, at + 6, k, 4)  # method 0 and partition order 0 are six zero bits
        u = u.astype(np.int32)
        q = u >> k[:, None]
        width = k + 1
        stop = (at + 10 - width).astype(np.int32)[:, None] + np.cumsum(q + width[:, None], axis=1, dtype=np.int32)
        low = u & ((1 << k) - 1)[:, None] | (1 << k)[:, None]
        put_bits(buffer, stop.ravel(), low.ravel(), np.repeat(width, u.shape[1]))
    out = buffer[:-2].astype(np.uint8)
    out[ragged(starts, head_len[number])] = flat[ragged(head_at[number], head_len[number])]
    crc = crc16(out, starts, lens - 2)
    out[starts + lens - 2], out[starts + lens - 1] = crc >> 8, crc & 255
    return out, lens


def encode_streams(payload: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A FLAC stream for each payload (a positive multiple of 576 bytes): (bytes, offsets)."""
    frames = np.diff(offsets) // BLOCK
    number = np.arange(int(frames.sum())) - np.repeat(np.cumsum(frames) - frames, frames)
    data, lens = encode_frames(payload.astype(np.int16).reshape(-1, BLOCK) - np.int16(128), number)
    at = np.concatenate([[0], np.cumsum(lens)])
    parts, sizes, frame, signed = [], [], 0, payload ^ 128
    for i, n in enumerate(frames.tolist()):
        own = at[frame : frame + n + 1]
        info = BLOCK.to_bytes(2, "big") * 2 + int(lens[frame : frame + n].min()).to_bytes(3, "big") + int(lens[frame : frame + n].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(signed[offsets[i] : offsets[i + 1]]).digest()
        seek = np.zeros(n, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
        seek["sample"], seek["byte"], seek["count"] = np.arange(n) * BLOCK, own[:-1] - own[0], BLOCK
        table = seek.tobytes()
        parts += [b"fLaC\x00\x00\x00\x22", info, b"\x83" + len(table).to_bytes(3, "big"), table, data[own[0] : own[-1]].tobytes()]
        sizes.append(8 + 34 + 4 + len(table) + int(own[-1] - own[0]))
        frame += n
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def seek_points(stream: bytes) -> tuple[int, bytes, np.ndarray]:
    """(first byte of the frames, MD5 of the samples, table of (sample, byte, count)) of one stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, md5, table = 4, False, b"", None
    while not last:
        last, kind, n = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            md5 = stream[at + 22 : at + 38]
        elif kind == 3:
            table = np.frombuffer(stream[at + 4 : at + 4 + n], np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
        at += 4 + n
    if table is None:
        raise ValueError("the stream has no seek table")
    return at, md5, table


def decode_frames(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Signed samples [frames, 576]; both checksums of every frame are verified first."""
    tail = data[starts + lens - 2].astype(np.int64) << 8 | data[starts + lens - 1]
    if (crc16(data, starts, lens - 2) != tail).any():
        raise ValueError("CRC-16 of a frame differs")
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    lead = padded[starts + 4].astype(np.int64)
    coded = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, np.where(lead < 0xFE, 6, 7))))))
    c, size = np.zeros(len(starts), np.int64), 4 + coded
    for j in range(int(size.max())):
        c = np.where(j < size, CRC8[c ^ padded[starts + np.minimum(j, size - 1)]], c)
    if (c != padded[starts + size]).any():
        raise ValueError("CRC-8 of a frame header differs")
    window = padded[:-2].astype(np.uint32) << 16 | padded[1:-1].astype(np.uint32) << 8 | padded[2:]

    def get(at, n):
        return (window[at >> 3].astype(np.int64) >> (24 - (at & 7) - n)) & ((1 << n) - 1)

    body = 8 * (starts + size + 1)
    code = get(body, 8) >> 1
    x = np.zeros((len(starts), BLOCK), np.int32)
    constant, verbatim = np.flatnonzero(code == 0), np.flatnonzero(code == 1)
    x[constant] = ((get(body[constant] + 8, 8) ^ 128) - 128)[:, None]
    if len(verbatim):
        x[verbatim] = (padded[((body[verbatim] >> 3) + 1)[:, None] + np.arange(BLOCK)] ^ 128).astype(np.int64) - 128
    rows = np.flatnonzero(code >= 8)
    if not len(rows):
        return x
    order = np.where(code[rows] >= 32, code[rows] - 31, code[rows] - 8)
    rows = rows[np.argsort(order, kind="stable")]
    order = np.sort(order, kind="stable")
    at, linear = body[rows] + 8, code[rows] >= 32
    for j in range(int(order.max())):
        has = order > j
        x[rows[has], j] = (get(at[has], 8) ^ 128) - 128
        at = at + 8 * has
    precision, shift = np.where(linear, get(at, 4) + 1, 0), np.where(linear, get(at + 4, 5), 0)
    at = at + 9 * linear
    coefs = np.zeros((len(rows), max(1, int(order.max()))), np.int32)
    for j in range(int(order.max())):
        has = linear & (order > j)
        raw = get(at, np.where(has, precision, 1))
        coefs[has, j] = np.where(raw >= 1 << np.maximum(precision - 1, 0), raw - (1 << precision), raw)[has]
        at = at + np.where(has, precision, 0)
    for o, known in ((1, (1,)), (2, (2, -1)), (3, (3, -3, 1)), (4, (4, -6, 4, -1))):  # the fixed predictors
        fixed = ~linear & (order == o)
        if fixed.any():
            coefs[fixed, :o] = known
    if (get(at, 2) != 0).any() or (get(at + 2, 4) != 0).any():
        raise ValueError("only 4-bit Rice parameters in one partition are written here")
    k = get(at + 6, 4)
    k = k.astype(np.int32)
    cur, mask = (at + 10).astype(np.int32), (1 << k) - 1
    wide, left = window.view(np.int32), 24 - k
    u = np.zeros((BLOCK, len(rows)), np.int32)
    active = np.searchsorted(order, BLOCK - np.arange(BLOCK), side="left")  # frames with a residual left
    for j, n in enumerate(active):
        now, ks = cur[:n], k[:n]
        zeros = ZEROS.take((wide.take(now >> 3) >> (8 - (now & 7))) & 0xFFFF)
        far = np.flatnonzero(zeros == 16)
        while len(far):  # a run of zeros longer than the window
            at = now[far] + zeros[far]
            more = ZEROS.take((wide.take(at >> 3) >> (8 - (at & 7))) & 0xFFFF)
            zeros[far] += more
            far = far[more == 16]
        u[j, :n] = zeros << ks
        low = now + zeros + 1
        u[j, :n] |= (wide.take(low >> 3) >> (left[:n] - (low & 7))) & mask[:n]
        cur[:n] = low + ks
    r = (u >> 1) ^ -(u & 1)
    for o in np.unique(order):
        own = np.flatnonzero(order == o)
        if o == 0:
            x[rows[own]] = r[:, own].T
            continue
        plain = own[(coefs[own, :1] == 1).all(axis=1) & ~linear[own]] if o == 1 else own[:0]
        if len(plain):  # the first difference is undone by a running sum
            x[rows[plain], 1:] = r[: BLOCK - 1, plain].T
            x[rows[plain]] = np.cumsum(x[rows[plain]], axis=1)
        rest = np.setdiff1d(own, plain)
        if len(rest):
            y, c, s = np.ascontiguousarray(x[rows[rest]].T), coefs[rest].T, shift[rest].astype(np.int32)
            part = np.ascontiguousarray(r[:, rest])
            for i in range(int(o), BLOCK):
                y[i] = part[i - o] + (sum(c[j] * y[i - 1 - j] for j in range(int(o))) >> s)
            x[rows[rest]] = y.T
    return x


def decode_streams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes of whole streams: (bytes, offsets). Checks the MD5 of the samples as well."""
    starts, lens, frames, sums, base = [], [], [], [], 0
    for stream in streams:
        first, md5, table = seek_points(stream)
        at = np.append(table["byte"].astype(np.int64) + first, len(stream))
        starts.append(at[:-1] + base)
        lens.append(np.diff(at))
        frames.append(len(table))
        sums.append(md5)
        base += len(stream)
    if not streams:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    x = decode_frames(np.frombuffer(b"".join(streams), np.uint8), np.concatenate(starts), np.concatenate(lens))
    payload = (x + 128).astype(np.uint8).ravel()
    offsets = np.concatenate([[0], np.cumsum(frames)]) * BLOCK
    signed = payload ^ 128
    for i, md5 in enumerate(sums):
        if hashlib.md5(signed[offsets[i] : offsets[i + 1]]).digest() != md5:
            raise ValueError("MD5 of the samples differs")
    return payload, offsets


def read_samples(stream: bytes, sample: int, count: int) -> bytes:
    """PCM bytes [sample, sample + count) of a stream; only the frames that hold them are decoded."""
    first, _, table = seek_points(stream)
    at = np.append(table["byte"].astype(np.int64) + first, len(stream))
    a = int(np.searchsorted(table["sample"].astype(np.int64), sample, side="right")) - 1
    b = int(np.searchsorted(table["sample"].astype(np.int64), sample + count, side="left"))
    x = decode_frames(np.frombuffer(stream, np.uint8), at[a:b], np.diff(at[a : b + 1]))
    skip = sample - int(table["sample"][a])
    return (x + 128).astype(np.uint8).ravel()[skip : skip + count].tobytes()


def pad(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(offsets)
    size = np.maximum(1, -(-lens // BLOCK)) * BLOCK
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(upto[-1]), PAD, np.uint8)
    out[ragged(upto[:-1], lens)] = data
    return out, upto


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the whole text's UTF-8 bytes, padded with 255 to blocks of 576, as a FLAC stream.

    Null and empty texts become one block of padding. Equal texts give equal streams; repeated rows
    repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in chunks(offsets):
                payload, upto = pad(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                media, at = encode_streams(payload, upto)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(offsets[first : last + 1])), binary_array(media, at, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """Reads ``encode``'s streams back: doc_id, n_bytes, media, pcm (the whole payload)
    and feature (level, zero crossings and peak of the samples).

    Null ids stay null, repeated rows repeat, an empty table gives no rows; a damaged stream is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch.column(2))
            for first, last in chunks(offsets):
                part = batch.slice(first, last - first)
                streams = part.column(2).to_pylist()
                payload, upto = decode_streams(streams)
                x = payload.astype(np.int64) - 128
                n, at = np.diff(upto), upto[:-1]
                cross = np.zeros(len(x), np.int64)
                cross[1:] = (x[1:] < 0) != (x[:-1] < 0)
                cross[at] = 0
                columns = (np.add.reduceat(x, at) / n, np.sqrt(np.add.reduceat(x * x, at) / n), np.add.reduceat(cross, at) / n, np.maximum.reduceat(np.abs(x), at))
                feature = [f"mean={a:.6f};rms={b:.6f};zcr={c:.6f};peak={d}" for a, b, c, d in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), binary_array(payload, upto, pa.binary()), pa.array(feature)], ["doc_id", "n_bytes", "media", "pcm", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary, feature string")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row per block: doc_id, sample_offset, byte_offset in the stream, pcm (576 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, _, table = seek_points(row["media"])
                pcm, _ = decode_streams([row["media"]])
                n = len(table)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * n, pa.int64()), pa.array(table["sample"].astype(np.int64)), pa.array(table["byte"].astype(np.int64) + first), binary_array(pcm, np.arange(n + 1) * BLOCK, pa.binary())], ["doc_id", "sample_offset", "byte_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, byte_offset long, pcm binary")
