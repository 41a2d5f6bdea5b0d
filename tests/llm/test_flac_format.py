"""The FLAC streams against a decoder of one bit at a time, written from the public format alone."""

import hashlib

import numpy as np
import pytest

from loomspark.llm import flac


def crc(data, width, polynomial):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1) ^ polynomial if value >> (width - 1) else value << 1
            value &= (1 << width) - 1
    return value


class Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def zeros(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def residuals(bits, order, size):
    width, partitions, out = (4, 5)[bits.take(2)], bits.take(4), []
    for p in range(1 << partitions):
        n, k = (size >> partitions) - (order if p == 0 else 0), bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            x = bits.zeros() << k | bits.take(k)
            out.append(x >> 1 if x & 1 == 0 else -(x >> 1) - 1)
    return out


FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def subframe(bits, size, depth):
    assert bits.take(1) == 0
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift = [bits.signed(depth) for _ in range(order)], 0
        weights = FIXED[order] if kind < 32 else None
        if weights is None:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in residuals(bits, order, size):
            out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    return [x << wasted for x in out], kind


def decode(stream):
    """(samples, kinds of subframes seen, STREAMINFO's number of samples and MD5)."""
    assert stream[:4] == b"fLaC"
    at, last, total, md5 = 4, False, None, None
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = Bits(stream[at + 4 : at + 4 + n])
            info.take(16 + 16 + 24 + 24 + 20)
            assert (info.take(3) + 1, info.take(5) + 1) == (1, 8)
            total, md5 = info.take(36), stream[at + 4 + 18 : at + 4 + 34]
        at += 4 + n
    samples, kinds, number = [], set(), 0
    while at < len(stream):
        bits = Bits(stream[at:])
        assert bits.take(15) == 0b111111111111100 and bits.take(1) == 0  # blocks of one size
        size_code, rate_code, channels, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        assert channels == 0 and depth_code in (0, 1) and bits.take(1) == 0
        lead = bits.take(8)
        more = 0 if lead < 128 else bin(lead)[2:].index("0") - 1
        value = lead if not more else lead & ((1 << (6 - more)) - 1)
        for _ in range(more):
            value = value << 6 | bits.take(8) & 63
        assert value == number
        size = {1: 192, 6: None, 7: None}.get(size_code, 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8))
        if size is None:
            size = bits.take(8 if size_code == 6 else 16) + 1
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        head = bits.at // 8
        assert bits.take(8) == crc(stream[at : at + head], 8, 0x07)
        x, kind = subframe(bits, size, 8)
        bits.at = -(-bits.at // 8) * 8
        end = bits.at // 8
        assert bits.take(16) == crc(stream[at : at + end], 16, 0x8005)
        samples += x
        kinds.add(kind)
        at, number = at + end + 2, number + 1
    return samples, kinds, total, md5


def payloads():
    draw = np.random.default_rng(3)
    wave = np.round(100 * np.sin(np.arange(576 * 3) / 9)).astype(int) + 128
    yield np.full(576 * 2, 255), {0}
    yield draw.integers(0, 256, 576), {1}
    yield np.frombuffer(("plain prose of many words, repeated a little " * 40).encode()[:1728], np.uint8), None
    yield wave, None
    yield np.concatenate([np.full(576, 255), wave[:576], draw.integers(0, 256, 576)] + [wave[576:1152]] * 130), None


@pytest.mark.parametrize("case", list(payloads()), ids=range(5))
def test_streams_follow_the_format(case):
    payload, kinds = np.asarray(case[0], np.uint8), case[1]
    stream = flac.encode_streams(payload, np.array([0, len(payload)]))[0].tobytes()
    samples, seen, total, md5 = decode(stream)
    assert (np.array(samples) + 128).astype(np.uint8).tobytes() == payload.tobytes()
    assert total == len(payload) and md5 == hashlib.md5((payload ^ 128).tobytes()).digest()
    assert kinds is None or seen == kinds
