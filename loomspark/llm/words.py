"""Words and word shingles of many texts as 64-bit hashes, in whole-array steps.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Words and shingles are
held as 64-bit hashes; two different shingles meet with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 5
_BYTE = np.random.default_rng(20_251).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(20_252).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, start byte, length in bytes)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = SEPARATOR[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = out[:-1], out[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[0] = after[-1] = True
    before[inner], after[inner - 1] = True, True
    within = ~out
    starts, ends = np.flatnonzero(within & before), np.flatnonzero(within & after) + 1
    lens = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), starts, lens
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    terms = _BYTE[fold[data[within]]] * powers(int(lens.max()))[place]
    hashes = mix(np.add.reduceat(terms, first) + lens.astype(np.uint64) * _PLACE[0])
    return hashes, np.searchsorted(starts, offsets), starts, lens


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: (hash, index of the text), ordered by text and hash, and how many each text has.

    A text with fewer words than ``size`` has its whole word sequence as one shingle; without words, none.
    """
    words, first, _, _ = word_hashes(data, offsets)
    count = np.diff(first)
    place = np.concatenate([_PLACE, mix(_PLACE)])[:size] if size > SHINGLE else _PLACE[:size]
    values, owners = [], []
    if len(words) >= size:
        total = words[: len(words) - size + 1] * place[0]
        for k in range(1, size):
            total += words[k : len(words) - size + 1 + k] * place[k]
        owner = np.repeat(np.arange(len(count)), count)
        whole = owner[: len(total)] == owner[size - 1 :]
        values.append(mix(total[whole]))
        owners.append(owner[: len(total)][whole])
    for k in range(1, size):
        texts = np.flatnonzero(count == k)
        if len(texts):
            at = first[texts]
            total = np.full(len(texts), k, np.uint64)
            for j in range(k):
                total += words[at + j] * place[j]
            values.append(mix(total))
            owners.append(texts)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    kind = np.uint16 if len(count) < 65_536 else np.int64
    order = order[np.argsort(owner[order].astype(kind), kind="stable")]
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, owner, np.bincount(owner, minlength=len(count))
