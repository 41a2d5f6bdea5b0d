"""Byte-pair merging of many words at once over flat numpy arrays.

Vocabulary files are those of the ``tokenizers`` library and are read from a path given by the caller.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .common import ragged

#: How the two public vocabularies split text into pre-tokens.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
DOUBLE_SPACE = re.compile(r"\s\s")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks as sorted pair keys, and each token's bytes, of a ``tokenizers`` BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b[: len(b)]] if a + b in vocab else -1 for a, b in merges], np.int64)
        keys, where = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = keys, where.astype(np.int32), made[where]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.fold = any(x["type"] == "Lowercase" for x in steps)
        self.compose = any(x["type"] == "NFC" for x in steps)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        own = next((x["pattern"]["Regex"] for x in parts if x["type"] == "Split"), None)
        self.pattern = regex.compile(own or BYTE_LEVEL_PATTERN)
        self.drops_space = own is not None
        back = {s: b for b, s in enumerate(symbols)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(back[c] for c in token.removesuffix(end) if c in back)
        for token, i in self.special.items():
            table[i] = token.encode()
        self.token_lens = np.array([len(t) for t in table], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)

    def pieces(self, text: str | None) -> list:
        """The text cut into pieces that are split into pre-tokens independently of each other.

        A cut before a space and around a line end is safe where no two whitespace characters meet; a
        text where they do is one piece, unless whitespace is dropped anyway. A special token's string
        comes as its negative id minus one.
        """
        if not text:
            return []
        if self.split_special is None or "<|" not in text:
            return self.cut(text)
        out: list = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(-1 - self.special[part])
            elif part:
                out += self.cut(part)
        return out

    def cut(self, text: str) -> list[str]:
        if self.drops_space:
            return self.normal(text).replace("\n", " ").split(" ")
        text = self.normal(text)
        if "\0" in text or DOUBLE_SPACE.search(text):
            return self.pattern.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.fold else text
        if self.compose and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter, so a final sigma is an ordinary sigma
        return text.replace("Σ", "σ").lower() if self.fold else text

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, index among the pair keys) of adjacent symbols, by binary search; NONE where no merge exists."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words, given as one flat byte array and the length of each: (flat ids, count of each).

        In every round each word's lowest-rank pair is found and all its occurrences are merged, left
        to right, in all words at once. Words without a mergeable pair leave the flat array.
        """
        total, lens = len(lens), np.asarray(lens, np.int64)
        word = np.flatnonzero(lens > 0)
        lens = lens[word]
        symbol = self.first[data]
        symbol[np.cumsum(lens) - 1] = self.last[data[np.cumsum(lens) - 1]]
        rank, at = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            rank[:-1], at[:-1] = self.lookup(symbol[:-1], symbol[1:])
        rank[np.cumsum(lens) - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(lens) - lens
            lowest = np.minimum.reduceat(rank, starts)
            ready = lowest == NONE
            if ready.any():
                mask = np.repeat(ready, lens)
                done.append((word[ready], lens[ready], symbol[mask]))
                word, lens, lowest = word[~ready], lens[~ready], lowest[~ready]
                symbol, rank, at = symbol[~mask], rank[~mask], at[~mask]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lens))
            if len(hit) > 1:  # of overlapping occurrences (x x x) every second one counts, from the left
                run = np.ones(len(hit), bool)
                run[1:] = np.diff(hit) != 1
                first = np.flatnonzero(run)
                offset = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
                hit = hit[offset % 2 == 0]
            symbol[hit] = self.made[at[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            last = np.zeros(len(symbol), bool)
            last[np.cumsum(lens) - 1] = True
            last[hit] = last[hit + 1]
            owner = np.searchsorted(np.cumsum(lens), hit, side="right")
            lens = lens - np.bincount(owner, minlength=len(lens))
            moved = np.cumsum(keep) - 1
            symbol, rank, at, last, hit = symbol[keep], rank[keep], at[keep], last[keep], moved[hit]
            near = np.zeros(len(symbol), bool)
            near[hit] = True
            near[hit[hit > 0] - 1] = True
            changed = np.flatnonzero(near)
            rank[changed] = NONE
            changed = changed[~last[changed]]
            rank[changed], at[changed] = self.lookup(symbol[changed], symbol[changed + 1])
        count = np.zeros(total, np.int64)
        if not done:
            return np.zeros(0, np.int32), count
        words, sizes, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        count[words] = sizes
        order = np.argsort(words)
        starts = np.cumsum(sizes) - sizes
        return flat[ragged(starts[order], sizes[order])].astype(np.int32), count

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many id sequences: (flat bytes, byte length of each)."""
        sizes = self.token_lens[ids]
        flat = self.token_bytes[ragged(self.token_starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        upto = np.cumsum(lens)
        return flat, ends[upto] - ends[upto - lens]


class Slots(dict):
    """piece -> slot; a piece not seen before gets the next slot and is put on ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, piece):
        self[piece] = slot = len(self)
        self.new.append(piece)
        return slot


class Encoder:
    """A vocabulary with a bounded memory of pieces already merged, which goes with its task: idle workers hold the vocabulary only."""

    MOST = 200_000

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.slot = Slots()
        self.lens, self.starts, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        for i in self.v.special.values():
            self.slot[-1 - i] = len(self.slot)
        self._append(np.array(list(self.v.special.values()), np.int32), np.ones(len(self.v.special), np.int64))

    def _append(self, ids: np.ndarray, lens: np.ndarray) -> None:
        starts = self.used + np.cumsum(lens) - lens
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def slots(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each piece of all texts, number of pieces of each text)."""
        if len(self.slot) > self.MOST:
            self.clear()
        pieces: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.v.pieces(text)
            counts[i] = len(found)
            pieces += found
        out = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        if self.slot.new:
            self._learn(self.slot.new)
            self.slot.new = []
        return out, counts

    def _learn(self, pieces: list[str]) -> None:
        known, of, sizes = Slots(), [], np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            found = self.v.pattern.findall(piece)
            sizes[i] = len(found)
            of += [known[x] for x in found]
        raw = [x.encode() for x in known.new]
        ids, lens = self.v.merge(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
        token = np.array(of, np.int64)
        self._append(ids[ragged((np.cumsum(lens) - lens)[token], lens[token])], sums(lens[token], sizes))

    def count(self, texts: list[str | None]) -> np.ndarray:
        slots, counts = self.slots(texts)
        return sums(self.lens[slots], counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        slots, counts = self.slots(texts)
        sizes = self.lens[slots]
        return self.ids[ragged(self.starts[slots], sizes)], sums(sizes, counts)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


@lru_cache(maxsize=2)
def loaded(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoder(path: str) -> Encoder:
    return Encoder(loaded(path))
