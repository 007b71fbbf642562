"""Words and word shingles of many texts at once: their places and 64-bit hashes, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of the characters [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, and all of a character beyond ASCII.
ALNUM = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)

#: Bytes hashed in one go, and bytes of text per group of texts; a longer text is a group of its own.
_PIECE, _GROUP = 1 << 17, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, np.uint64(base))]), dtype=np.uint64)


_POWER, _INVERSE = _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a group of texts: byte places in `data`, hashes, and `first[i]`, the first word of text i (one entry more)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def joined(self, a: int, b: int) -> str:
        """Words a to b (not included), joined by spaces."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)).decode()

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers at which `size` words of one text begin, their hashes)."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        total = np.full(n, np.uint64(size))
        for j in range(size):
            total = total * _BASE + self.hashes[j : j + n]
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        return at, _mixed(total)[at]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _PIECE, "right"))
        if j <= i:  # one very long word
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        base, end = starts[i], ends[j - 1]
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((data[base:end].astype(np.uint64) + np.uint64(1)) * _POWER[: end - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = _mixed((sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64))
        i = j
    return out


def scan(texts: pa.Array, is_word: np.ndarray = ALNUM, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first text, end text, words) for groups of texts of about 2 MB. A null text has no words."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _GROUP, "right")))
        raw = b"".join(x.encode() for x in texts.slice(at, end - at).to_pylist() if x)
        data = np.frombuffer(raw, np.uint8)
        data = LOWER[data] if lower else data
        bounds = np.concatenate([[0], np.cumsum(sizes[at:end])])
        flag = np.concatenate([is_word[data], [False]])
        opens = flag[:-1].copy()
        opens[1:] &= ~flag[:-2]
        closes = flag[:-1] & ~flag[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        opens[inner] = flag[inner]
        closes[inner - 1] = flag[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        yield at, end, Words(data, starts, ends, _hashes(data, starts, ends), np.searchsorted(starts, bounds))
        at = end
