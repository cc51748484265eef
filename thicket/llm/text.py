"""Vectorised word hashing shared by the word-shingle operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` gives.  Words are hashed straight from Arrow's UTF-8 buffers:
a polynomial over per-byte random values is accumulated with one running sum, so
a word's hash is a difference of two prefix sums divided by its starting power
(the base is odd, hence invertible modulo 2**64).  Work proceeds in slices of
about ``SLICE`` bytes that end between words, and a word that fills a slice is hashed
slice by slice, so memory does not depend on how long a text or a word is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_MIX_A, _MIX_B, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class _Family:
    """One member of the hash family: byte values, powers of its base and of the inverse."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.power = self.unpower = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, b in (("power", self.base), ("unpower", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))


_families: dict[int, _Family] = {}


def _family(seed: int) -> _Family:
    if seed not in _families:
        _families[seed] = _Family(seed)
    return _families[seed]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _blank(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _word_end(raw: np.ndarray, pos: int, stop: int) -> int:
    """Where the word that begins at pos ends, in a text that ends at stop."""
    while pos < stop:
        gaps = np.flatnonzero(_blank(raw[pos : min(pos + SLICE, stop)]))
        if len(gaps):
            return pos + int(gaps[0])
        pos = min(pos + SLICE, stop)
    return stop


def _long_word(word: np.ndarray, f: _Family, lower: bool) -> np.ndarray:
    """The hash of one word, slice by slice."""
    total = np.zeros(1, np.uint64)
    f.grow(SLICE + 1)
    for k in range(0, len(word), SLICE):
        b = word[k : k + SLICE]
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        part = np.sum(f.table[b] * f.power[: len(b)], dtype=np.uint64, keepdims=True)
        total = total + part * np.uint64(pow(f.base, k, 2**64))
    return mix(total + np.array([len(word)], np.uint64) * _GOLD)


def words(raw: np.ndarray, at: np.ndarray, seeds: tuple[int, ...] = (1,), lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, one array for each seed, and each text's first word (n + 1 offsets).

    ``lower`` folds A-Z to a-z first.
    """
    out: list[list[np.ndarray]] = [[] for _ in seeds]
    first = []
    cuts = at[1:-1]
    pos, n = 0, len(raw)
    while pos < n:
        end = min(pos + SLICE, n)
        if end < n:  # end behind the last blank, or where a text ends
            stop = int(at[np.searchsorted(at, end, "right") - 1])
            gaps = np.flatnonzero(_blank(raw[pos:end]))
            end = max(stop, pos + int(gaps[-1]) + 1 if len(gaps) else pos)
            if end == pos:  # one word fills the slice
                end = _word_end(raw, pos, int(at[np.searchsorted(at, pos, "right")]))
                first.append(np.array([pos]))
                for k, seed in enumerate(seeds):
                    out[k].append(_long_word(raw[pos:end], _family(seed), lower))
                pos = end
                continue
        b = raw[pos:end]
        inside = ~_blank(b)
        begin, close = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        close[:-1] &= ~inside[1:]
        here = cuts[np.searchsorted(cuts, pos, "right") : np.searchsorted(cuts, end, "left")] - pos
        here = here[here > 0]
        begin[here] = inside[here]
        close[here - 1] = inside[here - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
        first.append(s + pos)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        for k, seed in enumerate(seeds):
            f = _family(seed)
            f.grow(len(b) + 1)
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(f.table[b] * f.power[: len(b)], out=total[1:])
            out[k].append(mix((total[e] - total[s]) * f.unpower[s] + (e - s).astype(np.uint64) * _GOLD))
        pos = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = join(first, np.int64)
    return [join(x, np.uint64) for x in out], np.searchsorted(starts, at)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words (shorter by size - 1; runs may cross texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(0xD1342543DE82EF95)
        total += hashes[k : k + n]
    return mix(total)


def window_owner(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that lie within one text: their first words, and their text's index."""
    counts = np.diff(first)
    have = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), have)
    start = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + first[:-1][owner]
    return start, owner
