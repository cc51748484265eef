"""Substring duplicates: a count-min prefilter, then exact grouping of the windows it lets through.

Documents are dealt by hash into bundles of about ``bundle`` bytes; a bundle is the unit
that counts, asks and removes.  What travels is packed: a bundle's sketch is the sorted list
of the cells it fills, in each of the sketch's rows, cut at block borders.

There are ``BLOCKS`` blocks until a block has 2**``CELLS`` cells (some 40 GB of text), so a
bundle sends the same number of messages at any such size, and messages grow with the bundles
alone.  Beyond, blocks grow in number, and bundles grow with them up to ``MOST_BUNDLE``, to keep
``LEAST_WINDOWS`` windows in a message: 250 at 1 TB of text.  Then the sketch stops growing
where a message would hold fewer than ``FEWEST_WINDOWS``: at 100 TB it has two cells a row for
each window instead of eight, which lets more windows through to the exact pass, and loses none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import free_name, power_of_two, text_bytes, without_results
from thicket.llm.text import mix, utf8, window_owner, windows, words

_SELF, _ENTRY, _SKETCH = 0, 1, 2
_SECOND = np.uint64(0x5851F42D4C957F2D)
_NO_ID = np.iinfo(np.int64).max
#: Blocks at least; the exponent of a block's cells at most (two bitmaps of 32 MB).
BLOCKS, CELLS = 256, 28
#: Bytes of a bundle at most; windows of a message below which bundles grow, and below which the sketch doesn't.
MOST_BUNDLE, LEAST_WINDOWS, FEWEST_WINDOWS = 16 << 20, 256, 16

ANSWER = "bundle long, kind int, block long, bits binary"


def pack(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as gaps of two bytes, or three where they are wide; the largest number moves on without a cell."""
    gaps = np.diff(cells, prepend=0)
    size = 2 if not len(cells) or cells[-1] < len(cells) << 14 else 3
    skip = (1 << 8 * size) - 1
    skips = gaps // skip
    out = np.full(int(skips.sum()) + len(gaps), skip, "<u4")
    out[np.cumsum(skips + 1) - 1] = gaps % skip
    return bytes([size]) + out.view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def unpack(raw) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    size, body = int(data[0]), data[1:]
    if size == 2:
        gaps = body.view("<u2")
    else:
        wide = np.zeros((len(body) // size, 4), np.uint8)
        wide[:, :size] = body.reshape(-1, size)
        gaps = wide.view("<u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.int64)[gaps != (1 << 8 * size) - 1]


class Cells:
    """The cells of a block as two bitmaps: filled once at least, and more than once."""

    def __init__(self, bits: int):
        self.once, self.again = np.zeros(max(1, 1 << bits >> 3), np.uint8), np.zeros(max(1, 1 << bits >> 3), np.uint8)

    def _set(self, bitmap, cells):
        if len(cells):
            byte = cells >> 3
            first = np.flatnonzero(np.diff(byte, prepend=-1))
            bitmap[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (cells & 7).astype(np.uint8), first)

    def _get(self, bitmap, cells):
        return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)

    def add(self, cells: np.ndarray) -> None:
        """Counts sorted cells, equal ones each for itself."""
        self._set(self.again, cells[self._get(self.once, cells)])
        self._set(self.again, cells[1:][cells[1:] == cells[:-1]])
        self._set(self.once, cells)

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        return self._get(self.again, cells)


def join_kept(raw: np.ndarray, lost: np.ndarray) -> bytes:
    """The words of a text that aren't lost (a flag for each word), joined by one space."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    keep = inside & ~lost[np.cumsum(begin, dtype=np.int32) - 1]
    blank = np.zeros(len(raw), bool)
    blank[1:] = keep[:-1] & ~inside[1:]
    out = np.where(blank, np.uint8(32), raw)[keep | blank].tobytes()
    return out[:-1] if blank.any() and np.flatnonzero(blank)[-1] > np.flatnonzero(keep)[-1] else out


class _Bundle:
    """The distinct windows of one bundle: two hashes, smallest document, and every window's entry.

    Windows are one entry if both 64-bit hashes, of words hashed by two families, agree.
    """

    def __init__(self, text, ids: np.ndarray, size: int):
        self.raw, self.at = utf8(text)
        hashes, self.first = words(self.raw, self.at, (1, 2))
        self.size = size
        self.start, self.owner = window_owner(self.first, size)
        self.ids, rank = np.unique(ids, return_inverse=True)
        self.rank = rank.reshape(-1).astype(np.int32)[self.owner]
        h, other = (windows(x, size)[self.start] if len(self.start) else np.zeros(0, np.uint64) for x in hashes)
        order = np.argsort(h)
        new = self._borders(h[order])
        if (self._borders(other[order]) & ~new).any():
            order = np.lexsort((other, h))
            new = self._borders(h[order]) | self._borders(other[order])
        at_ = np.flatnonzero(new)
        self.hash, self.other = h[order[at_]], other[order[at_]]
        self.least = np.minimum.reduceat(self.rank[order], at_) if len(at_) else np.zeros(0, np.int64)
        self.entry = np.empty(len(h), np.int32)
        self.entry[order] = np.cumsum(new, dtype=np.int32) - 1

    @staticmethod
    def _borders(ordered: np.ndarray) -> np.ndarray:
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        return new

    def rows(self, depth: int):
        """The order in which each of the sketch's rows takes the entries, and the values it sorts by."""
        for r in range(depth):
            if r == 0:
                yield np.arange(len(self.hash)), self.hash
            else:
                v = mix(self.hash ^ (_SECOND * np.uint64(r)))
                order = np.argsort(v)
                yield order, v[order]


def _split(values: np.ndarray, bits: int):
    """(block, slice) for sorted 64-bit values dealt to 2**bits blocks by their leading bits."""
    if not len(values):
        return
    block = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
        yield int(block[a]), slice(a, b)


def _ids(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).cast(pa.int64()).fill_null(_NO_ID).to_numpy()


def _flags(answers: pa.Table, n: int, kinds, sizes: dict) -> np.ndarray:
    """The answers of one kind as one flag per entry, in the order asked."""
    out, got = [], {}
    for kind, block, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "block", "bits")), strict=True):
        if kind == kinds:
            got[block] = bits
    for block, count in sizes.items():
        if block not in got:
            raise RuntimeError("a block's answer is missing")
        out.append(np.unpackbits(np.frombuffer(got[block], np.uint8), count=count).astype(bool))
    flags = np.concatenate(out) if out else np.zeros(0, bool)
    if len(flags) != n:
        raise RuntimeError("the answers don't fit the bundle")
    return flags


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, bundle: int = 2 << 20, depth: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: docs' columns, then n_words, n_removed, kept_text.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged, of the whole text; a null text has
    none.  A window is ``window`` consecutive words of one document.  Every word covered by a
    window whose word sequence also starts in a document of smaller id goes; windows are
    judged on the input.  kept_text is the words left, joined by one space (empty if none).
    Rows that repeat an id don't remove each other's words; null ids count as larger than
    every id.  Ids must be integers.  An empty table gives an empty result; columns of docs
    that bear a result's name, in any case, are replaced.

    1. Each bundle fills a count-min sketch of ``depth`` rows with its distinct windows, and
       counts of all bundles are merged, block of cells by block of cells.  A window whose
       cell was filled once in some row occurs in one bundle only; all others are estimated
       to repeat.  The sketch grows with the input, has at least eight cells a row for each
       window of the corpus (two at 100 TB), and is never held whole anywhere.
    2. Windows estimated to repeat are grouped exactly, within a bundle and across bundles,
       by a 128-bit hash of their words, each with the smallest id that has it.  Windows are
       dealt to groups by hash, and a bundle sends a window once: a passage of very many
       documents adds one entry of 24 bytes a bundle to a window's group (2 MB at 1 TB, 150 MB
       at 100 TB of text in which every bundle has it), whatever share of the rows holds it.
    3. Each bundle removes the words.  Repeats inside a bundle need no messages.
    """
    docs = without_results(docs, ("n_words", "n_removed", "kept_text"), id_col, text_col)
    total = text_bytes(docs, text_col)
    width = power_of_two(4 * total / 6) + 1
    width = min(width, max(power_of_two(blocks), int(MOST_BUNDLE / 6 / FEWEST_WINDOWS).bit_length() - 1) + CELLS)
    bits = max(power_of_two(blocks), width - CELLS)
    cell_bits = max(3, width - bits)  # of a block
    bundle = max(bundle, min(MOST_BUNDLE, 6 * LEAST_WINDOWS << bits)) if bits > power_of_two(blocks) else bundle
    bundles = max(1, -(-total // bundle))
    key = free_name(docs, "bundle_key")[0]
    # Rows that repeat an id and a text are dealt by where they lie.
    dealt = docs.withColumn(key, F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.spark_partition_id()), F.lit(bundles)))
    parts = dealt.groupBy(key)
    message = "block long, bundle long, kind int, hash binary, other binary, doc binary, ids binary"

    def cells_of(values, piece, bits=bits, cell_bits=cell_bits):
        v = values[piece] << np.uint64(bits) if bits else values[piece]
        return (v >> np.uint64(64 - cell_bits)).astype(np.int64)

    def fill(table):
        b = _Bundle(table.column(text_col), _ids(table, id_col), window)
        name = int(table.column(key)[0].as_py())
        block_, payload = [], []
        for r, (_, values) in enumerate(b.rows(depth)):
            for k, piece in _split(values, bits):
                block_.append(r * (1 << bits) + k)
                payload.append(pack(cells_of(values, piece)))
        return pa.table({"block": pa.array(block_, pa.int64()), "bundle": pa.array([name] * len(block_), pa.int64()), "cells": pa.array(payload, pa.binary())})

    def merge(table):
        lists, filled = [unpack(x.as_buffer()) for x in table.column("cells")], Cells(cell_bits)
        for cells in lists:
            filled.add(cells)
        bits_ = [np.packbits(filled.repeated(cells)).tobytes() for cells in lists]
        n = len(lists)
        return pa.table({"bundle": table.column("bundle"), "kind": pa.array([_SKETCH] * n, pa.int32()), "block": table.column("block"), "bits": pa.array(bits_, pa.binary())})

    def ask(table, answers):
        if not table.num_rows:
            return pa.table({c: pa.array([], k) for c, k in _MESSAGE})
        b = _Bundle(table.column(text_col), _ids(table, id_col), window)
        name = int(table.column(key)[0].as_py())
        likely = np.ones(len(b.hash), bool)
        for r, (order, values) in enumerate(b.rows(depth)):
            sizes = {r * (1 << bits) + k: piece.stop - piece.start for k, piece in _split(values, bits)}
            flags = _flags(answers, len(values), _SKETCH, sizes)
            likely[order] &= flags
        out = {c: [] for c, _ in _MESSAGE}
        add = lambda *row: [x.append(v) for x, v in zip(out.values(), row, strict=True)]
        add(name % (1 << bits), name, _SELF, np.packbits(likely).tobytes(), b"", b"", b"")
        h, other, least = b.hash[likely], b.other[likely], b.least[likely]
        for k, piece in _split(h, bits):
            docs_, index = np.unique(least[piece], return_inverse=True)
            add(k, name, _ENTRY, h[piece].tobytes(), other[piece].tobytes(), index.astype(np.uint16 if len(docs_) < 1 << 16 else np.uint32).tobytes(), b.ids[docs_].tobytes())
        return pa.table({c: pa.array(out[c], k) for c, k in _MESSAGE})

    def settle(table):
        kinds = table.column("kind").to_numpy()
        mine = np.flatnonzero(kinds == _ENTRY).tolist()
        col = {c: table.column(c).to_pylist() for c in ("hash", "other", "doc", "ids")}
        hashes = [np.frombuffer(col["hash"][i], np.uint64) for i in mine]
        docs_ = []
        for i, h in zip(mine, hashes, strict=True):
            raw = col["doc"][i]
            docs_.append(np.frombuffer(col["ids"][i], np.int64)[np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(h) else np.uint32)])
        bits_ = [col["hash"][i] if kinds[i] == _SELF else b"" for i in range(len(kinds))]
        if mine:
            h, o, d = np.concatenate(hashes), np.concatenate([np.frombuffer(col["other"][i], np.uint64) for i in mine]), np.concatenate(docs_)
            order = np.lexsort((o, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (o[order][1:] != o[order][:-1])
            least = np.minimum.reduceat(d[order], np.flatnonzero(new))
            smaller = np.empty(len(h), bool)
            smaller[order] = least[np.cumsum(new) - 1] < d[order]
            pos = 0
            for i, x in zip(mine, hashes, strict=True):
                bits_[i] = np.packbits(smaller[pos : pos + len(x)]).tobytes()
                pos += len(x)
        return pa.table({"bundle": table.column("bundle"), "kind": table.column("kind"), "block": table.column("block"), "bits": pa.array(bits_, pa.binary())})

    def remove(table, answers):
        if not table.num_rows:
            return empty
        b = _Bundle(table.column(text_col), _ids(table, id_col), window)
        own = [x for k, x in zip(answers.column("kind").to_pylist(), answers.column("bits").to_pylist(), strict=True) if k == _SELF]
        likely = np.unpackbits(np.frombuffer(own[0], np.uint8), count=len(b.hash)).astype(bool) if len(b.hash) else np.zeros(0, bool)
        asked = b.hash[likely]
        elsewhere = np.zeros(len(b.hash), bool)
        elsewhere[likely] = _flags(answers, len(asked), _ENTRY, {k: piece.stop - piece.start for k, piece in _split(asked, bits)})
        gone = (b.rank > b.least[b.entry]) | elsewhere[b.entry]
        cover = np.zeros(int(b.first[-1]) + 1, np.int32)
        s = b.start[gone]
        cover[s] += 1
        cover[s + window] -= 1
        lost = np.cumsum(cover)[:-1] > 0
        many = np.diff(b.first)
        sums = np.concatenate([[0], np.cumsum(lost)])
        removed = sums[b.first[1:]] - sums[b.first[:-1]]
        kept = [b"" if r == n else join_kept(b.raw[x:y], lost[i:j]) for r, n, x, y, i, j in zip(*(v.tolist() for v in (removed, many, b.at[:-1], b.at[1:], b.first[:-1], b.first[1:])), strict=True)]
        out = table.drop_columns([key])
        return out.append_column("n_words", pa.array(many, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    empty = to_arrow_schema(schema).empty_table()
    filled = parts.applyInArrow(fill, "block long, bundle long, cells binary")
    answers = filled.groupBy("block").applyInArrow(merge, ANSWER)
    asked = parts.cogroup(answers.groupBy("bundle")).applyInArrow(ask, message)
    settled = asked.groupBy("block").applyInArrow(settle, ANSWER)
    return parts.cogroup(settled.groupBy("bundle")).applyInArrow(remove, schema)


_MESSAGE = [("block", pa.int64()), ("bundle", pa.int64()), ("kind", pa.int32()), ("hash", pa.binary()), ("other", pa.binary()), ("doc", pa.binary()), ("ids", pa.binary())]
