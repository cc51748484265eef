"""Best-fit packing of documents into token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.byte_bpe import byte_bpe
from thicket.llm.common import written

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: capacity each, the first one maybe shorter."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    starts = [*([0] if rest else []), *range(rest, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _pieces(batches, path: str, end_id: int, capacity: int, keep_ids: bool):
    bpe, tail = byte_bpe(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids_, texts = batch.column(0), batch.column(1)
        for a in range(0, len(texts), 256):
            out: list[list] = [[] for _ in _PIECE]
            for doc, text in zip(ids_[a : a + 256].to_pylist(), texts[a : a + 256], strict=True):
                raw = bpe.ids(text.as_py()) + tail
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(out, _PIECE, strict=True)], names=[c for c, _ in _PIECE])


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the order given.

    With N(g) open bins of gap g, a length goes to the open bin after which the sum of
    N(g)**2 is smallest (of equal ones, the smallest gap).  Bins should be few, so a new one
    isn't weighed against those open: it is opened if none has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        room = count[s:]
        # From gap g to g - s: N(g) falls and N(g - s) rises by one; gap 0 isn't counted.
        change = 2 * (count[: capacity + 1 - s] - room) + 2
        change[0] = 1 - 2 * room[0]
        change[room == 0] = np.iinfo(np.int64).max
        g = int(change.argmin())
        if room[g]:
            b = open_[s + g].pop()
            count[s + g] -= 1
        else:
            b, g = len(fill), capacity - s
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if g:
            open_[g].append(b)
            count[g] += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, group: int = 8192, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids).

    A document's ids are those of the byte-level BPE file at ``path`` without special tokens,
    then ``end_id``; a null or empty text is the end id alone.  Documents of at most
    ``capacity`` tokens stay whole; longer ones are cut into pieces of ``capacity``, of which
    the first may be shorter.  Rows that repeat an id, equal or not, and rows with a null id
    are packed each for itself.  An empty table gives an empty result.  docs' other columns
    don't matter.

    Tokens never travel: a written table of slim piece rows is dealt, by where a row lies, into
    groups of about ``group`` pieces (so rows that are all alike are dealt like others), and each is packed for itself, longest first, by the
    sum-of-squares rule.  A group leaves only a few bins partly filled, so what splitting
    costs is a fraction of a percent at any size.  Numbers of sequences are unique over all.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = written(plain.mapInArrow(partial(_pieces, path=path, end_id=end_id, capacity=capacity, keep_ids=keep_ids), kinds))
    groups = -(-pieces.count() // group) or 1

    def place(table):
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -length))
        bins, offsets = sum_of_squares(length[order], capacity)
        out = table.take(pa.array(order))
        base = int(out.column("part")[0].as_py()) << 32
        return out.drop_columns(["part"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    out = dealt.groupBy("part").applyInArrow(place, kinds + ", sequence_id long, offset long")
    return out if keep_ids else out.drop("ids")
