"""Exact top-k inner products by a bit-sliced index.

A block of vectors holds, for every dimension, its quantised values as bit slices: bitmap s
of a dimension has a bit for each vector whose value has bit s.  A query adds the slices that
its components name with carry-save bitmap arithmetic, which gives the slices of all sums;
the best rows are selected from the most significant slice downward, and the rows at the
border, which quantisation leaves open, are resolved with the full integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.common import free_name

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def signed_digits(n: int) -> list[tuple[int, int]]:
    """n as a sum of sign * 2**weight with as few terms as can be."""
    out, w = [], 0
    while n:
        if n & 1:
            d = 2 - (n & 3)
            out.append((d, w))
            n -= d
        n >>= 1
        w += 1
    return out


class SlicedBlock:
    """The slices of a block of integer vectors, after dropping the lowest ``drop`` bits."""

    def __init__(self, vectors: np.ndarray, drop: int):
        self.full, self.drop, self.n = vectors, drop, len(vectors)
        self.low = int(vectors.min()) >> drop if vectors.size else 0
        coarse = (vectors >> drop) - self.low  # not negative
        self.depth = max(1, int(coarse.max()).bit_length()) if vectors.size else 1
        self.words = -(-max(self.n, 1) // 64)
        self.slices = np.zeros((vectors.shape[1], self.depth, self.words), np.uint64)
        for s in range(self.depth):
            bits = np.packbits((coarse >> s & 1).astype(bool).T, axis=1, bitorder="little")
            self.slices[:, s].view(np.uint8)[:, : bits.shape[1]] = bits
        self.real = np.zeros(self.words, np.uint64)
        self.real.view(np.uint8)[: -(-self.n // 8)] = np.packbits(np.ones(self.n, bool), bitorder="little")

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices (least first) of sum of query * coarse plus an offset that makes all sums non-negative, and the offset."""
        plus: dict[int, list[tuple[int, int]]] = {}
        offset = 0
        for d, q in enumerate(query.tolist()):
            for sign, w in signed_digits(q):
                for s in range(self.depth):
                    plus.setdefault(w + s, []).append((sign, d * self.depth + s))
                    if sign < 0:
                        offset += 1 << (w + s)  # -x is (1 - x) - 1 for a bit x
        flat = self.slices.reshape(-1, self.words)
        out, carry, w = [], np.zeros((0, self.words), np.uint64), 0
        last = max(plus, default=-1)
        while w <= last or len(carry):
            here = plus.get(w, [])
            now = flat[[i for _, i in here]] if here else np.zeros((0, self.words), np.uint64)
            if here:
                flip = np.array([s < 0 for s, _ in here])
                now[flip] ^= _ONES
            now = np.concatenate([carry, now])
            carries = []
            while len(now) > 2:  # three bitmaps of one weight give one of it and one of the next
                m = len(now) // 3
                a, b, c = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                now = np.concatenate([ab ^ c, now[3 * m :]])
            if len(now) == 2:
                carries.append((now[0] & now[1])[None])
                now = (now[0] ^ now[1])[None]
            out.append(now[0] if len(now) else np.zeros(self.words, np.uint64))
            carry = np.concatenate(carries) if carries else np.zeros((0, self.words), np.uint64)
            w += 1
        return out, offset

    def _at_least(self, sums: list[np.ndarray], bound: int, among: np.ndarray) -> np.ndarray:
        if bound <= 0:
            return among
        if bound >> len(sums):
            return np.zeros_like(among)
        more, equal = np.zeros_like(among), among.copy()
        for s in range(len(sums) - 1, -1, -1):
            if bound >> s & 1:
                equal = equal & sums[s]
            else:
                more |= equal & sums[s]
                equal = equal & ~sums[s]
        return more | equal

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but ``own``, ties to the smaller id."""
        among = self.real.copy()
        mine = np.flatnonzero(ids == own)
        np.bitwise_and.at(among, mine // 64, ~(np.uint64(1) << (mine % 64).astype(np.uint64)))
        sums, _ = self.sums(query)
        count = lambda x: int(np.bitwise_count(x).sum())
        # The k-th largest coarse sum, from the most significant slice downward.
        kth, need, equal = 0, k, among
        if count(among) > k:
            for s in range(len(sums) - 1, -1, -1):
                high = equal & sums[s]
                c = count(high)
                if c >= need:
                    kth |= 1 << s
                    equal = high
                else:
                    need -= c
                    equal = equal & ~sums[s]
            # True = coarse * 2**drop + rest, where rest lies between these two.
            most = (1 << self.drop) - 1
            spread = int(np.abs(query).sum()) * most
            among = self._at_least(sums, kth - -(-spread >> self.drop) - 1, among)
        rows = np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little")[: self.n])
        scores = self.full[rows].astype(np.int64) @ query.astype(np.int64)
        order = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows[order]], scores[order]


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, modulus: int = 50, scale: int = 256, block: int = 16384, query_block: int = 16384, drop: int = 2) -> DataFrame:
    """For each query its k highest scores: query_id, rank (from 1), vec_id, score.

    A component x becomes floor(scale * x), x as double; the score of two vectors is their
    integer inner product (as long as the shorter of the two).  Queries are the rows whose id
    is divisible by ``modulus``; candidates are all rows but those of the query's own id; ties go
    to the smaller id.  Vectors that are null or hold a null or non-finite component, rows with a
    null id, and empty vectors take no part.  Rows that repeat an id with the same vector
    count once; with several vectors, each is a candidate, and each, as a query, is answered
    under its id.  An empty table, or one without queries, gives no rows.  Other columns don't
    matter.  Where components are so large that a score might not fit 64 bits, a ValueError
    says so before anything is compared; components travel as 32-bit integers.

    Rows are dealt by hash into blocks of about ``block``, queries into blocks of about
    ``query_block``.  Each pair of blocks is one group: its index answers its queries with
    its own k best, and these meet per query.  So what a task holds depends on neither count,
    and a query sends k rows from each block of rows.
    """
    (v,) = free_name(vectors, "v")
    array = F.col(f"`{vector_col}`")
    scaled = F.transform(array, lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.floor(x.cast("double") * scale).cast("long")))
    rows = vectors.filter(array.isNotNull() & (F.size(array) > 0) & F.col(f"`{id_col}`").isNotNull())
    rows = rows.withColumn(v, scaled).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(v).alias("v"))
    rows = rows.filter(~F.exists("v", lambda x: x.isNull())).distinct()
    # Both sides of a cogroup; a block's vectors all have one length, the longest, filled with zeros.
    n, n_queries, length, high, low = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % modulus == 0), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    most = max(high or 0, -(low or 0))
    if (most + 1) ** 2 * (length or 0) >= 1 << 62:
        raise ValueError(f"components of up to {most} in {length} dimensions: scores don't fit 64 bits")
    rows = rows.withColumn("v", F.col("v").cast("array<int>"))  # of larger ones no score would fit
    blocks, query_blocks, length = max(1, -(-n // block), min(4, n // 2048)), max(1, -(-n_queries // query_block)), length or 0
    number = lambda among: F.pmod(F.xxhash64("id"), F.lit(among).cast("long"))
    every = lambda among: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(among - 1).cast("long")))
    index = rows.select(number(blocks).alias("blk"), every(query_blocks).alias("q_blk"), "id", "v")
    queries = rows.filter(F.col("id") % modulus == 0).select(every(blocks).alias("blk"), number(query_blocks).alias("q_blk"), "id", "v")

    def square(table):
        if not table.num_rows:
            return np.zeros((0, length), np.int64)
        column = table.column("v").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(size), length), np.int64)
        if (size == length).all():
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(size), length).astype(np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(np.arange(len(size)), size), at] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def answer(left, right):
        ids = left.column("id").to_numpy()
        made = SlicedBlock(square(left), drop)
        q_ids, q = right.column("id").to_numpy(), square(right)
        out = [[], [], []]
        for own, query in zip(q_ids.tolist(), q, strict=True):
            best, scores = made.top(query, ids, own, k)
            out[0].append(np.full(len(best), own))
            out[1].append(best)
            out[2].append(scores)
        cat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    found = index.groupBy("blk", "q_blk").cogroup(queries.groupBy("blk", "q_blk")).applyInArrow(answer, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
