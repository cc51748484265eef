"""Whitening of embeddings with a compensated covariance.

Components become integers, so their sums, the mean and each row's deviation are exact.  A
task adds centred outer products in double-double arithmetic: every product and every sum
is split into its rounded value and its error (error-free transformations), and both parts
travel and merge across tasks.  The covariance's eigenvectors come from ``eigen``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import written
from thicket.llm.eigen import eigen

#: Largest integer component; rows whose products are added in one go.
MOST, STEP = 1 << 40, 256
_SPLIT = float((1 << 27) + 1)


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a):
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add_up(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over the first axis of double-doubles, pair by pair."""
    while len(high) > 1:
        h = len(high) // 2
        s, e = two_sum(high[:h], high[h : 2 * h])
        e += low[:h] + low[h : 2 * h]
        high, low = (s, e) if len(high) == 2 * h else (np.concatenate([s, high[2 * h :]]), np.concatenate([e, low[2 * h :]]))
    return two_sum(high[0], low[0])


class Moments:
    """Sums of vectors and of their outer products, in double-double: row i of the products from column i on."""

    def __init__(self, size: int):
        self.n, self.size = 0, size
        self.high, self.low = np.zeros((size + 1, size)), np.zeros((size + 1, size))  # the last row has the vectors' sum

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Rows of vectors, each entry high + low."""
        for k in range(0, len(high), STEP):
            a, b = high[k : k + STEP], low[k : k + STEP]
            for i in range(self.size):
                p, e = two_product(a[:, i, None], a[:, i:])
                e += a[:, i, None] * b[:, i:] + b[:, i, None] * a[:, i:]
                self._merge(i, slice(i, None), *add_up(p, e))
            self._merge(self.size, slice(None), *add_up(a, b))
        self.n += len(high)

    def _merge(self, row, at, high, low):
        s, e = two_sum(self.high[row, at], high)
        self.high[row, at], self.low[row, at] = two_sum(s, e + self.low[row, at] + low)

    def merge(self, n: int, high: bytes, low: bytes) -> None:
        shape = (self.size + 1, self.size)
        self._merge(slice(None), slice(None), np.frombuffer(high).reshape(shape), np.frombuffer(low).reshape(shape))
        self.n += n

    def covariance(self) -> np.ndarray:
        """With divisor n; what is left of the mean is taken off."""
        upper = np.triu(self.high[:-1] / self.n + self.low[:-1] / self.n)
        mean = (self.high[-1] + self.low[-1]) / self.n
        return upper + np.triu(upper, 1).T - np.outer(mean, mean)


def _matrix(column, length: int) -> np.ndarray:
    """An Arrow list column as rows of ``length`` doubles; shorter lists are filled with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (size == length).all():
        return flat.reshape(len(size), length)
    out = np.zeros((len(size), length))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _integers(vectors: np.ndarray, scale: int, offset: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
    return np.clip(x, -4.0 * MOST, 4.0 * MOST).astype(np.int64) + offset  # what is cut off is over MOST, an error


def _sums(batches, length: int, scale: int, offset: int):
    for b in batches:
        if b.num_rows:
            x = _integers(_matrix(b.column(0), length), scale, offset)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([int(np.abs(x).max(initial=0))], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "most", "sums"])


def _one(m: Moments) -> Iterator[pa.RecordBatch]:
    if m.n:
        yield pa.RecordBatch.from_arrays([pa.array([m.n], pa.int64()), pa.array([m.high.tobytes()], pa.binary()), pa.array([m.low.tobytes()], pa.binary())], names=["n", "high", "low"])


def _added(batches, length: int, parts):
    m = Moments(length)
    for b in batches:
        if b.num_rows:
            m.add(*parts(b))
    yield from _one(m)


def _merged(batches, length: int):
    m = Moments(length)
    for b in batches:
        for n, high, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
            m.merge(n, high, low)
    yield from _one(m)


def moments(rows: DataFrame, length: int, parts) -> Moments:
    """The moments of all rows; ``parts`` gives a batch's vectors as (high, low).

    Each task sends one pair of matrices; about the square root of their number of tasks
    merge these, and one merges what is left.
    """
    kind = "n long, high binary, low binary"
    merge = partial(_merged, length=length)
    tasks = rows.rdd.getNumPartitions()
    made = rows.mapInArrow(partial(_added, length=length, parts=parts), kind)
    if tasks > 4:
        made = made.repartition(math.isqrt(tasks)).mapInArrow(merge, kind)
    found = made.repartition(1).mapInArrow(merge, kind).first()
    out = Moments(length)
    if found:
        out.merge(*found)
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are dropped; of the others, each
    entry c, as double, becomes x = floor(scale * c) + offset.  With n such vectors, sums S and
    the covariance V of x (divisor n), components are V's unit eigenvectors, numbered from 1
    by falling eigenvalue e.  deviation (decimal) is the exact sum of (n * x - S)**2; whitened is
    x - S / n projected on the component, over sqrt(e); explained is e / trace(V);
    identity_error is the largest absolute entry of the covariance of all whitened values
    minus the identity.

    There are as many components as dimensions, ``components`` at most.  A component whose
    variance is within rounding of zero (one row, equal rows, fewer rows than dimensions)
    can't be scaled: its whitened is null and it takes no part in identity_error; explained is
    null where the trace is zero.  Vectors may differ in length: shorter ones, empty ones too,
    count as filled with zeros up to the longest.  Rows stand for themselves, so repeated and
    null ids are kept.  Without remaining vectors the result is empty.  Other columns don't
    matter.  Entries whose x is over ``MOST`` are refused with a ValueError.

    ``vectors`` is read three times; only d x d numbers, d the dimensions, meet in a task.
    """
    array = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(array.alias("v"), F.col(f"`{id_col}`").alias("id"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | ~(F.abs(x) < float("inf"))))
    length = rows.agg(F.max(F.size("v"))).first()[0] or 0
    integers = partial(_integers, scale=scale, offset=offset)
    sums = rows.select("v").mapInArrow(partial(_sums, length=length, scale=scale, offset=offset), "n long, most long, sums array<long>")
    each = sums.select("n", "most", F.posexplode_outer("sums"))
    total = {r.pos: (int(r.n), int(r.most), int(r.s or 0)) for r in each.groupBy("pos").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}
    n, most = next(((x[0], x[1]) for x in total.values()), (0, 0))
    if most > MOST:
        raise ValueError(f"an entry becomes {most} or more; {MOST} is the most that is summed exactly")
    s = [total[k][2] for k in range(length)] if n and length else []
    exact = [Fraction(x, n) for x in s]
    mean = np.array([float(x) for x in exact])
    rest = np.array([float(x - Fraction(float(x))) for x in exact])
    wide = max((n * most + abs(x) for x in s), default=0)

    def centred(v):
        high, low = two_sum(integers(v).astype(float), -mean)
        return two_sum(high, low - rest)

    found = moments(rows.select("v"), length, lambda b: centred(_matrix(b.column(0), length)))
    values, axes = eigen(found.covariance()) if n and length else (np.zeros(0), np.zeros((0, 0)))
    trace = float(values.sum())
    k = min(components, length)
    values, axes = values[:k], axes[:, :k]
    usable = values > length * 2.0**-50 * trace
    spread = np.sqrt(np.where(usable, values, 1.0))

    def whitened(batches):
        for b in batches:
            x = _matrix(b.column(1), length)
            high, low = centred(x)
            y = (high @ axes + low @ axes) / spread
            apart = integers(x) if wide < 1 << 62 else integers(x).astype(object)
            apart = apart * n - np.array(s, apart.dtype)
            if wide * wide * max(length, 1) >= 1 << 63:
                apart = apart.astype(object)
            square = pa.array([Decimal(int(t)) for t in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))
            cells = pa.array(y.reshape(-1), pa.float64(), mask=np.tile(~usable, len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), square, pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * k, cells)], names=["id", "deviation", "y"])

    kind = vectors.schema[id_col].dataType.simpleString()
    made = written(rows.select("id", "v").mapInArrow(whitened, f"id {kind}, deviation decimal(38,0), y array<double>"))
    error = None
    if n and usable.any():
        m = int(usable.sum())  # usable ones come first
        c = moments(made.select("y"), m, lambda b: (y := _matrix(b.column(0), k)[:, :m], np.zeros_like(y))).covariance()
        error = float(np.abs(c - np.eye(m)).max())
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values]).cast("array<double>")
    out = made.select("id", "deviation", F.posexplode("y").alias("pos", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("pos")).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
