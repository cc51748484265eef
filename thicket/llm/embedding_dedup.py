"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one vector of each group.

Equal vectors are one class.  Classes are assigned to the nearest of ``cells`` centroids,
and within a cell to rings by their angle to the centroid; a cell's ring is a *unit*.  Angles
obey the triangle inequality, so for a vector at angle f to a cell's centroid and a unit whose
angles lie in [r, R], with t the angle of the threshold:

* f + R <= t: the vector is linked with the whole unit.  It counts the unit's weight and
  has one edge to it; nothing is compared.
* f - R > t or r - f > t, or the cell's border plane is further than t: with none of it.
* else it visits the blocks that hold the unit, and cosines are computed there.

Units lie in blocks of a bounded number of rows; a block and a bounded number of visitors are
one group of work.  The bounds lose no pair, so the result is exact whatever the cells are; a
tight group of near copies, however large, is mostly counted without being compared.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import free_name, without_results, written
from thicket.llm.components import components
from thicket.llm.whitening import _matrix

#: Rows of the sample that centroids are fitted on, its bytes, and rounds.
SAMPLE, SAMPLE_BYTES, ROUNDS = 16_384, 64 << 20, 8
#: Rows and units of a block at most, blocks whose rows visit in one group, rows compared at once.
BLOCK, BLOCK_UNITS, CHUNK, STEP = 8192, 512, 8, 256
#: Rings in the threshold's angle; what angles may be off by rounding.
RINGS, SLACK = 8, 1e-6


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit rows, neighbours next to each other; empty cells stay where they were."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        have, first = np.unique(home[order], return_index=True)
        total = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1)
        c[have[norm > 1e-9]] = (total / np.maximum(norm, 1e-9)[:, None])[norm > 1e-9]
    near, chain, left = c @ c.T, [0], np.ones(k, bool)
    for _ in range(k - 1):
        left[chain[-1]] = False
        chain.append(int(np.where(left, near[chain[-1]], -2).argmax()))
    return c[chain]


class Plan:
    """Where units lie, and how a vector stands to each of them."""

    def __init__(self, centroids: np.ndarray, threshold: float, block: int, stats: list[tuple]):
        self.c, self.angle, self.ring = centroids, math.acos(threshold), math.acos(threshold) / RINGS
        self.apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
        code, n, weight, low, high, rep = (np.array(x) for x in zip(*sorted(stats), strict=True))
        self.code, self.weight, self.low, self.high, self.rep = code.astype(np.int64), weight.astype(np.int64), low.astype(float), high.astype(float), rep.astype(np.int64)
        self.rings = 1 + int(math.pi / self.ring)
        cell = self.code // self.rings
        self.first_unit = np.searchsorted(cell, np.arange(len(centroids) + 1))
        have = np.flatnonzero(np.diff(self.first_unit))
        self.cell_low, self.cell_high = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
        self.cell_low[have], self.cell_high[have] = np.minimum.reduceat(self.low, self.first_unit[have]), np.maximum.reduceat(self.high, self.first_unit[have])
        self.splits = np.maximum(1, -(-n.astype(np.int64) // block))
        self.block, self.place = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        at, rows, units = -1, block, 0
        for u in range(len(n)):
            if self.splits[u] > 1 or rows + n[u] > block or units == BLOCK_UNITS:
                at, rows, units = at + 1, 0, 0
            self.block[u], self.place[u] = at, units
            rows, units = rows + int(n[u]), units + 1
            if self.splits[u] > 1:
                at, rows = at + int(self.splits[u]) - 1, block
        self.blocks, self.mask_bytes = at + 1, int(self.place.max()) // 8 + 1

    def unit_of(self, cell: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.code, cell * self.rings + (r / self.ring).astype(np.int64))

    def home_block(self, unit: np.ndarray, key: np.ndarray) -> np.ndarray:
        return self.block[unit] + (key.view(np.uint64) >> np.uint64(20)).astype(np.int64) % self.splits[unit]

    def stand(self, x: np.ndarray, home: np.ndarray, unit: np.ndarray):
        """((row, unit) of units linked with as a whole, (row, block, mask) of blocks to visit), each pair of units from one side."""
        cos = x @ self.c.T
        angle = np.arccos(np.clip(cos, -1, 1))
        most = self.angle + SLACK
        reach = (angle - self.cell_high <= most) & (self.cell_low - angle <= most)
        reach &= cos[np.arange(len(x)), home][:, None] - cos <= (math.sin(self.angle) + SLACK) * self.apart[home] + SLACK
        row, cell = np.nonzero(reach)
        size = self.first_unit[cell + 1] - self.first_unit[cell]
        u = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first_unit[cell], size)
        row, f = np.repeat(row, size), np.repeat(angle[row, cell], size)
        own = unit[row] == u
        mine = own | ((unit[row] < u) == ((unit[row] + u) % 2 == 0))
        near = mine & (own | ((f - self.high[u] <= most) & (self.low[u] - f <= most)))
        row, u, f, own = row[near], u[near], f[near], own[near]
        whole = np.where(own, self.high[u], f) + self.high[u] <= self.angle - SLACK
        some_row, some = row[~whole], u[~whole]
        k = self.splits[some]
        block = np.repeat(self.block[some], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        place, some_row = np.repeat(self.place[some], k), np.repeat(some_row, k)
        key, at = np.unique(some_row * self.blocks + block, return_inverse=True)
        mask = np.zeros((len(key), self.mask_bytes), np.uint8)
        np.bitwise_or.at(mask, (at.reshape(-1), place >> 3), (1 << (place & 7)).astype(np.uint8))
        return (row[whole], u[whole]), (key // self.blocks, key % self.blocks, mask)


def _bytes(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _rows(column, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), kind) for x in column]).astype(float) if len(column) else np.zeros((0, 1))


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))


_PLACED = "a long, b long, id long, k long, cell long, r double, v binary"
_MET = "a long, b long, id long, k long, v binary, unit long, block long, chunk long, mask binary, links long, other long"


def _placed(batches, centroids: np.ndarray, length: int, kind: str):
    for b in batches:
        if b.num_rows:
            v = _matrix(b.column(4), length)
            cos = unit_rows(v) @ centroids.T
            home = cos.argmax(axis=1)
            r = np.arccos(np.clip(cos[np.arange(len(v)), home], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _long(home), pa.array(r), _bytes(v.astype(kind))], names=["a", "b", "id", "k", "cell", "r", "v"])


def _met(batches, plan: Plan, kind: str):
    step = max(16, (2 << 20) // max(len(plan.code), 1))
    for whole_batch in batches:
        for k in range(0, whole_batch.num_rows, step):
            batch = whole_batch.slice(k, step)
            a, b, ids, weight, cell, r = (batch.column(i).to_numpy() for i in range(6))
            unit = plan.unit_of(cell, r)
            (row, u), (v_row, block, mask) = plan.stand(unit_rows(_rows(batch.column(6), kind)), cell, unit)
            from_block = plan.home_block(unit, a)
            n = len(v_row)
            yield _met_batch([_long(a[v_row]), _long(b[v_row]), _long(ids[v_row]), _long(weight[v_row]), batch.column(6).take(_long(v_row)), _long(unit[v_row]), _long(block), _long(from_block[v_row] // CHUNK), _bytes(mask), None, None], n)
            linked = plan.weight[u] - np.where(unit[row] == u, weight[row], 0)
            some = linked > 0
            row, u, linked = row[some], u[some], linked[some]
            yield _met_batch([_long(a[row]), _long(b[row]), _long(ids[row]), None, None, None, None, None, None, _long(linked), _long(plan.rep[u])], len(row))
            others = unit[row] != u
            have, at = np.unique(u[others], return_inverse=True)
            total = np.zeros(len(have), np.int64)
            np.add.at(total, at.reshape(-1), weight[row[others]])
            yield _met_batch([None, None, None, None, None, _long(have), None, None, None, _long(total), _long(plan.rep[have])], len(have))


def _met_batch(columns: list, n: int) -> pa.RecordBatch:
    kinds = [x.strip().split(" ") for x in _MET.split(",")]
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.nulls(n, types[t]) if c is None else c for c, (_, t) in zip(columns, kinds, strict=True)], names=[name for name, _ in kinds])


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes each node's label the smallest node reachable, over edges a - b too."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _compared(key, homes: pa.Table, visits: pa.Table, plan: Plan, kind: str, threshold: float) -> pa.Table:
    """Links of a block's rows with its visitors: (a, b, id, links, other), other the smallest id of the row's links here."""
    block, n, m = key[0].as_py(), homes.num_rows, visits.num_rows
    both = [np.concatenate([t.column(c).to_numpy() for t in (homes, visits)]) for c in ("a", "b", "id", "k", "unit")]
    order = np.argsort(both[2], kind="stable")  # nodes by id, so that a label is a smallest id
    node = np.empty(n + m, np.int64)
    node[order] = np.arange(n + m)
    label, links = np.arange(n + m), np.zeros(n + m, np.int64)
    if n and m:
        a, b, _, weight, unit = both
        x, y = unit_rows(_rows(homes.column("v"), kind)), unit_rows(_rows(visits.column("v"), kind))
        place = plan.place[unit[:n]]
        mask = np.unpackbits(_rows(visits.column("mask"), "u1").astype(np.uint8), axis=1, bitorder="little").astype(bool)
        by_unit = np.argsort(unit[n:], kind="stable")
        for k in range(0, m, STEP):
            some = by_unit[k : k + STEP]
            asked = mask[some]
            rows = np.flatnonzero(asked.any(axis=0)[place])
            hit = (x[rows] @ y[some].T >= threshold) & asked[:, place[rows]].T
            i, j = np.nonzero(hit)
            i, j = rows[i], some[j] + n
            same = unit[i] == unit[j]  # within a unit, from the smaller key alone
            ok = ~same | (a[j] < a[i]) | ((a[j] == a[i]) & (b[j] < b[i]))
            i, j = i[ok], j[ok]
            links += np.bincount(i, weight[j], n + m).astype(np.int64) + np.bincount(j, weight[i], n + m).astype(np.int64)
            join_labels(label, node[i], node[j])
    have = np.flatnonzero(links)
    return pa.table({"a": _long(both[0][have]), "b": _long(both[1][have]), "id": _long(both[2][have]), "links": _long(links[have]), "other": _long(both[2][order][label[node[have]]])})


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, cells: int = 1024, block: int = BLOCK) -> DataFrame:
    """One row per vector: its columns, then n_links, component_id, kept.

    Vectors are linked when their cosine, in double precision, is at least ``threshold``.
    n_links is the number of other rows linked directly, component_id the smallest id
    reachable by links (its own included), kept says that the id is component_id.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with
    nothing and kept.  A row with a null id takes no part: no links, a null component, kept.
    Rows that repeat an id are one node of the graph, with each row's own links.  Shorter
    vectors count as filled with zeros.  Columns that bear a result's name, in any case, are
    replaced; an empty table gives an empty result.

    Centroids are fitted on a sample of about ``SAMPLE`` classes and at most ``SAMPLE_BYTES``,
    those of the smallest hashes; there are as many as the square root of the classes,
    ``cells`` and an eighth of the sample at most.  They decide what is compared where,
    never what is linked: every pair is linked, or refuted by a bound or by its cosine.
    Equal vectors are told by 128 bits of hash.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    vectors = without_results(vectors, ("n_links", "component_id", "kept"), id_col, vector_col)
    a, b, key_a, key_b = free_name(vectors, "a", "b", "key_a", "key_b")
    array, doc_id = F.col(f"`{vector_col}`").cast("array<double>"), F.col(f"`{id_col}`").cast("long")
    odd = F.exists(array, lambda x: x.isNull() | ~(F.abs(x) < float("inf")))
    takes_part = doc_id.isNotNull() & array.isNotNull() & ~odd & F.exists(array, lambda x: x != 0)
    hashed = vectors.withColumn(a, F.when(takes_part, F.xxhash64(array))).withColumn(b, F.when(takes_part, F.xxhash64(F.lit(1), array)))
    rows = hashed.filter(F.col(a).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), doc_id.alias("id"), F.col(f"`{vector_col}`").alias("v"))
    classes = written(rows.groupBy("a", "b").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k"), F.first("v").alias("v")))
    n, length = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    names = [F.col(f"`{c}`") for c in vectors.columns]
    if not n:
        return vectors.select(*names, F.lit(0).cast("long").alias("n_links"), doc_id.alias("component_id"), F.lit(True).alias("kept"))
    kind = "<f4" if "array<float>" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * length)) / n)
    sample = classes.filter(F.pmod("a", F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("a", "b", "v").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = classes.select("a", "b", "v").limit(1).toArrow()
    sample = sample.sort_by([("a", "ascending"), ("b", "ascending")]).column("v").combine_chunks()
    x = unit_rows(_matrix(sample, length))
    centroids = spherical_k_means(x, max(1, min(cells, math.isqrt(n), len(x) // 8)))
    placed = written(classes.mapInArrow(partial(_placed, centroids=centroids, length=length, kind=kind), _PLACED))
    ring = math.acos(threshold) / RINGS
    code = F.col("cell") * (1 + int(math.pi / ring)) + F.floor(F.col("r") / ring)
    stats = placed.groupBy(code.alias("code")).agg(F.count(F.lit(1)), F.sum("k"), F.min("r"), F.max("r"), F.min("id")).collect()
    plan = Plan(centroids, threshold, min(block, max(512, n // 8)), [tuple(s) for s in stats])
    met = written(placed.mapInArrow(partial(_met, plan=plan, kind=kind), _MET))

    def homes_of(batches):
        for t in batches:
            if t.num_rows:
                unit = plan.unit_of(t.column(4).to_numpy(), t.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*t.columns[:4], t.column(6), _long(unit), _long(plan.home_block(unit, t.column(0).to_numpy())), _long(plan.rep[unit])], names=["a", "b", "id", "k", "v", "unit", "block", "rep"])

    homes = placed.mapInArrow(homes_of, "a long, b long, id long, k long, v binary, unit long, block long, rep long")
    wanted = met.filter("block is not null").select(F.col("block").alias("at"), F.col("chunk").alias("by")).distinct()
    met_by = homes.join(wanted, F.col("block") == F.col("at")).select("at", "by", "a", "b", "id", "k", "unit", "v")
    visits = met.filter("block is not null").select("block", "chunk", "a", "b", "id", "k", "unit", "v", "mask")

    def compared(key, left, right):
        return _compared(key, left, right, plan, kind, threshold)

    found = written(met_by.groupBy("at", "by").cogroup(visits.groupBy("block", "chunk")).applyInArrow(compared, "a long, b long, id long, links long, other long"))
    by_row = met.filter("block is null and a is not null").select("a", "b", "id", "links", "other")
    by_unit = met.filter("a is null").groupBy("unit").agg(F.sum("links").alias("links"))
    by_unit = homes.select("a", "b", "id", "unit", "rep").join(by_unit, "unit").select("a", "b", "id", "links", F.col("rep").alias("other"))
    every = found.union(by_row).union(by_unit)
    reached = components(every.select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("a", "b", "id", "k").join(every.groupBy("a", "b").agg(F.sum("links").alias("links")), ["a", "b"], "left").join(reached, F.col("id") == F.col("node"), "left")
    of_class = of_class.select(F.col("a").alias(key_a), F.col("b").alias(key_b), (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = hashed.join(of_class, (F.col(a) == F.col(key_a)) & (F.col(b) == F.col(key_b)), "left")
    component = F.coalesce("component_id", doc_id)
    return out.select(*names, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"))
