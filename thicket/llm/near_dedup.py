"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import free_name, without_results, written
from thicket.llm.components import components
from thicket.llm.sketch import band_keys, sketches
from thicket.llm.text import mix, utf8, window_owner, windows, words

#: Classes of a bucket, and bytes of their profiles in the mean, that are compared in one go.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Rows, and bytes of profiles in the mean, of one group of comparisons.
PART_ROWS, PART_BYTES = 4_000, 16 << 20
#: Tasks over which the partners of one class are dealt.
SALTS = 16
#: Most classes (8 bytes each) that are broadcast; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a bucket that are held against the others at once; the bytes of one comparison.
CHUNK, STEP_BYTES = 64, 16 << 20
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, and n + 1 offsets.

    A text of fewer words is one shingle, all its words; one without words has none.
    """
    raw, at = utf8(column)
    (h,), first = words(raw, at, lower=True)
    start, owner = window_owner(first, size)
    values = windows(h, size)[start] if len(start) else np.zeros(0, np.uint64)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    if len(few):
        whole = []
        for i in few:
            x = np.array([0x1234567], np.uint64)
            for w in h[first[i] : first[i + 1]]:
                x = mix(x * np.uint64(0xD1342543DE82EF95) + w)
            whole.append(x[0])
        values, owner = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([owner, few])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(first)))


def _pieces(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Runs of rows of about ``limit`` bytes of text."""
    sizes = np.diff(utf8(batch.column(text))[1])
    run = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]).cast(pa.binary())


def _sketched(batches, size: int, t: int, bands: int):
    for batch in batches:
        for b in _pieces(batch, "text"):
            values, first = shingle_sets(b.column("text"), size)
            n = np.diff(first)
            s = sketches(values, first, t)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ k), dtype=np.uint64)]) for k in (_SALT, ~_SALT)]
            prints = np.stack([x[first[1:]] - x[first[:-1]] for x in sums], axis=1)
            keys = band_keys(s, bands)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(n), _binary(prints), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64)))],
                names=["id", "th", "n", "print", "keys"],
            )


def profile(values: np.ndarray) -> bytes:
    """How many of a set's elements fall into each of 2**k bins, at least half as many bins as elements.

    The sum of the smaller counts of two sets is never less than their intersection, so it
    refutes pairs without loss.  A count over 255 makes the profile empty: it refutes nothing.
    """
    bins = 1 << max(7, (len(values) >> 1).bit_length())
    counts = np.bincount((values & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """Counts (rows, bins') in fewer bins: an element's bin is its value's low bits."""
    if counts.shape[1] == bins:
        return counts
    return counts.reshape(len(counts), -1, bins).sum(axis=1, dtype=np.uint16)


def _may_link(common, n, m, percent: int):
    """Whether sets of n and m elements that share ``common`` at most can be linked."""
    common = np.minimum(common, np.minimum(n, m))
    return 100 * common >= percent * (n + m - common)


def _by_bins(profiles) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of counts) for each number of bins; empty profiles have a matrix without columns."""
    size = np.array([len(x) for x in profiles], np.int64)
    out = []
    for bins in np.unique(size):
        rows = np.flatnonzero(size == bins)
        out.append((rows, np.frombuffer(b"".join(profiles[i] for i in rows), np.uint8).reshape(len(rows), bins)))
    return out


def _common(some: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The largest possible intersections of two lists of profiles, or a number no set exceeds."""
    bins = min(some.shape[1], every.shape[1])
    if not bins:
        return np.full((len(some), len(every)), np.iinfo(np.int64).max >> 8)
    some, every = _folded(some, bins), _folded(every, bins)
    out, step = np.empty((len(some), len(every)), np.int64), max(1, STEP_BYTES // (2 * bins * len(some)))
    for k in range(0, len(every), step):
        out[:, k : k + step] = np.minimum(some[:, None], every[None, k : k + step]).sum(axis=2, dtype=np.int64)
    return out


def _unrefuted(ids, n, label, rest, profiles, percent: int):
    """Pairs of a row of ``rest`` and another that differ in label and that the profiles can't refute.

    Rows of ``rest`` are taken ``CHUNK`` at a time, alike ones together; what even their
    largest counts refute is refuted for all of them.
    """
    found = []
    others = np.flatnonzero(~rest)
    groups = [(others[rows], counts) for rows, counts in _by_bins([profiles[i] for i in others])]
    mine = np.flatnonzero(rest)
    for rows, counts in _by_bins([profiles[i] for i in mine]):
        order = np.lexsort((n[mine[rows]], label[mine[rows]]))
        for k in range(0, len(order), CHUNK):
            take = order[k : k + CHUNK]
            some, here = counts[take], mine[rows[take]]
            low, high = n[here].min(), n[here].max()
            for theirs, matrix in groups:
                near = np.flatnonzero((100 * n[theirs] >= percent * low) & (100 * high >= percent * n[theirs]))
                if len(near) and len(here) > 1:
                    m = n[theirs[near]]
                    most = np.minimum(_common(some.max(axis=0, keepdims=True), matrix[near])[0], np.minimum(high, m))
                    near = near[(100 + percent) * most >= percent * (low + m)]
                if not len(near):
                    continue
                there = theirs[near]
                ok = _may_link(_common(some, matrix[near]), n[here][:, None], n[there][None, :], percent)
                ok &= (label[here][:, None] != label[there][None, :]) & (ids[here][:, None] != ids[there][None, :])
                i, j = np.nonzero(ok)
                found.append((np.minimum(ids[here[i]], ids[there[j]]), np.maximum(ids[here[i]], ids[there[j]])))
    return found


def _groups(*keys: np.ndarray):
    """Row numbers of each group of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return np.split(order, np.flatnonzero(new)) if len(order) else []


def _compared(table: pa.Table, percent: int) -> pa.Table:
    """The distinct pairs (a, b) that meet in one bucket, p and q and that profiles can't refute."""
    ids, n, label, rest = (table[c].to_numpy() for c in ("id", "n", "label", "rest"))
    raw, found = table["profile"], []
    for rows in _groups(*(table[c].to_numpy() for c in ("key", "p", "q"))):
        found += _unrefuted(ids[rows], n[rows], label[rows], rest[rows], [raw[int(i)].as_buffer().to_pybytes() for i in rows], percent)
    pairs = np.unique(np.concatenate([np.stack(x, axis=1) for x in found]), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _sets(batches, size: int):
    for batch in batches:
        for b in _pieces(batch, "text"):
            values, first = shingle_sets(b.column("text"), size)
            sets = [values[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(first)), pa.array([profile(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "n", "profile", "set"])


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs(a, b) with the columns of a as x_.. and those of b as y_..; the partners of one a are dealt under SALTS."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    one = table.select(F.col("id").alias("x"), *[F.col(c).alias(f"x_{c}") for c in columns])
    two = table.select(F.col("id").alias("y"), *[F.col(c).alias(f"y_{c}") for c in columns])
    left = salted.select("a", "salt").distinct().join(one, F.col("a") == F.col("x")).drop("x")
    return salted.join(two, F.col("b") == F.col("y")).drop("y").join(left, ["a", "salt"])


def _filtered(batches, keep):
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep(part), pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are linked; most others are refuted by their profiles before any set is sent."""

    def open_(b):
        n, m = b.column("x_n").to_numpy(), b.column("y_n").to_numpy()
        one, two = ([x.as_buffer().to_pybytes() for x in b.column(c)] for c in ("x_profile", "y_profile"))
        sized = (100 * n >= percent * m) & (100 * m >= percent * n)
        return [bool(ok) and bool(_may_link(_common(*(np.frombuffer(z, np.uint8).reshape(1, -1) for z in (x, y)))[0, 0], i, j, percent)) for ok, x, y, i, j in zip(sized, one, two, n, m, strict=True)]

    def linked(b):
        out = []
        for x, y in zip(b.column("x_set"), b.column("y_set"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return out

    ends = "a long, b long"
    likely = _both(pairs, sets, "n", "profile").select("a", "b", "x_n", "y_n", "x_profile", "y_profile").mapInArrow(partial(_filtered, keep=open_), ends).distinct()
    return _both(likely, sets, "set").select("a", "b", "x_set", "y_set").mapInArrow(partial(_filtered, keep=linked), ends)


def _blocks(count: Column, size: Column) -> Column:
    """Into how many blocks ``count`` classes with ``size`` elements together are dealt."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _meetings(slots: DataFrame, label_of: DataFrame) -> DataFrame:
    """(key, p, q, id, n, label, rest): what is left to compare in each bucket, given components of confirmed links.

    In a bucket whose members have several labels, those of other labels than the most
    frequent one (rest) meet all members, block by block.  A bucket's smallest id is left
    out: it has been held against every member before.
    """
    named = slots.filter("id > least").select("id", "key", "n").join(label_of.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("id", "key", "n", F.coalesce("component", "id").alias("label"))
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    top = F.max(F.struct("k", "label", "size"))
    mixed = per.groupBy("key").agg(top.alias("top"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    mixed = mixed.select("key", F.col("top.label").alias("main"), _blocks(F.col("k"), F.col("size")).alias("nblk"), _blocks(F.col("k") - F.col("top.k"), F.col("size") - F.col("top.size")).alias("nrest"))
    rows = named.join(mixed, "key")
    block, part = F.pmod(F.xxhash64("id"), F.col("nblk")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("nrest")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("key", block.alias("p"), every("nrest").alias("q"), "id", "n", "label", F.lit(False).alias("rest"))
    rest = rows.filter("label <> main").select("key", every("nblk").alias("p"), part.alias("q"), "id", "n", "label", F.lit(True).alias("rest"))
    return members.union(rest)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, t: int = 128, bands: int = 32) -> DataFrame:
    """One row per document: docs' columns, then n_shingles, component_id, kept.

    A document's set is its distinct shingles of ``shingle`` words (words are split at
    ``[\\x20\\x09-\\x0D]``, A-Z lower-cased); with fewer words, the whole sequence as one;
    null, empty and blank texts have the empty set and are linked with nothing.  Documents
    are linked when 100 * intersection >= percent * union, counted on the full sets.
    component_id is the smallest id reachable over links, the document's own included; kept
    is doc_id = component_id.  Ids must be integers; rows that repeat an id are one node of
    the graph, which each row's own set may link to others; a row with a null id takes no
    part: its component is null and it is kept.  An empty table gives
    an empty result; columns of docs that bear a result's name, in any case, are replaced.

    1. Every text gets a fast similarity sketch of ``t`` coordinates, ``bands`` band keys and
       a 128-bit print of its set; rows of equal sets are one class, seen by its smallest id.
       Classes that share a band key meet in a bucket, whatever its size.
    2. In each bucket, every class is held against the smallest id: at most ``bands`` pairs a
       class.  Profiles (``profile``) refute pairs without loss, what they leave is
       confirmed on the full sets, and the links give components.
    3. In buckets where several components meet, pairs across them are compared by their
       profiles, block by block, and what is left is confirmed on the full sets as well.
       Pairs inside a component can't change the result and are never formed.

    So every pair that shares a band is linked, refuted by a bound that holds for all sets,
    or inside a component of confirmed links: no link of such a pair is lost.  A pair of
    similarity J shares no band with probability (1 - J**(t/bands))**bands, 5e-8 at J = 0.8
    with the defaults.  A group of copies costs one comparison a bucket and member; only
    classes of one bucket that are *not* linked are compared with each other, by profiles.
    """
    docs = without_results(docs, ("n_shingles", "component_id", "kept"), id_col, text_col)
    th, key_id, key_th = free_name(docs, "text_hash", "key_id", "key_hash")
    docs = docs.withColumn(th, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{th}`").alias("th"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketched = written(plain.mapInArrow(partial(_sketched, size=shingle, t=t, bands=bands), "id long, th long, n long, print binary, keys array<bigint>"))
    # Rows of one class have equal sketches, so any row's will do.
    classes = sketched.filter("id is not null and n > 0").groupBy("print", "n").agg(F.min(F.struct("id", "th")).alias("of"), F.first("keys").alias("keys"))
    classes = written(classes.select("print", "n", "of.id", "of.th", "keys"))
    keyed = classes.select("id", "th", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).filter("size > 1")
    slots = written(keyed.join(shared, "key").select("id", "th", "n", "key", "least"))

    # One long tells the rows that are needed; two that it doesn't tell apart only mean a set more.
    pick = F.xxhash64("id", "th").alias("pick")
    chosen = slots.select(pick).distinct()
    n_chosen = chosen.count()
    if n_chosen <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    sets = written(plain.filter("id is not null").select("*", pick).join(chosen, "pick", "left_semi").select("id", "text").mapInArrow(partial(_sets, size=shingle), "id long, n long, profile binary, set binary"))
    if sets.count() > n_chosen:  # rows that repeat an id and a text: one of them will do
        sets = written(sets.dropDuplicates(["id", "n", "set"]))
    star = slots.filter("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_linked(star, sets, percent))
    found = components(links)
    meetings = written(_meetings(slots, found))
    n_rows, size = meetings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_rows:
        parts = max(1, n_rows // PART_ROWS, size // PART_BYTES)

        def compared(table):
            return _compared(table, percent)

        dealt = meetings.join(sets.select("id", F.col("n").alias("set_n"), "profile"), "id").filter("n = set_n").withColumn("part", F.pmod(F.xxhash64("key", "p", "q"), F.lit(parts)))
        more = dealt.select("part", "key", "p", "q", "id", "n", "label", "rest", "profile").groupBy("part").applyInArrow(compared, "a long, b long").distinct()
        found = components(links.union(_linked(written(more), sets, percent)))

    of_class = classes.select("print", "n", "id").join(found, F.col("id") == F.col("node"), "left")
    of_class = of_class.select(F.col("print").alias("p2"), F.col("n").alias("n2"), F.coalesce("component", "id").alias("component"))
    rows = sketched.select("id", "th", "n", "print").dropDuplicates(["id", "th"])
    rows = rows.join(of_class, (F.col("print") == F.col("p2")) & (F.col("n") == F.col("n2")), "left")
    rows = rows.select(F.col("id").alias(key_id), F.col("th").alias(key_th), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    doc_id = F.col(f"`{id_col}`").cast("long")
    out = docs.join(rows, doc_id.eqNullSafe(F.col(key_id)) & F.col(f"`{th}`").eqNullSafe(F.col(key_th)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns if c != th]
    return out.select(*names, "n_shingles", "component_id", doc_id.eqNullSafe(F.col("component_id")).alias("kept"))
