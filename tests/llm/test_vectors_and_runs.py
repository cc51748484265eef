"""Embedding duplicates, whitening and periodic runs against brute force."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pytest

from thicket.llm.eigen import eigen
from thicket.llm.embedding_dedup import Plan, embedding_dedup, join_labels, spherical_k_means, unit_rows
from thicket.llm.periodic_runs import _collapsed, _word_lists, periodic_runs, repetitions
from thicket.llm.whitening import Moments, add_up, two_product, whiten


def brute_runs(w, repeats, least):
    found = set()
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= repeats * q and n >= least and not any((s, n, p) in found for p in range(1, q)):
                found.add((s, n, q))
    return found


def numbered(w):
    m = {}
    return [m.setdefault(x, len(m)) for x in w]


def test_refinement_finds_all_runs():
    r = random.Random(1)
    for _ in range(1500):
        w = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 60))]
        if r.random() < 0.6:
            a = r.randrange(len(w))
            p = r.randint(1, max(1, (len(w) - a) // 2))
            w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
        repeats, least = r.choice([2, 3]), r.choice([0, 6])
        assert set(repetitions(numbered(w), repeats, least)) == brute_runs(w, repeats, least)
    assert repetitions([]) == [] and repetitions([0]) == []
    assert repetitions([0] * 5000, 3) == [(0, 5000, 1)]


def test_words_of_slices(monkeypatch):
    monkeypatch.setattr("thicket.llm.periodic_runs.SLICE", 7)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("ab \t\n") for _ in range(r.randint(0, 60))).encode()
        assert [w for part in _word_lists(t) for w in part] == t.split()
        n = len(t.split())
        runs = [(s := r.randint(0, n - 1), r.randint(1, n - s), 1) for _ in range(r.randint(0, 3))] if n else []
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert _collapsed(t, runs) == b" ".join(w for i, w in enumerate(t.split()) if i not in gone)


def test_periodic_runs(spark, monkeypatch):
    r = random.Random(3)
    texts = [None, "", " \n ", "one", "a " * 23, "a " * 24, "\x85 " * 30, "x" * 300_000 + " b" * 40]
    for _ in range(60):
        w = ["w%d" % r.randrange(r.choice([3, 40, 500])) for _ in range(r.randint(20, 300))]
        for _ in range(r.randint(0, 3)):
            k, q = r.randint(0, len(w)), r.randint(1, 12)
            w[k:k] = [w[(k + i % q) % len(w)] for i in range(r.randint(10, 60))]
        texts.append(r.choice([" ", "\n", "\t \r"]).join(w))
    texts += texts[-3:]
    monkeypatch.setattr("thicket.llm.periodic_runs.PIECE", 2000)
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, RUNS int, body string")
    got = periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "body", "n_runs", "runs", "strongest", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts)
    some = 0
    for x in rows:
        w = (x.text or "").encode().split()
        runs = sorted((s, n, q) for s, n, q in brute_runs(w, 3, 24))
        assert [tuple(y) for y in x.runs] == runs and x.n_runs == len(runs)
        best = max(runs, key=lambda y: (y[1] / y[2], -y[0], -y[2]), default=None)
        assert (tuple(x.strongest) if x.strongest else None) == best
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert x.collapsed.encode() == b" ".join(y for i, y in enumerate(w) if i not in gone)
        some += len(runs) > 1
    assert some > 5
    assert periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, repeats=2)


@pytest.mark.parametrize("kind", range(7))
def test_eigen(kind):
    r = np.random.default_rng(kind)
    for n in (1, 2, 3, 10, 41):
        x = r.normal(size=(n, n))
        q, _ = np.linalg.qr(x)
        low = x[:, : max(1, n // 4)]
        a = [x @ x.T, np.eye(n) * 3, np.diag(r.integers(0, 3, n).astype(float)), low @ low.T, np.ones((n, n)), np.zeros((n, n)), q @ np.diag(10.0 ** r.uniform(-14, 3, n)) @ q.T][kind]
        a = (a + a.T) / 2
        w, v = eigen(a)
        size = max(np.abs(a).max() * n, 1e-300)
        assert np.abs(a @ v - v * w).max() < 1e-14 * size and np.abs(v.T @ v - np.eye(n)).max() < 1e-13
        assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * size


def test_error_free_sums():
    from fractions import Fraction

    r = np.random.default_rng(0)
    a, b = r.normal(size=50) * 10.0 ** r.integers(-8, 8, 50), r.normal(size=50)
    p, e = two_product(a, b)
    assert all(Fraction(x) * Fraction(y) == Fraction(u) + Fraction(v) for x, y, u, v in zip(a, b, p, e, strict=True))
    high, low = add_up(np.array([1e16, 1.0, -1e16, 1e-9, 3.0])[:, None], np.zeros((5, 1)))
    assert high[0] + low[0] == 4.000000001
    m, other = Moments(2), Moments(2)
    big = np.array([[1e9, 1.0], [1.0, 1e9], [1e9 + 1, -1e9]])
    for x in big:
        other = Moments(2)
        other.add(x[None], np.zeros((1, 2)))
        m.merge(other.n, other.high.tobytes(), other.low.tobytes())
    exact = sum(int(x[0]) ** 2 for x in big)
    assert int(Fraction(m.high[0, 0]) + Fraction(m.low[0, 0])) == exact and m.n == 3


ODD = [None, [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0]]


def test_whiten(spark):
    r = np.random.default_rng(4)
    v = (r.normal(size=(120, 5)) * [3, 1, 1, 0.2, 0.1]).astype(np.float32).tolist()
    v += v[:5] + [v[0][:3], []]
    df = spark.createDataFrame([(i // 2, x, "a") for i, x in enumerate(v + ODD)], "vec_id long, embedding array<float>, N string").repartition(7)
    got = whiten(df, components=3).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.floor(1024 * np.array([y + [0.0] * (5 - len(y)) for y in v])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    w, q = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    w, q = w[::-1], q[:, ::-1]
    y = (x - s / n) @ q[:, :3] / np.sqrt(w[:3])
    assert len(got) == 3 * n and set(got.n) == {n} and got.identity_error.max() < 1e-12
    for k in range(3):
        mine = got[got.component == k + 1]
        assert np.allclose(mine.explained, w[k] / w.sum(), rtol=1e-12)
        assert np.allclose(np.sort(np.abs(mine.whitened)), np.sort(np.abs(y[:, k])), rtol=1e-9, atol=1e-11)
        assert sorted(mine.deviation) == sorted(Decimal(int(d)) for d in ((n * x - s) ** 2).sum(axis=1))


def test_whiten_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, x) for x in ODD], schema)).collect() == []
    one = whiten(spark.createDataFrame([(None, [0.5, 0.25])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None)]
    line = whiten(spark.createDataFrame([(k, [float(k), float(k)]) for k in range(4)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12
    huge = [(k, [float(k << 28), 0.0]) for k in range(4)]
    wide = {r.vec_id: int(r.deviation) for r in whiten(spark.createDataFrame(huge, schema)).collect()}
    total = sum((k << 38) + 100_000 for k in range(4))
    assert wide == {k: (4 * ((k << 38) + 100_000) - total) ** 2 for k in range(4)} and max(wide.values()) > 1 << 63
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1e300])], schema))


def brute_links(ids, v, threshold):
    u = unit_rows(np.array(v))
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    label = np.arange(len(ids))
    join_labels(label, *np.nonzero(hit))
    least = {}
    for k, c in zip(ids, label, strict=True):
        least[c] = min(least.get(c, k), k)
    return [(k, int(d), least[c], k == least[c]) for k, d, c in zip(ids, hit.sum(axis=1), label, strict=True)]


@pytest.mark.parametrize("block,cells", [(8192, 1024), (40, 30), (16, 1)])
def test_embedding_dedup(spark, monkeypatch, block, cells):
    monkeypatch.setattr("thicket.llm.embedding_dedup.CHUNK", 2)
    r = np.random.default_rng(5)
    v = [r.normal(size=(300, 6))]
    for size, noise in ((400, 0.02), (150, 0.13), (40, 0.3), (2, 0.01)):
        v.append(r.normal(size=6) + noise * r.normal(size=(size, 6)))
    v.append(np.repeat(v[1][:1], 120, axis=0))
    v.append(v[1][:5] * 1e-200)
    v = np.concatenate(v)
    ids = r.permutation(len(v)).tolist()
    odd = [(9000 + k, x) for k, x in enumerate([*ODD, [], [0.0] * 6])]
    df = spark.createDataFrame([(k, x.tolist(), "z", 1) for k, x in zip(ids, v, strict=True)] + [(*x, "z", 1) for x in odd], "vec_id long, embedding array<double>, a string, N_LINKS int")
    original = Plan.__init__
    monkeypatch.setattr(Plan, "__init__", lambda self, c, t, _, stats: original(self, c, t, block, stats))
    got = embedding_dedup(df, threshold=0.95, cells=cells, block=block)
    assert got.columns == ["vec_id", "embedding", "a", "n_links", "component_id", "kept"]
    rows = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got.collect())
    assert rows == sorted(brute_links(ids, v, 0.95) + [(k, 0, k, True) for k, _ in odd])


def test_embedding_dedup_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup(spark.createDataFrame([], schema)).collect() == []
    nothing = embedding_dedup(spark.createDataFrame([(1, None), (None, [1.0])], schema)).collect()
    assert sorted((str(x.vec_id), x.n_links, x.component_id, x.kept) for x in nothing) == [("1", 0, 1, True), ("None", 0, None, True)]
    same = embedding_dedup(spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (7, [-1.0, 0.0])], schema)).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in same) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 0, 7)]
    c = spherical_k_means(unit_rows(np.random.default_rng(1).normal(size=(50, 3))), 7)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
