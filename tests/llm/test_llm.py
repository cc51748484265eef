"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from thicket.llm.components import components
from thicket.llm.exact_dedup import exact_dedup
from thicket.llm.licenses import scan_licenses
from thicket.llm.near_dedup import near_dedup
from thicket.llm.packing import cut, pack, sum_of_squares
from thicket.llm.quality import Network, classify, symbols
from thicket.llm.queries import tokenizer_file
from thicket.llm.sketch import EMPTY, sketches
from thicket.llm.substring_dedup import pack as pack_cells
from thicket.llm.substring_dedup import Cells, join_kept, substring_dedup, unpack
from thicket.llm.token_counts import MARK, UnigramTrie, file_scores, token_counts
from thicket.llm.topk import SlicedBlock, exact_top_k, signed_digits
from thicket.llm.warc import Gap, Record, make_record, read_archives, round_trip, salvage, sha1_base32
from thicket.llm.word_bpe import encode_decode

SCHEMA = "doc_id long, text string, bundle_key string, key int, part int, id int, h128 int, KEPT int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=3):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "ß", "漢", "A", "a", "\x85x", "\xa0"]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 90))] for _ in range(6)]
    out = [None, "", " \n\t", "one", "one", "One", "two words", "two  words", "three little words", "long " * 3000 + "end", None]
    for b in base:
        out.append(" ".join(b))
        out += [" ".join(b)] * r.randint(0, 3)
        for _ in range(5):
            c = list(b)
            for _ in range(r.randint(1, 4)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            out.append("\n".join(c))
        a, z = sorted(r.sample(range(len(b)), 2))
        out.append(" ".join(r.choices(vocabulary, k=20) + b[a:z] + r.choices(vocabulary, k=20)))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "x", 1, 2, 3, 4, 5) for i, t in enumerate(texts())]
    random.Random(1).shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    assert len(got) == len(rows)
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        g = got[i]
        assert (g.keep_id, g.group_size, g.kept, g.text_sha256) == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (4, "b"), (4, "b"), (4, "c")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect())
    assert got == sorted([(True, "a", None, 2, True)] * 2 + [(True, "b", 4, 3, False)] + [(False, "b", 4, 3, True)] * 2 + [(False, "c", 4, 1, True)])


def brute_near(pairs, shingle, percent):
    sets = {}
    for i, t in pairs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_dedup(docs, rows, block, monkeypatch):
    from thicket.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK", block)  # small blocks: buckets are dealt and their blocks meet
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, shingle=4).collect()}
    assert got == brute_near([(i, t) for i, t, *_ in rows], 4, 80)


def adverse(kind):
    """Texts whose buckets hold several components, none of them by far the largest."""
    r = random.Random(4)
    if kind == "template":  # one template, linked below 0.8, but for a few pairs
        template = [f"t{i}" for i in range(60)]
        out = [" ".join(w if r.random() < 0.95 else f"x{r.random()}" for w in template) for _ in range(160)]
        return out + [t + " end" for t in out[:9]]
    if kind == "chain":  # each text is linked with the next one alone
        w = [f"c{i}" for i in range(700)]
        return [" ".join(w[k : k + 60]) for k in range(0, 640, 6)] + [" ".join(w[k : k + 60]) for k in range(0, 640, 9)]
    # Families of copies around bases that share half their words: tight components in common buckets.
    base = [f"b{i}" for i in range(40)]
    out = []
    for f in range(8):
        own = base + [f"f{f}-{i}" for i in range(12)]
        out += [" ".join(own + [f"y{r.random()}"] * (k % 3)) for k in range(20)]
    return out


@pytest.mark.parametrize("kind", ["template", "chain", "families"])
def test_near_dedup_loses_no_link_and_groups_are_bounded(spark, kind, monkeypatch):
    from thicket.llm import near_dedup as module

    pairs = list(enumerate(adverse(kind)))
    random.Random(7).shuffle(pairs)
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "PART_ROWS", 40)
    seen, meetings = [], module._meetings

    def watched(*args):
        out = meetings(*args)
        seen.extend(r.n for r in out.groupBy("key", "p", "q").agg(F.count(F.lit(1)).alias("n")).collect())
        return out

    monkeypatch.setattr(module, "_meetings", watched)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup(df, shingle=4).collect()}
    assert got == brute_near(pairs, 4, 80)
    assert kind == "chain" or (seen and max(seen) <= 60), seen


def test_profiles_refute_without_loss():
    from thicket.llm.near_dedup import _common, _may_link, _unrefuted, profile

    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(r.choice(pool[: r.integers(20, 4000)], r.integers(1, 900))) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[3:], r.choice(pool, 2)])) for s in sets[:20]] + [np.arange(400, dtype=np.uint64) << np.uint64(20)]
    profiles = [profile(s) for s in sets]
    assert profiles[-1] == b"" and all(len(p) >= len(s) / 2 for p, s in zip(profiles[:-1], sets, strict=False))
    n = np.array([len(s) for s in sets])
    linked = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            bound = _common(*(np.frombuffer(profiles[k], np.uint8).reshape(1, -1) for k in (i, j)))[0, 0]
            assert both <= bound
            if 100 * both >= 80 * (n[i] + n[j] - both):
                linked.add((j, i))
                assert _may_link(bound, n[i], n[j], 80)
    ids, rest = np.arange(len(sets)), np.arange(len(sets)) < 50
    both = [np.concatenate([x, x[rest]]) for x in (ids, n, ids)]
    found = _unrefuted(*both, np.concatenate([np.zeros(len(sets), bool), np.ones(50, bool)]), profiles + profiles[:50], 80)
    got = {(a, b) for x, y in found for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert linked and {p for p in linked if p[0] < 50 or p[1] < 50} <= got and len(got) < 400


def test_near_dedup_null_ids_repeats_and_empty(spark, empty):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "A B C D E"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.n_shingles, r.kept) for r in near_dedup(df).collect())
    assert got == [(-1, None, 1, True), (3, 3, 1, True), (7, 3, 1, False), (7, 3, 1, False), (9, 9, 0, True)]
    assert near_dedup(empty).count() == 0


def test_words_are_hashed_alike_in_slices(monkeypatch):
    from thicket.llm import text as module

    r = random.Random(12)
    texts_ = [None, "", "a" * 300, "  "] + ["".join(r.choices("abC é\n", weights=[9, 9, 9, 2, 3, 1], k=r.randint(1, 400))) for _ in range(40)] + ["x" * 70 + " " + "Y" * 90, "z" * 64]
    raw, at = module.utf8(pa.array(texts_))
    want, first = module.words(raw, at, (1, 2), lower=True)
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts_]
    distinct = {w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for t in texts_ for w in WORD.findall(t or "")}
    assert len(np.unique(want[0])) == len(distinct)
    for size in (7, 64, 100):
        monkeypatch.setattr(module, "SLICE", size)
        got, again = module.words(raw, at, (1, 2), lower=True)
        assert all((x == y).all() for x, y in zip(got, want, strict=True)) and (again == first).all()


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [a[:1], a[:900], a[100:], a[:0]]
    s = sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 128)
    assert (s[:3] != EMPTY).all() and (s[3] == EMPTY).all()
    assert abs((s[1] == s[2]).mean() - 0.8) < 0.15


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 6), (None, 4), (2, 1)] + [(100, 100 + i) for i in range(40)] + [(139, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + i: 5 for i in range(40)}


def brute_substring(pairs, window):
    words = [(i, WORD.findall(t or "")) for i, t in pairs]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = {}
    for i, w in words:
        gone = {q for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for q in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    return out


@pytest.mark.parametrize("size", [{}, {"bundle": 700, "blocks": 4}, {"bundle": 300, "cells": 4}])
def test_substring_dedup(docs, rows, size, monkeypatch):
    from thicket.llm import substring_dedup as module

    size = dict(size)
    monkeypatch.setattr(module, "CELLS", size.pop("cells", module.CELLS))  # few cells a block: blocks grow in number
    monkeypatch.setattr(module, "MOST_BUNDLE", 700)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, window=13, **size).collect()}
    assert got == brute_substring([(i, t) for i, t, *_ in rows], 13)


def test_substring_null_ids_repeats_and_empty(spark, empty):
    t = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, t), (5, t), (5, t + " x"), (8, t)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup(df).collect()) == [(-1, 20), (5, 0), (5, 0), (8, 20)]
    assert substring_dedup(empty).count() == 0


def test_packed_cells():
    for cells in ([], [0], [0, 0, 65534, 65535, 65536, 400000, 400000], [5, 6, 6, 70000], [1 << 24, (1 << 26) - 1, (1 << 26) - 1]):
        assert unpack(pack_cells(np.array(cells, np.int64))).tolist() == cells


def test_cells_count_like_a_counter():
    from collections import Counter

    r = np.random.default_rng(2)
    lists = [np.sort(r.integers(0, 512, r.integers(0, 200))) for _ in range(5)]
    filled, count = Cells(9), Counter(np.concatenate(lists).tolist())
    for x in lists:
        filled.add(x)
    assert filled.repeated(np.arange(512)).tolist() == [count[c] > 1 for c in range(512)]


def test_substring_hot_window_and_hash_collisions(spark, monkeypatch):
    from thicket.llm import substring_dedup as module

    # A passage that every document holds, in many bundles; and hashes so short that most windows collide in one of them.
    r = random.Random(5)
    passage = [f"p{i}" for i in range(15)]
    pairs = [(i, " ".join([f"a{r.random()}" for _ in range(20)] + passage + [f"b{r.random()}"])) for i in range(300)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    want = brute_substring(pairs, 13)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(df, bundle=500).collect()} == want
    windows = module.windows
    first = []

    def weak(h, size):  # of the two hashes of a bundle, the first keeps four bits
        first.append(0)
        return windows(h, size) >> np.uint64(60) << np.uint64(60) if len(first) % 2 else windows(h, size)

    monkeypatch.setattr(module, "windows", weak)
    b = module._Bundle(pa.array([t for _, t in pairs[:50]]), np.arange(50), 13)
    distinct = {tuple(w[k : k + 13]) for _, t in pairs[:50] for w in [t.split()] for k in range(len(w) - 12)}
    assert len(b.hash) == len(distinct) and len(np.unique(b.hash)) <= 16


def test_join_kept():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("ab \n\t", k=r.randint(1, 30))).encode()
        w = text.split()
        lost = np.array([r.random() < 0.4 for _ in w], bool)
        if len(w) and not lost.all():
            assert join_kept(np.frombuffer(text, np.uint8), lost) == b" ".join(x for x, y in zip(w, lost, strict=True) if not y)


def test_bpe_is_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    r = random.Random(2)
    alphabet = [*"abcXYZ 'st\n\t\x0b\x1c\x1f\x85\xa0　!?.ÉéΣσςİı漢🙂éﬁ१Ω", "<|endoftext|>", "'LL", "aaaa", "the "]
    from thicket.llm import word_bpe as module

    some = [None, "", "aaa aaaaa", "x" * 5000, "thequickbrownfox" * 400, " ".join(["some words,and"] * 900)] + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for row in encode_decode(df, tokenizer_file("word_bpe_49k.json")).collect():
        ids = library.encode(some[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    # The ways of long texts, chunks and words, which are taken in parts, give the same ids.
    for name, value in (("LONG_TEXT", 200), ("LONG_CHUNK", 50), ("LONG_WORD", 20), ("SHORT", 3)):
        monkeypatch.setattr(module, name, value)
        bpe = module.WordBpe(tokenizer_file("word_bpe_49k.json"), most=5000)
        for k in range(0, len(some), 40):
            part = [x or "" for x in some[k : k + 40]]
            assert bpe.encode(part) == [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]
        assert max(map(len, bpe.seen), default=0) <= module.SHORT and bpe.held < 200_000
    assert encode_decode(df.limit(0), tokenizer_file("word_bpe_49k.json"), digests=True).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_bpe_all_code_points():
    """Every code point of the planes that hold letters and marks, beside letters, marks and digits."""
    from tokenizers import Tokenizer

    from thicket.llm import word_bpe as module

    library, bpe = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), module.WordBpe(tokenizer_file("word_bpe_49k.json"))
    points = [chr(i) for i in [*range(0x40000), *range(0xE0000, 0xE0200)] if not 0xD800 <= i < 0xE000]
    texts = [" ".join(shape.format(c) for c in points[k : k + 2048]) for k in range(0, len(points), 2048) for shape in ("a{}b", "1{}\u0301", "\u00e9{}\u0323's")]
    ours = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
    assert ours == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_long_chunks_with_rare_characters(monkeypatch):
    from tokenizers import Tokenizer

    from thicket.llm import word_bpe as module

    monkeypatch.setattr(module, "LONG_CHUNK", 40)
    library, bpe = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), module.WordBpe(tokenizer_file("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    letters = [*"ab1'st.!e", "\u0301", "\u0323", "\u1df6", "\U0001f600", "\U000105d2", "\u0307", "\u4e2d", "\u00c5"]
    texts = ["".join(rng.choice(letters, 300)) for _ in range(200)]
    ours = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
    assert ours == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (None, "u", "<p>é</p>"), (9, "u", "x" * 9_000_000), (9, "u", "x" * 9_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in round_trip(df).collect())
    d = lambda t: (len(t.encode()), sha1_base32(t.encode()))
    e, x = "<p>é</p>", "x" * 9_000_000
    assert got == sorted([(3, *d(e), "revisit", 1), (1, *d(e), "response", -1), (2, *d(""), "response", -1), (5, *d(""), "revisit", 2), (-1, *d(e), "response", -1)] + [(9, *d(x), "response", -1)] * 2)
    assert round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in round_trip(df.filter("page_id < 4"), revisit_from=100).collect()} == {"response"}


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(spark, compress):
    records = [make_record("response", i, f"u{i}", f"payload {i} WARC/1.1\r\n \x1f\x8b\x08".encode() * 20, None, compress=compress) for i in range(8)]
    broken = bytearray(records[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + records[0] + records[1] + bytes(broken) + records[3] + b"noise\x1f\x8b\x08noise" + records[4] + records[5][: len(records[5]) // 2] + records[6] + records[7][:-9]
    found = list(salvage(data))
    ids = [x.headers["warc-record-id"] for x in found if isinstance(x, Record)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 6)]
    gaps = [x for x in found if isinstance(x, Gap)]
    assert [g.end - g.start for g in gaps] == [4, len(records[2]), 13, len(records[5]) // 2, len(records[7]) - 9]
    assert found[0].start == 0 and found[-1].end == len(data) and all(a.end == b.start for a, b in zip(found, found[1:], strict=False))
    df = spark.createDataFrame([("a", data), ("b", b""), (None, None)], "archive string, content binary")
    read = read_archives(df, with_payload=True).collect()
    assert len(read) == len(found) and sum(r.gap is not None for r in read) == 5


def test_salvage_follows_members_only_so_deep(monkeypatch):
    import gzip

    from thicket.llm import warc

    record = make_record("response", 1, "u", b"payload", None, compress=False)
    for depth, found in ((3, True), (1500, False)):
        data = record
        for _ in range(depth):
            data = gzip.compress(data, 1)
        got = list(salvage(data + record))
        assert isinstance(got[-1], Record) and isinstance(got[0], Record) == found
        assert got[0].start == 0 and got[-1].end == len(data + record)
    monkeypatch.setattr(warc, "MOST_INFLATED", 3 << 20)
    bomb = gzip.compress(b"\0" * (20 << 20))
    got = list(salvage(bomb + record))
    assert [type(x) for x in got] == [Gap, Record] and "inflates" in got[0].reason
    big = make_record("response", 2, "u", b"x" * (2 << 20), None)
    assert [type(x) for x in salvage(big)] == [Record]


def test_bounds_of_archives(spark):
    from thicket.llm.warc import Bounds, read_archives, write_archives

    df = spark.createDataFrame([(1, "u" * 500, "x" * 5000), (2, "v", "y")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes) for r in round_trip(df).collect()) == [(1, 5000), (2, 1)]
    archives = write_archives(df).cache()
    gaps = lambda bounds: sorted(r.gap for r in read_archives(archives, bounds=bounds).filter("gap is not null").collect())
    assert gaps(Bounds()) == gaps(None) == [] and "inflates" in gaps(Bounds(1000))[0] and gaps(Bounds(None, 600)) == ["header without end"]
    many = b"WARC/1.1\r\n" * 20_000 + b"\r\n\r\n"
    assert [type(x) for x in salvage(many, 0, Bounds(None, 1000))] == [Gap]


def test_a_record_that_does_not_come_back_is_an_error(spark, monkeypatch):
    from thicket.llm import warc

    monkeypatch.setattr(warc, "read_archives", lambda archives, **_: archives.selectExpr("archive", "'broken' as gap", "1 as page_id"))
    with pytest.raises(Exception, match="broken"):
        round_trip(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).collect()


def test_salvage_drill(spark):
    from thicket.llm.warc import salvage_drill

    df = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 9) for i in range(60)], "page_id long, url string, html string")
    lost = {r.page_id for r in round_trip(df).collect() if r.payload_digest[0] in "ABCDEF"}
    read = salvage_drill(df).collect()
    assert {r.page_id for r in read if r.gap is None} == set(range(60)) - lost and 0 < len(lost) < 60
    assert sum(r.gap is not None for r in read) > 0
    for archive in {r.archive for r in read}:  # records and gaps cover each archive
        spans = sorted((r.start, r.end) for r in read if r.archive == archive)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_damage_is_done_where_it_matters(spark):
    import gzip
    import io

    from thicket.llm.warc import damaged, make_record, read_archives

    def member(*plain):
        with gzip.GzipFile("x" * 2000, "wb", fileobj=(out := io.BytesIO()), mtime=0) as z:  # the middle of it is in the file's name, which no check covers
            z.write(b"".join(plain))
        return out.getvalue()

    plain = lambda i: make_record("response", i, "u", b"<p>same</p>", None, compress=False)
    archive = member(plain(1)) + member(plain(2), plain(3))  # of a member with two records, a byte isn't turned twice
    df = spark.createDataFrame([("a", bytearray(archive))], "archive string, content binary")
    assert [r.page_id for r in read_archives(df).collect()] == [1, 2, 3]
    got = read_archives(damaged(df, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).collect()
    assert got and all(r.gap for r in got)


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    got = pack(docs, tokenizer_file("byte_bpe_50k.json"), capacity=128, keep_ids=True).collect()
    total, bins = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part and zlib.crc32(r.ids) == r.ids_crc32
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {i: len(x) for i, x in ids.items()}
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == sorted((i, k, a, n) for i, x in ids.items() for k, (a, n) in enumerate(cut(len(x), 128)))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.1 * -(-sum(total.values()) // 128)
    assert pack(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_cut_and_rule():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(4, 4) == [(0, 4)]
    bins, offsets = sum_of_squares(np.array([6, 6, 3, 3, 4]), 10)
    # 3 goes to one of two bins of gap 4, then 3 to the other's like, and 4 where it closes none
    assert offsets.tolist()[:4] == [0, 0, 6, 6] and len(set(bins.tolist())) == 3


def test_sum_of_squares_is_the_rule():
    """Against a version that tries every open bin and counts the squares anew."""
    r = random.Random(8)
    for _ in range(60):
        capacity = r.randint(5, 30)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 60))]
        bins, offsets = sum_of_squares(np.array(lengths), capacity)
        gaps: list[int] = []
        for s, b, at in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
            def squares(k, s=s):
                after = [g - s if i == k else g for i, g in enumerate(gaps)]
                return sum(after.count(g) ** 2 for g in {*after} - {0})

            fit = [k for k, g in enumerate(gaps) if g >= s]
            if fit:
                best = min((squares(k), gaps[k]) for k in fit)
                assert b in fit and (squares(b), gaps[b]) == best
            else:
                assert b == len(gaps)
                gaps.append(capacity)
            assert at == capacity - gaps[b]
            gaps[b] -= s


def test_packing_deals_rows_that_are_all_alike(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text")).repartition(3)
    got = pack(df, tokenizer_file("byte_bpe_50k.json"), capacity=64, group=300).groupBy((F.col("sequence_id") / (1 << 32)).cast("int").alias("g")).agg(F.sum("length").alias("n")).collect()
    assert len(got) == 10 and sum(r.n for r in got) == 6000 and max(r.n for r in got) < 900


def test_quality(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    good = [" ".join(r.choices(words, k=r.randint(30, 120))) for _ in range(120)]
    bad = [" ".join(w + "###" if r.random() < 0.8 else w for w in r.choices(words, k=60)) for _ in range(60)] + [" ".join(w for w in r.choices(words, k=9) for _ in range(9)) for _ in range(60)]
    all_ = [(i, t, i % 3) for i, t in enumerate(good + bad)] + [(1000, None, 0), (1001, "", 0), (None, "x", 0)]
    docs = spark.createDataFrame(all_, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(1001, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == len(all_) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(240))
    assert np.mean([got[i].predicted == int(i < 120) for i in held]) > 0.9
    assert got[1000].score == got[1001].score
    assert classify(docs.limit(0), labels).count() == 0
    assert classify(docs, labels.limit(0)).count() == len(all_)


@pytest.mark.parametrize("y, score, predicted", [(1, 1.0, 1), (0, 0.0, 0), (None, 1.0, 1)])
def test_quality_without_both_labels(spark, y, score, predicted):
    docs = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(20)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in classify(docs, labels).collect()} == {(score, predicted)}


def test_quality_bound_passes_over_only_what_does_not_fit(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(Network, "fit", lambda self, text, y, epochs: fitted.append(sorted(zip(text.to_pylist(), y.tolist(), strict=True))) or self)
    order = [r.id for r in spark.range(400).filter(F.crc32(F.col("id").cast("string")) % 4 != 2).orderBy(F.xxhash64("id", F.lit(11)), "id").collect()]
    # A giant comes first, and the rare label last, in the sample's order.
    rows = [(i, "x" * 30_000 if k == 0 else f"text {i}") for k, i in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < len(order) - 3)) for k, i in enumerate(order)], "doc_id long, quality int")
    classify(docs, labels, max_bytes=20_000).count()
    assert fitted == [sorted((t, float(k < len(rows) - 3)) for k, (_, t) in enumerate(rows) if k)]
    # Texts that exceed the bound together: some of either label stay, within the bound.
    long = docs.withColumn("text", F.concat("text", F.lit("y" * 500)))
    classify(long, labels, max_bytes=20_000).count()
    assert sum(len(t) for t, _ in fitted[1]) <= 20_000 and sum(y == 0 for _, y in fitted[1]) == 3 and sum(y == 1 for _, y in fitted[1]) > 25
    # Of one label all are too long: no scores of weights that nothing was fitted to.
    with pytest.raises(ValueError, match="both labels"):
        classify(docs, labels.withColumn("quality", (F.col("doc_id") == order[0]).cast("int")), max_bytes=20_000)


def test_network_gradient_and_scores(monkeypatch):
    net = Network(e=4, f=3, seed=1)
    column = pa.array(["hello hello world, this is some text " * 12, "x", "", None])
    s = symbols(*__import__("thicket.llm.text", fromlist=["utf8"]).utf8(column))
    y, w = np.array([1, 0, 1, 0], np.float32), np.full(4, 0.25, np.float32)
    g = net.gradients(*s, y, w)

    def loss():
        z = net.logits(*s).astype(float)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    for name in ("w", "v", "b", "c", "emb"):
        x = net.p[name].reshape(-1)
        k = int(np.abs(g[name]).reshape(-1).argmax())
        kept, step = x[k], 1e-2
        x[k] = kept + step
        high = loss()
        x[k] = kept - step
        low = loss()
        x[k] = kept
        assert abs((high - low) / (2 * step) - g[name].reshape(-1)[k]) < 2e-2
    column = pa.array(["hello hello world, this is some text " * 12, "x", "", None, "y" * 60, "z" * 61])
    column = pa.concat_arrays([column, pa.array(["".join(random.Random(1).choices("abc é", k=n)) for n in (63, 64, 200, 252, 253, 900, 5000)])])
    whole, alone = net.score(column), [net.score(column[i : i + 1])[0] for i in range(len(column))]
    assert np.allclose(whole, alone, atol=1e-6)
    from thicket.llm import quality as module

    monkeypatch.setattr(module, "SLICE", 50)  # slice by slice, the scores are the same
    for chunks in (1, 2, 7):
        monkeypatch.setattr(module, "SLICE_CHUNKS", chunks)
        assert np.allclose(whole, net.score(column), atol=1e-6)


def test_token_counts_are_a_unigram_models(spark, monkeypatch):
    from tokenizers import Tokenizer, models

    from thicket.llm import token_counts as module

    scores = file_scores(tokenizer_file("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items(), *((f"<0x{i:02X}>", -3e9) for i in range(256))], 0, True))
    r = random.Random(6)
    pretokens = {MARK + "".join(r.choices("abcdefghiétion漢🙂.,-", k=r.randint(1, 14))) for _ in range(800)} | {MARK, MARK + "the", MARK + "thee"}
    trie = UnigramTrie(scores)
    want = {t: len(library.encode(t).ids) for t in pretokens}
    assert want == {t: trie.insert(t) for t in pretokens} == {t: trie.ends[t] for t in pretokens}
    # One node for each distinct prefix; nothing is computed again for what is known.
    assert len(trie.best) == 1 + len({t[:k] for t in pretokens for k in range(1, len(t) + 1)})
    steps, step = [], trie._step
    trie._step = lambda *a: steps.append(1) or step(*a)
    trie.insert(MARK + "theé")
    assert len(steps) == 1
    monkeypatch.setattr(module, "LONGEST", 3)
    assert {t: trie.insert(t) for t in pretokens} == want
    small = UnigramTrie(scores, 50, 20)
    assert small.counts([" ".join(t[1:] for t in pretokens if len(t) > 1)] * 2)[1] == [sum(n for t, n in want.items() if len(t) > 1)] * 2
    df = spark.createDataFrame([(1, None, 5), (2, " ", 5), (3, "the thee\nthe", 5), (3, "the thee\nthe", 5)], "doc_id long, text string, n_tokens int")
    want = 2 * trie.ends[MARK + "the"] + trie.ends[MARK + "thee"]
    assert sorted((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts(df, tokenizer_file("piece_bpe_32k.model")).collect()) == [(1, 0, 0), (2, 0, 0), (3, 3, want), (3, 3, want)]


def test_top_k(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 0.3, (300, 9))
    x[r.random(300) < 0.4] = x[0]  # many ties
    rows = [(i, [float(v) for v in row], i) for i, row in enumerate(x)]
    rows += [(1000, None, 0), (1050, [], 0), (1100, [1.0, None], 0), (1150, [float("nan")] * 9, 0), (1200, [float("inf")] * 9, 0), (None, [1.0] * 9, 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    v = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, 300, 50):
        order = [i for i in sorted(range(300), key=lambda i: (-int(v[i] @ v[q]), i)) if i != q][:5]
        want += [(q, k + 1, i, int(v[i] @ v[q])) for k, i in enumerate(order)]
    for block, query_block in ((16384, 16384), (64, 2)):
        assert sorted(tuple(r) for r in exact_top_k(df, block=block, query_block=query_block).collect()) == sorted(want)
    assert exact_top_k(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(0, [1e12, -1.0]), (1, [3.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        exact_top_k(wide)
    far = spark.createDataFrame([(0, [1e6, -1.0]), (1, [-2e6, 2.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in exact_top_k(far).collect()] == [256 * 10**6 * -256 * 2 * 10**6 - 256 * 512]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_sliced_block():
    assert all(sum(s << w for s, w in signed_digits(n)) == n for n in range(-600, 600))
    r = np.random.default_rng(9)
    for drop in range(5):
        x = r.integers(-300, 300, (130, 7))
        b, ids = SlicedBlock(x, drop), r.permutation(500)[:130]
        for q in x[:20]:
            got = b.top(q, ids, -1, 4)
            order = np.lexsort((ids, -(x @ q)))[:4]
            assert got[0].tolist() == ids[order].tolist() and got[1].tolist() == (x @ q)[order].tolist()


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("a/x", "code"), ("a/b/COPYING", gpl), ("a/b/c/d", "more\ncode"), ("a/b/e", "// released UNDER the mit license\ncode"),
        ("a/b/e", "// released UNDER the mit license\ncode"), (None, gpl), (None, None), ("z", None), ("a/q", "no license to speak of here, at all, whatever it may be"), ("/LICENSE", gpl), ("/r", ""),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "path string, text string, dir int, license int")
    got = sorted(((r.path, r.text), (r.license, r.origin, r.license_dir)) for r in scan_licenses(df).collect() if r.path is not None)
    best = dict(got)
    assert len(got) == len(rows) - 2
    assert best["LICENSE", mit][:2] in {("MIT", "own")} and best["a/b/c/d", "more\ncode"] == ("GPL-3.0", "inherited", "a/b")
    assert best["a/b/e", rows[4][1]] == ("MIT", "own", None)
    assert best["a/x", "code"][1] == "inherited" and best["a/q", rows[9][1]][1] == "inherited"
    assert scan_licenses(df.limit(0)).count() == 0
    none = scan_licenses(spark.createDataFrame([("a/b", "x"), ("c", None)], "path string, text string")).collect()
    assert {(r.license, r.origin) for r in none} == {(None, "none")}


def test_license_headers_titles_notices_and_files(spark):
    from thicket.llm.licenses import TEMPLATES

    mit = TEMPLATES["MIT"][-1]
    bsd = TEMPLATES["BSD-3-Clause"][-1]
    notice = "\n".join(" * " + x for x in TEMPLATES["Apache-2.0"][-1].split("\n"))
    cases = {
        "a1/x": ("# SPDX-License-Identifier: MIT\ncode", "MIT"), "a2/x": ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), "a3/x": ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
        "a4/x": ("MIT License\n\nCopyright", "MIT"), "a5/x": ("Apache License, Version 2.0, January 2004", "Apache-2.0"), "a6/x": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
        "a7/x": ("int x;\n// This work is licensed under the GNU\n// General Public License, version 3.\nint y;", "GPL-3.0"), "a8/x": ("code\n\n/*\n" + notice + "\n */\n\ncode " * 50, "Apache-2.0"),
        "a9/LICENSE": ("Copyright (c) 2020 Someone\n\n" + mit, "MIT"), "b1/LICENSE.txt": ("Copyright 2019, The Authors. All rights reserved.\n\n" + bsd.replace("\n", "\n\n"), "BSD-3-Clause"),
        "b2/x": ("SPDX-License-Identifier: EPL-2.0", None), "b3/x": ("this sentence has a license in it, and much else that no template holds", None), "b4/COPYING": ("nothing of the kind", None),
    }
    got = {r.path: r.license for r in scan_licenses(spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")).collect()}
    assert got == {p: want for p, (_, want) in cases.items()}


def test_long_lines_are_scanned_in_linear_time(spark):
    import time

    line = lambda n: "license " + " ".join(f"t{i}" for i in range(n))
    took = []
    for n in (100, 2000, 20000):
        df = spark.createDataFrame([("a/x", line(n))], "path string, text string")
        began = time.time()
        assert scan_licenses(df).first().origin == "none"
        took.append(time.time() - began)
    assert took[2] < took[0] + 20 * max(1.0, took[1] - took[0])


CLASHES = ["KEPT", "Keep_ID", "group_size", "Text_SHA256", "N_Shingles", "Component_ID", "SCORE", "Held_Out", "PREDICTED", "N_TOKENS", "IDS", "Decoded", "N_WORDS", "n_removed", "Kept_Text", "N_PreTokens", "License", "ORIGIN", "id", "th", "key", "part", "salt", "bundle_key"]


@pytest.fixture(scope="module")
def clashing(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (2, words + " x"), (3, None), (4, ""), (4, words), (None, "w1 w2")]
    return spark.createDataFrame([(i, t, *range(7, 7 + len(CLASHES))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))


OPERATORS = {
    "exact": (lambda d: exact_dedup(d), {"keep_id", "group_size", "kept", "text_sha256"}),
    "near": (lambda d: near_dedup(d), {"n_shingles", "component_id", "kept"}),
    "substring": (lambda d: substring_dedup(d), {"n_words", "n_removed", "kept_text"}),
    "quality": (lambda d: classify(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")), {"held_out", "score", "predicted"}),
    "counts": (lambda d: token_counts(d, tokenizer_file("piece_bpe_32k.model")), {"n_pretokens", "n_tokens"}),
    "bpe": (lambda d: encode_decode(d, tokenizer_file("word_bpe_49k.json")), {"n_tokens", "ids", "decoded"}),
    "licenses": (lambda d: scan_licenses(d, path_col="path_"), {"license", "score", "origin", "license_dir"}),
    "packing": (lambda d: pack(d, tokenizer_file("byte_bpe_50k.json")), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_are_replaced_without_case(clashing, tmp_path, name):
    apply, results = OPERATORS[name]
    docs = clashing.withColumn("path_", F.lit("a/b")) if name == "licenses" else clashing
    apply(docs).write.parquet(str(tmp_path / name))
    back = docs.sparkSession.read.parquet(str(tmp_path / name))
    assert back.count() >= 6
    if results is not None:
        kept = [c for c in docs.columns if c.lower() not in results and not (name == "bpe" and c == "text")]
        assert [c for c in back.columns if c not in results] == kept and results <= set(back.columns)
        assert all(len(back.select(c).distinct().collect()) == 1 for c in kept if c not in ("doc_id", "text"))
    empty = apply(docs.limit(0))
    assert empty.count() == 0 and empty.columns == back.columns


def test_pipeline_stages_keep_columns(clashing, spark, tmp_path):
    import corpus_pipeline as c

    docs = clashing.withColumn("N_Chars", F.lit(5))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        assert back.schema.simpleString() == docs.schema.simpleString(), name
        assert {tuple(r) for r in back.select(*CLASHES).collect()} <= {tuple(range(7, 7 + len(CLASHES)))}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r.N_Chars for r in spark.read.parquet(str(tmp_path / "substring")).filter("doc_id = 2").collect()} == {1}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    assert F.col and Row and c.run(spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline_stages_against_brute_force(spark, docs, rows):
    from tokenizers import Tokenizer

    import corpus_pipeline as c

    df = docs.select("doc_id", "text", F.char_length("text").alias("n_chars"))
    text = {i: t for i, t, *_ in rows}

    def n(t):
        return t if t is None else len(t)

    out = lambda stage, df: {r.doc_id: (r.text, r.n_chars) for r in stage(spark, df, "").collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in text.items()}
    least = {}
    for i, t in norm.items():
        least[t] = min(least.get(t, i), i)
    assert out(c.exact, df) == {i: (text[i], n(text[i])) for i in least.values()}
    assert out(c.near, df) == {i: (text[i], n(text[i])) for i, (_, _, kept) in brute_near(list(text.items()), 5, 80).items() if kept}
    want = {i: kept if gone else text[i] for i, (_, gone, kept) in brute_substring(list(text.items()), 13).items()}
    assert out(c.substring, df) == {i: (t, n(t)) for i, t in want.items()}
    # The last stage packs all tokens of what the substring stage gives, and a separator for each text.
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    packed = c.packing(spark, c.substring(spark, df, ""), "").agg(F.sum("length")).first()[0]
    assert packed == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in want.values())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classify(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), labels).filter("held_out").join(labels, "doc_id")
    share = {r.quality: r.right for r in got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()}
    assert share[1] >= 0.95 and share[0] >= 0.8, share


def test_pipeline_quality_stage(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in c.quality(spark, docs, sf).collect()}
    good = {r.doc_id for r in classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("score >= 0.7").select("doc_id").collect()}
    assert got == {r.doc_id: tuple(r) for r in docs.collect() if r.doc_id in good} and 0 < len(got) < docs.count()


def test_neighbouring_licenses_are_not_taken_for_each_other(spark):
    from thicket.llm.licenses import TEMPLATES

    mine = {
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
        TEMPLATES["BSD-2-Clause"][1]: "BSD-2-Clause", TEMPLATES["BSD-3-Clause"][2]: "BSD-3-Clause", TEMPLATES["BSD-3-Clause"][2].replace("1.", "*").replace("2.", "*").replace("3.", "*"): "BSD-3-Clause",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": None, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.": None,
        "The contents of this file are subject to the Mozilla Public License Version 1.1.": "MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": None, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1", "GNU GENERAL PUBLIC LICENSE": None, "Licensed under the Apache License, Version 1.1.": None,
        "Released under the MIT License.": "MIT", "Released under the zlib License.": "Zlib", "Released under the Boost License.": None, "SPDX-License-Identifier: EUPL-1.2": None,
    }
    rows = [(k, f"d{k}/LICENSE" if "Redistribution" in t else f"d{k}/x.py", t) for k, t in enumerate(mine)]
    # Frequencies as of a corpus in which such lines are rare.
    rows += [(1000 + k, f"n{k}/x.py", f"the license of item {k} applies here") for k in range(400)]
    got = {r.id: r.license for r in scan_licenses(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    assert [(t[:90], got[k]) for k, t in enumerate(mine)] == [(t[:90], v) for t, v in mine.items()]
