"""The registered queries of the corpus operators and, where SQL can express them, their oracles.

Each applies its operator with production parameters to the whole table and derives the
result's digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BLANK = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]+"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op3_minhash_near_dedup",
    f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)]) END AS grams
  FROM w),
n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(grams) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, sym.b FROM r JOIN sym ON r.y = sym.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = n.doc_id""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.near_dedup import near_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs, shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


@_query(
    "op5_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.exact_dedup import exact_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query(
    "op1_substring_dedup",
    f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS gram FROM i),
f AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN f USING (gram) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS q, unnest(ws) AS word FROM w),
m AS (SELECT words.doc_id, words.q, word, gone.q IS NULL AS kept FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT kept) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY q) FILTER (kept), '') AS kept_text FROM m GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from thicket.llm.substring_dedup import substring_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the folder is a parameter of the environment."""
    import os

    folder = os.environ.get("THICKET_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), capacity=2048)


@_query("op2_bpe_encode_decode")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.word_bpe import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, tokenizer_file("word_bpe_49k.json"), digests=True)


@_query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.quality import classify

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@_query(
    "op10_exact_top_k",
    """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), k=5, modulus=50)


@_query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.token_counts import token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_pretokens", "n_tokens")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


@_query(
    "op4_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query(
    "warc_salvage",
    f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, {_BASE32} AS payload_digest FROM p)
SELECT page_id, payload_digest, substr(payload_digest, 1, 1) NOT IN ('A', 'B', 'C', 'D', 'E', 'F') AS recovered FROM d""",
)
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and whether its record came back from archives in which some records are broken."""
    from pyspark.sql import functions as F

    from thicket.llm.warc import round_trip, salvage_drill

    pages = _table(spark, sf_dir, "pages")
    back = salvage_drill(pages).filter("gap is null").select("page_id", F.lit(True).alias("back"))
    return round_trip(pages).join(back, "page_id", "left").select("page_id", "payload_digest", F.coalesce("back", F.lit(False)).alias("recovered"))


def _op6_sql() -> str:
    from thicket.llm.licenses import ANCHOR, PARTED, known_terms, templates, vetoes

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(templates()))
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]::VARCHAR[]"
    veto = ", ".join(f"({k}, {listed(vetoes(text)[0])}, {listed(vetoes(text)[1])})" for k, (_, text) in enumerate(templates()))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH tmpl(k, license, body) AS (VALUES {rows}),
veto(vk, needed, barred) AS (VALUES {veto}),
tt AS (SELECT tk, any_value(license) AS license, t, count(*) AS k FROM (SELECT k AS tk, license, unnest(regexp_extract_all({low.format("body")}, '[a-z0-9]+')) AS t FROM tmpl) GROUP BY tk, t),
docs AS (
  SELECT doc_id, source || '/' || lang AS top, top || CASE WHEN strlen(coalesce(text, '')) % 3 > 0 THEN '/p' || (strlen(text) % 8) ELSE '' END AS dir, dir || '/' || doc_id AS path, {low.format("coalesce(text, '')")} AS low,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) < 60 AS speaks FROM documents),
split AS (SELECT doc_id, string_split(low, chr(10)) AS ls FROM docs),
spots AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split),
here AS (SELECT doc_id, i, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] ELSE '' END AS before, coalesce(ls[i + 1], '') AS after FROM spots WHERE regexp_matches(ls[i], '{ANCHOR}')),
lines AS (SELECT doc_id, i, regexp_extract_all(line, '[a-z0-9]+') AS ts FROM here),
units AS (
  SELECT doc_id, 'l' || i AS i, ts FROM lines
  UNION ALL SELECT doc_id, 'a' || i, regexp_extract_all(line || ' ' || after, '[a-z0-9]+') FROM here
  UNION ALL SELECT doc_id, 'b' || i, regexp_extract_all(before || ' ' || line, '[a-z0-9]+') FROM here
  UNION ALL SELECT doc_id, 'p' || i, regexp_extract_all(ps[i], '[a-z0-9]+') FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split_regex(low, '{PARTED}') AS ps FROM docs)) WHERE regexp_matches(ps[i], '{ANCHOR}')
  UNION ALL SELECT doc_id, 'w', regexp_extract_all(low, '[a-z0-9]+') FROM docs WHERE speaks),
total AS (SELECT count(*) AS n FROM lines),
df AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, i, unnest(ts) AS t FROM lines) GROUP BY t),
lt AS (SELECT doc_id, i, t, count(*) AS k FROM (SELECT doc_id, i, unnest(ts) AS t FROM units) GROUP BY ALL),
known AS (SELECT unnest({listed(known_terms())}) AS t),
idf AS (SELECT known.t, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM known CROSS JOIN total LEFT JOIN df ON df.t = known.t),
lw AS (SELECT doc_id, i, lt.t, k * coalesce(w, ln(1 + n) + 1) AS x FROM lt CROSS JOIN total LEFT JOIN idf ON idf.t = lt.t),
ln_ AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm FROM lw GROUP BY ALL),
tw AS (SELECT tk, license, tt.t, k * w AS y FROM tt JOIN idf ON idf.t = tt.t),
tn AS (SELECT tk, sqrt(sum(y * y)) AS norm FROM tw GROUP BY ALL),
c AS (
  SELECT d.doc_id, round(d.dot / (ln_.norm * tn.norm), 6) AS score, d.license
  FROM (SELECT doc_id, i, tk, license, sum(x * y) AS dot FROM lw JOIN tw ON lw.t = tw.t GROUP BY ALL) d
  JOIN ln_ ON ln_.doc_id = d.doc_id AND ln_.i = d.i JOIN tn ON tn.tk = d.tk JOIN units u ON u.doc_id = d.doc_id AND u.i = d.i JOIN veto ON vk = d.tk
  WHERE list_has_all(u.ts, needed) AND NOT list_has_any(u.ts, barred)),
best AS (SELECT doc_id, score, license FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license DESC) AS r FROM c) WHERE r = 1 AND score >= 0.8),
spoken AS (
  SELECT dir, score, license FROM (
    SELECT dir, score, license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) AS r
    FROM docs JOIN best ON best.doc_id = docs.doc_id WHERE speaks) WHERE r = 1)
SELECT docs.doc_id, path, coalesce(best.license, near.license, far.license) AS license, coalesce(best.score, near.score, far.score) AS score,
  CASE WHEN best.license IS NOT NULL THEN 'own' WHEN coalesce(near.license, far.license) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN best.license IS NULL THEN coalesce(near.dir, far.dir) END AS license_dir
FROM docs LEFT JOIN best ON best.doc_id = docs.doc_id LEFT JOIN spoken near ON near.dir = docs.dir LEFT JOIN spoken far ON far.dir = docs.top"""


@_query("op6_license_scan", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree source/lang/doc_id and source/lang/part/doc_id (by the length of the text); those of under 60 words speak for their directory, and those below it."""
    from pyspark.sql import functions as F

    from thicket.llm.licenses import scan_licenses

    n = F.octet_length(F.coalesce("text", F.lit("")))
    part = F.when(n % 3 > 0, F.concat(F.lit("p"), n % 8))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", part, "doc_id").alias("path"))
    short = F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _BLANK, " ")), " ")) < 60
    return scan_licenses(docs, license_file=short).select("doc_id", "path", "license", "score", "origin", "license_dir")


def _op13_sql(top: int = 14) -> str:
    """Classes of 8, 16, .. words by hashes of their halves; neighbours at a distance that a length tells are candidate periods, which the words themselves confirm."""
    digits = "[CAST(unicode(x) AS BIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')]"
    word_at = "list_concat(ws[1:a], [ws[a + 1 + (i % p)] for i in range(n - a)])"
    levels = [f"c3 AS (SELECT doc_id, i, hash({', '.join(f'ws[i + {k}]' for k in range(8))}) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 24))"]
    levels += [f"c{k} AS (SELECT x.doc_id, x.i, hash(x.c, y.c) AS c FROM c{k - 1} x JOIN c{k - 1} y ON x.doc_id = y.doc_id AND y.i = x.i + {1 << (k - 1)} JOIN d ON d.doc_id = x.doc_id WHERE d.n >= {3 << (k - 1)})" for k in range(4, top + 1)]
    pairs = " UNION ALL ".join(
        f"SELECT doc_id, q FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id, c ORDER BY i) - i AS q FROM c{k}) WHERE q <= {1 << k} AND q > {(1 << (k - 1)) if k > 3 else 0}" for k in range(3, top + 1)
    )
    return f"""
WITH remainders AS MATERIALIZED (SELECT [list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for n in range(256)] AS t),
raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, remainders),
sized AS (SELECT doc_id, ws, h, len(ws) AS n, h // 10 AS g FROM raw),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
w AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN {word_at} ELSE ws END AS ws FROM placed),
d AS (SELECT doc_id, len(ws) AS n FROM w),
each_word AS MATERIALIZED (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in levels)},
cand AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM ({pairs})),
m AS (SELECT c.doc_id, c.q, x.i, x.i - row_number() OVER (PARTITION BY c.doc_id, c.q ORDER BY x.i) AS island FROM cand c JOIN each_word x ON x.doc_id = c.doc_id JOIN each_word y ON y.doc_id = c.doc_id AND y.i = x.i + c.q WHERE x.word = y.word),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length),
marks AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id),
best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period OR o.length * r.period = r.length * o.period AND (o.start < r.start OR o.start = r.start AND o.period < r.period)))),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS body FROM each_word x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id"""


@_query("op13_periodic_runs", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, a tenth of which (by the id's crc32) get a periodic end first."""
    from pyspark.sql import functions as F

    from thicket.llm.periodic_runs import periodic_runs

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    ends = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    docs = docs.withColumn("ws", F.when(ends, F.filter(F.split("text", _BLANK), lambda x: x != ""))).withColumn("n", F.size("ws")).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("ws", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    s = F.col("strongest")
    return periodic_runs(docs).select(
        "doc_id", "n_runs", s.start.alias("start"), s.length.alias("length"), s.period.alias("period"),
        F.floor(F.lit(1000).cast("long") * s.length / s.period).cast("long").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from thicket.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=8).withColumn("deviation", F.col("deviation").cast("long"))


@_query(
    "op11_embedding_near_dedup",
    """
WITH RECURSIVE t AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 THEN [CAST(x AS DOUBLE) for x in embedding] END AS v FROM embeddings),
u AS (SELECT vec_id, [x / sqrt(list_sum([y * y for y in v])) for x in v] AS v FROM t WHERE v IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.v, y.v) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM t UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM t JOIN c ON c.x = vec_id LEFT JOIN d ON d.a = vec_id""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.95).select("vec_id", "n_links", "component_id", "kept")
