"""Validation, serialisation and canonical form, functions, streams."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import html, xml
from thicket.functions import numbers, strings
from thicket.functions.types import BUILTIN, facets_ok, list_of, union_of
from thicket.operators import validate
from thicket.operators.selection import Selection, attr
from thicket.operators.content import automaton, fits, parse
from thicket.operators.validate import Rule, Shape, el, interleave, one_of, seq, times
from thicket.plans import relational
from thicket.sinks import serialize
from thicket.streaming import documents as streaming

DTD = """<!-- c --><!ENTITY % leaf "(#PCDATA)">
<!ELEMENT book (title, (author | editor)+, note?)> <!ELEMENT title %leaf;> <!ELEMENT author %leaf;> <!ELEMENT editor EMPTY> <!ELEMENT note (#PCDATA | em)*> <!ELEMENT em ANY>
<!ATTLIST book id ID #REQUIRED kind (a|b) "a" see IDREFS #IMPLIED v CDATA #FIXED "1"> <!ATTLIST author key NMTOKEN #IMPLIED>"""


def rules_of(df):
    out: dict[int, list] = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r.rule)
    return {k: sorted(v) for k, v in out.items()}


def test_dtd(spark):
    dtd = validate.Dtd.parse(DTD, root="book")
    nodes = xml(
        spark,
        '<book id="x" see="x"><title>t</title><author key="k-1">a</author><editor/><note>n<em/></note></book>',
        "<book><title/><note/></book>",
        '<book id="x" kind="c" v="2" w="3"><title/><editor>e</editor></book>',
        '<other id="1x"/>',
        '<book id="x" see="y x"><title/><author key="a b"/><note><title/></note></book>',
        '<book id="9"> <title/>text<author/></book>',
    )
    got = rules_of(validate.check_dtd(nodes, dtd))
    assert got == {
        1: ["content-model", "required-attribute"],
        2: ["attribute-type", "content-model", "fixed-attribute", "undeclared-attribute"],
        3: ["root", "undeclared-attribute", "undeclared-element"],
        4: ["attribute-type", "content-model", "dangling-idref"],
        5: ["attribute-type", "content-model"],
    }
    v = {r.doc_id: r.is_valid for r in validate.verdicts(nodes, validate.check_dtd(nodes, dtd)).collect()}
    assert v[0] and not any(v[i] for i in range(1, 6))
    assert validate.dtd_table(spark, dtd).count() == 11
    with pytest.raises(ValueError):
        validate.Dtd.parse("<!ELEMENT a EMPTY><!ELEMENT a ANY>")
    dup = xml(spark, '<book id="x"><title/><author/></book>', '<l><b id="x"/><b id="x"/><b id="x"/></l>')
    d2 = validate.Dtd.parse("<!ELEMENT l (b*)><!ELEMENT b EMPTY><!ATTLIST b id ID #REQUIRED>")
    assert rules_of(validate.check_dtd(dup, d2))[1] == ["duplicate-id", "duplicate-id"]


def test_shapes(spark):
    shapes = {
        "card": Shape(seq(el("name"), times(one_of(el("mail"), el("phone")), 1, 2)), attributes={"n": ("int", True)}, closed=True),
        "name": Shape(text="string", facets={"minLength": 2, "pattern": "[A-Z].*"}),
        "mail": Shape(text="token"),
        "phone": Shape(text="positiveInteger"),
    }
    nodes = xml(spark, '<card n="1"><name>Al</name><mail>m</mail></card>', '<card n="x" z="1"><name>a</name><phone>0</phone><mail/><mail/></card>', "<card><name>Bo</name></card>", "<name>Cy</name>")
    got = rules_of(validate.check_shapes(nodes, "card", shapes))
    assert got == {1: ["attribute-type", "content", "type", "type", "undeclared-attribute"], 2: ["content", "required-attribute"], 3: ["root"]}


def test_interleave(spark):
    p = interleave(("a", 1, 1), ("b", 0, 2), ("c", 1, None))
    ok = ["a c", "c a c", "b c a b", "c b a c c"]
    bad = ["a", "a a c", "b b b a c", "a c d", ""]
    df = spark.createDataFrame([(x.split(),) for x in ok + bad], "w array<string>").coalesce(1)
    assert [r.ok for r in df.select(fits(F.col("w"), p).alias("ok")).collect()] == [True] * 4 + [False] * 5


def test_content_models(spark):
    """The automaton says what a backtracking pattern says."""
    import itertools
    import re

    for text in ("(a,b)", "(a|b)*", "((a,b)|c)*", "(a?,b*,c+)", "((a|b),(a|c)?)+", "a", "(a,(b|c)*,a)"):
        pattern = re.sub(r"[abc]", lambda m: m[0] + " ", text).replace(",", "")
        moves, final = automaton(parse(text))
        for n in range(5):
            for w in itertools.product("abc", repeat=n):
                s = 0
                for x in w:
                    s = moves.get((s, x), -1)
                assert (s in final) == bool(re.fullmatch(re.sub(r"([abc]) ", r"(?:\1 )", pattern), "".join(x + " " for x in w))), (text, w)
    for bad in ("(a,b|c)", "(a", "a)", "(a,)", "(*a)", "(a b)"):
        with pytest.raises(ValueError):
            parse(bad)
    many = spark.createDataFrame([(["a", "b"] * 50_000,), (["a"] * 99_999 + ["c"],)], "w array<string>").coalesce(1)
    assert [r.ok for r in many.select(fits(F.col("w"), parse("(a|b)*")).alias("ok")).collect()] == [True, False]
    assert [r.ok for r in many.select(fits(F.col("w"), parse("((a,b)|(a,c))+")).alias("ok")).collect()] == [True, False]


def test_dtd_of_very_many_children(spark):
    dtd = validate.Dtd.parse("<!ELEMENT l (a|b)*><!ELEMENT a EMPTY><!ELEMENT b EMPTY>")
    nodes = xml(spark, "<l>" + "<a/><b/>" * 50_000 + "</l>", "<l>" + "<a/>" * 30_000 + "<l/></l>")
    assert rules_of(validate.check_dtd(nodes, dtd)) == {1: ["content-model"]}
    with pytest.raises(ValueError):
        validate.Dtd.parse('<!ENTITY % a "%b;"><!ENTITY % b "%a;"><!ELEMENT x %a;>')


def test_rules_first_fires(spark):
    nodes = xml(spark, '<o><i n="1" k="a"/><i n="5"/><i/></o>')
    rules = {
        "p": [
            Rule(lambda s: s.descendant("i").where(attr("k") == "a"), asserts=[(F.col("n") > 3, "n is {n}")], facts=lambda r, _: r.withColumn("n", attr("n"))),
            Rule(lambda s: s.descendant("i"), asserts=[(attr("n").isNotNull(), "no n")], reports=[(attr("n") == "5", "five"), (attr("n") == "1", "never")]),
        ],
        "q": [Rule(lambda s: s.child("o"), reports=[(F.lit(True), "seen")])],
    }
    got = sorted((r.rule, r.severity, r.message) for r in validate.check_rules(nodes, rules).collect())
    assert got == [("p/0", "error", "n is 1"), ("p/1", "error", "no n"), ("p/1", "warning", "five"), ("q/0", "warning", "seen")]
    assert validate.check_rules(nodes, rules, phase=["q"]).count() == 1
    with pytest.raises(ValueError):
        validate.check_rules(nodes, rules, phase=["z"])


def test_types_and_facets(spark):
    cases = {
        "boolean": (["true", "0", " 1 "], ["yes", ""]), "decimal": (["1", "-.5", "+2."], ["1e3", "", "."]), "double": (["1e3", "INF", "NaN", "-0"], ["inf", "x"]), "byte": (["-128", "127"], ["128", "1.0"]), "unsignedLong": (["18446744073709551615"], ["-1", "18446744073709551616"]),
        "positiveInteger": (["1"], ["0"]), "integer": (["9" * 38, "+7"], ["", "a"]), "date": (["2024-02-29", "2024-01-01Z", "2024-01-01+05:30"], ["2023-02-29", "2024-13-01", "24-1-1"]), "dateTime": (["2024-01-01T00:00:00", "2024-01-01T23:59:59.5Z"], ["2024-01-01", "2024-01-01T24:00:01"]),
        "time": (["12:00:00"], ["25:00:00"]), "NMTOKEN": (["a:b-1"], ["a b", ""]), "ID": (["_a"], ["1a"]), "token": (["a b"], [" a", "a  b"]), "normalizedString": ([" a  b"], ["a\tb"]),
    }
    for kind, (good, bad) in cases.items():
        df = spark.createDataFrame([(x,) for x in good + bad], "v string").coalesce(1)
        assert [r.ok for r in df.select(BUILTIN[kind](F.col("v")).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad), kind
    one = spark.createDataFrame([("0012.50",)], "v string")
    test = lambda kind, facets: one.select(facets_ok(F.col("v"), kind, facets).alias("ok")).first().ok
    assert test("decimal", {"totalDigits": 4, "fractionDigits": 1, "minInclusive": 12.5, "maxExclusive": 13}) and not test("decimal", {"minExclusive": 12.5})
    assert test("string", {"length": 7, "pattern": r"\d+\.\d+", "enumeration": ["0012.50"]}) and not test("string", {"maxLength": 6})
    row = spark.createDataFrame([("1 2 3", "x")], "a string, b string").select(list_of("int")(F.col("a")).alias("p"), list_of("int")(F.col("b")).alias("q"), union_of("int", "boolean")(F.lit("true")).alias("r"), union_of("int", "boolean")(F.col("b")).alias("s")).first()
    assert tuple(row) == (True, False, True, False)


def test_numbers(spark):
    inf, nan = math.inf, math.nan
    same = lambda a, b: (math.isnan(a) and math.isnan(b)) or (a == b and math.copysign(1, a) == math.copysign(1, b))
    texts = {" 12 ": 12.0, "-.5": -0.5, "": nan, "1e3": nan, "+1": nan, "1d": nan, "5.": 5.0, "-": nan}
    df = spark.createDataFrame(list(texts.items()), "s string, want double")
    assert all(same(r.x, r.want) for r in df.select("want", numbers.to_number(F.col("s")).alias("x")).collect())
    shown = {1.0: "1", -0.0: "0", 0.1: "0.1", -2.5: "-2.5", inf: "Infinity", -inf: "-Infinity", nan: "NaN", 1e15: "1000000000000000", 123456.789: "123456.789"}
    df = spark.createDataFrame([(k, v) for k, v in shown.items()], "x double, want string")
    assert all(r.t == r.want for r in df.select("want", numbers.to_text(F.col("x")).alias("t")).collect())
    pairs = [(1.0, 0.0, inf), (-1.0, 0.0, -inf), (1.0, -0.0, -inf), (0.0, 0.0, nan), (6.0, 4.0, 1.5), (nan, 1.0, nan)]
    df = spark.createDataFrame(pairs, "a double, b double, want double")
    assert all(same(r.x, r.want) for r in df.select("want", numbers.divide(F.col("a"), F.col("b")).alias("x")).collect())
    mods = [(5.0, 3.0, 2.0), (-5.0, 3.0, -2.0), (5.0, 0.0, nan), (inf, 3.0, nan), (5.0, inf, 5.0), (1.5, 0.5, 0.0)]
    df = spark.createDataFrame(mods, "a double, b double, want double")
    assert all(same(r.x, r.want) for r in df.select("want", numbers.modulo(F.col("a"), F.col("b")).alias("x")).collect())
    df = spark.createDataFrame([(2.5, 2.0, 3.0, 3.0), (-2.5, -3.0, -2.0, -2.0), (nan, nan, nan, nan), (inf, inf, inf, inf), (1e300, 1e300, 1e300, 1e300)], "x double, f double, c double, r double")
    x = F.col("x")
    for r in df.select("f", "c", "r", numbers.floor(x).alias("f2"), numbers.ceiling(x).alias("c2"), numbers.round_half_up(x).alias("r2")).collect():
        assert same(r.f, r.f2) and same(r.c, r.c2) and same(r.r, r.r2)


def test_strings(spark):
    lit = F.lit
    row = spark.range(1).select(
        strings.before(lit("1999/04"), lit("/")), strings.before(lit("a"), lit("x")), strings.after(lit("1999/04"), lit("/")), strings.after(lit("a"), lit("x")), strings.after(lit("abc"), lit("")),
        strings.substring(lit("12345"), lit(1.5), lit(2.6)), strings.substring(lit("12345"), lit(0.0), lit(3.0)), strings.substring(lit("12345"), lit(2.0)), strings.substring(lit("12345"), lit(-42.0), lit(math.inf)), strings.substring(lit("12345"), lit(math.nan)),
        strings.normalize_space(lit(" a \n  b ")), strings.translate(lit("bar"), "abr", "AB"), strings.matches(lit("xAb"), "^xab$", "i"), strings.matches(lit("xab"), "^ab$"), strings.replace(lit("abc"), "(b)", "[$1]"), F.concat_ws("|", strings.tokens(lit(" a  b "))),
    ).first()
    assert list(row) == ["1999", "", "04", "", "abc", "234", "12", "2345", "12345", "", "a b", "BA", True, False, "a[b]c", "a|b"]
    with pytest.raises(ValueError):
        strings.matches(lit("a"), "a", "q")


def canonical(spark, text, **options):
    return serialize.canonical(xml(spark, text), **options).first().text


def test_canonical(spark):
    text = '<?xml version="1.0"?>\n<?p  d ?>\n<!DOCTYPE doc>\n<!-- c -->\n<doc>Hi<!-- in --></doc>\n<?q?>\n<!-- end -->'
    assert canonical(spark, text) == "<?p d ?>\n<doc>Hi</doc>\n<?q?>"
    assert canonical(spark, text, comments=True) == "<?p d ?>\n<!-- c -->\n<doc>Hi<!-- in --></doc>\n<?q?>\n<!-- end -->"
    start_end = '<doc><e1 /><e2 ></e2><e3 name = "n" id="i" /><e5 a:attr="out" b:attr="sorted" attr2="all" attr="I\'m" xmlns:b="http://www.ietf.org" xmlns:a="http://www.w3.org" xmlns="http://example.org"/><e6 xmlns="" xmlns:a="http://www.w3.org"><e7 xmlns="http://www.ietf.org"><e8 xmlns="" xmlns:a="http://www.w3.org"/></e7></e6></doc>'
    want = '<doc><e1></e1><e2></e2><e3 id="i" name="n"></e3><e5 xmlns="http://example.org" xmlns:a="http://www.w3.org" xmlns:b="http://www.ietf.org" attr="I\'m" attr2="all" b:attr="sorted" a:attr="out"></e5><e6 xmlns:a="http://www.w3.org"><e7 xmlns="http://www.ietf.org"><e8 xmlns=""></e8></e7></e6></doc>'
    assert canonical(spark, start_end) == want
    assert canonical(spark, '<a b="&#9;&quot;&lt;&amp;>">&#13;&gt;<![CDATA[<&]]></a>') == '<a b="&#x9;&quot;&lt;&amp;>">&#xD;&gt;&lt;&amp;</a>'
    nested = '<n0:pdu xmlns:n0="http://a.example" xmlns:n1="http://b.example"><n1:elem2 xmlns:n3="u"><n3:stuff/></n1:elem2></n0:pdu>'
    assert canonical(spark, nested, exclusive=True) == '<n0:pdu xmlns:n0="http://a.example"><n1:elem2 xmlns:n1="http://b.example"><n3:stuff xmlns:n3="u"></n3:stuff></n1:elem2></n0:pdu>'
    assert 'xmlns:n1="http://b.example"><n1:elem2>' in canonical(spark, nested, exclusive=True, inclusive_prefixes=("n1",))
    once = canonical(spark, start_end)
    assert canonical(spark, once) == once


def test_serialize(spark):
    text = "<a><b><c/></b><d>x<e/></d><!--k--></a>"
    nodes = xml(spark, text)
    assert serialize.to_xml(nodes).first().text == f'<?xml version="1.0"?>\n{text}\n'
    pretty = serialize.to_xml(nodes, declaration=False, indent="  ").first().text
    assert pretty == "<a>\n  <b>\n    <c/>\n  </b>\n  <d>x<e/></d>\n  <!--k-->\n</a>\n"
    assert serialize.subtree_xml(nodes, Selection(nodes).descendant("d").nodes()).first().text == "<d>x<e/></d>"
    assert serialize.debug_tree(nodes).first().text.splitlines()[:3] == ["document", "  element a", "    element b"]
    page = html(spark, '<!DOCTYPE html><p title="&quot;<">a&amp;&nbsp;<br><script>1<2</script>')
    assert serialize.to_html(page).first().text == '<!DOCTYPE html><html><body><p title="&quot;<">a&amp;&nbsp;<br><script>1<2</script></p></body></html>'
    row = spark.range(1).select(serialize.set_encoding(F.lit('<?xml version="1.0" encoding="a"?><x/>'), "UTF-8"), serialize.set_encoding(F.lit('<?xml version="1.0"?><x/>'), "UTF-8")).first()
    assert list(row) == ['<?xml version="1.0" encoding="UTF-8"?><x/>'] * 2


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "<a><b/></a>"), (2, "<a>")], "doc_id long, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    q = streaming.stream_nodes(stream).writeStream.format("memory").queryName("stream_nodes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.doc_id, r.kind, r.error is None) for r in spark.table("stream_nodes").collect()) == [(1, "document", True), (1, "element", True), (1, "element", True), (2, "document", False)]


def test_chunks_in_state(spark, tmp_path):
    schema = "doc_id long, seq long, chunk string, last boolean, ts timestamp"

    def put(name, rows):
        spark.createDataFrame(rows, "doc_id long, seq long, chunk string, last boolean, ts string").write.mode("append").json(str(tmp_path / "in"))

    day = "2024-01-01T{}:00:00Z"
    put("a", [(1, 1, "b>", False, day.format("00")), (1, 0, "<a><", False, day.format("00")), (2, 0, "lost", False, day.format("00"))])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(str(tmp_path / "in"))
    q = streaming.assemble_stream(source, "1 hour").writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    put("b", [(1, 2, "</b></a>", True, day.format("00"))])
    q.processAllAvailable()
    put("c", [(3, 0, "<z/>", True, day.format("09"))])
    q.processAllAvailable()
    put("d", [(4, 0, "<z/>", True, day.format("10"))])
    q.processAllAvailable()
    q.stop()
    got = {(r.doc_id, r.text, r.complete) for r in spark.table("chunks").collect()}
    assert {(1, "<a><b></b></a>", True), (3, "<z/>", True), (2, "lost", False)} <= got


def test_as_of_and_descendants(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "key string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 6, "c")], "key string, t int, v string")
    assert sorted((r.key, r.t, r.v or "") for r in relational.as_of(left, right, ["key"], "t", "t", ["v"]).collect()) == [("j", 9, ""), ("k", 1, ""), ("k", 5, "b")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    assert sorted(r.node for r in relational.descendants(edges, spark.createDataFrame([("a",)], "node string")).collect()) == ["a", "b", "c"]


def test_documents_of_many_batches_are_put_together_whole(spark):
    texts = ["<a/>", "<a><b>" + "<c>x</c>" * 9000 + "</b><!--y--><d><e/></d></a>", "<a>é<b>z</b></a>", "", "<?p?><a xmlns='u'><b xmlns=''/></a><!--e-->"]
    nodes = xml(spark, *texts)
    want = {0: "<a></a>", 1: texts[1].replace("<!--y-->", "").replace("<e/>", "<e></e>"), 2: texts[2], 4: '<?p?>\n<a xmlns="u"><b xmlns=""></b></a>'}
    assert {d: t for d, t in serialize.canonical(nodes).collect() if d != 3} == want
    written = dict(serialize.to_xml(nodes, declaration=False).collect())
    assert [written[k].strip() for k in (0, 1, 2, 3)] == [texts[0], texts[1], texts[2], ""]
