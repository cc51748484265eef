"""Parsing: numbers of the node table, well-formedness, limits, HTML's implied structure, encodings."""

from __future__ import annotations

import random
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from tests.helpers import html, xml
from thicket.sinks import serialize
from thicket.sources import encoding
from thicket.sources.events import events
from thicket.sources.xml import ParseOptions, drop_blanks, read_xml


def random_document(r: random.Random, depth=0) -> str:
    name = r.choice("abcde")
    attrs = "".join(f' {k}="{escape(r.choice(["", "x", "<&>", "é"]), {chr(34): "&quot;"})}"' for k in r.sample("pqr", r.randint(0, 3)))
    if depth > 4:
        return f"<{name}{attrs}/>"
    inner = "".join(r.choice([lambda: random_document(r, depth + 1), lambda: escape(r.choice(["t", "a < b", " ", "漢"])), lambda: "<!--c-->", lambda: "<?p d?>", lambda: "<![CDATA[<x>]]>"])() for _ in range(r.randint(0, 4)))
    return f"<{name}{attrs}>{inner}</{name}>"


def test_numbers_nest_and_round_trip(spark):
    texts = [random_document(random.Random(i)) for i in range(60)]
    nodes = xml(spark, *texts).cache()
    by_doc: dict[int, list] = {}
    for r in nodes.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == 60
    for rows in by_doc.values():
        rows.sort(key=lambda r: r.pre)
        assert [r.pre for r in rows] == list(range(len(rows))) and rows[0].kind == "document" and rows[0].error is None
        for r in rows:
            kids = [k for k in rows if k.parent == r.pre]
            assert [k.ord for k in kids] == list(range(1, len(kids) + 1))
            assert r.post == max([r.pre, *(k.post for k in kids)])
            el = [k for k in kids if k.kind == "element"]
            assert [k.elem_ord for k in el] == list(range(1, len(el) + 1)) and [k.elem_ord_last for k in el] == list(range(len(el), 0, -1))
            assert all(k.depth == r.depth + 1 for k in kids)
    again = serialize.to_xml(nodes)
    twice = serialize.to_xml(xml_of(again))
    assert dict(again.collect()) == dict(twice.collect())


def xml_of(df):
    from thicket.sources.xml import parse_xml

    return parse_xml(df)


def test_errors_limits_and_recovery(spark):
    deep = "<a>" * 300 + "</a>" * 300
    bomb = '<!DOCTYPE a [<!ENTITY x0 "ha">' + "".join(f'<!ENTITY x{i + 1} "{f"&x{i};" * 20}">' for i in range(8)) + "]><a>&x8;</a>"
    texts = ["<a><b></a>", "", "no markup", deep, bomb, '<a x="1" x="2"/>', "<a>\x01</a>", "<ok/>", None]
    got = {r.doc_id: r.error for r in xml(spark, *texts).filter("kind = 'document'").collect()}
    assert got[7] is None and all(got[i] for i in (0, 1, 2, 3, 4, 5, 6, 8))
    kept = xml(spark, "<a><b>x</b><c>", options=ParseOptions(recover=True))
    assert [r.name for r in kept.filter("kind = 'element'").orderBy("pre").collect()] == ["a", "b", "c"]
    assert xml(spark, "<a><b>x</b><c>").count() == 1
    assert xml(spark, '<a b="123456"/>', options=ParseOptions(max_attribute_length=5)).first().error
    assert xml(spark, "<a/>" * 1, options=ParseOptions(max_name_length=0)).first().error


def test_limits_hold_for_whole_texts_and_all_expansions(spark):
    lines = "<a>" + "some text &amp;\n" * 4000 + "</a>"
    assert xml(spark, lines, options=ParseOptions(max_text_length=40_000)).first().error == "text too long"
    whole = xml(spark, lines, "<a><![CDATA[" + "x\n" * 40_000 + "]]></a>").filter("kind in ('text', 'cdata')").orderBy("doc_id").collect()
    assert [(r.kind, len(r.content)) for r in whole] == [("text", 4000 * 12), ("cdata", 80_000)]
    nested = '<!DOCTYPE a [<!ENTITY x "v"><!ENTITY y "&x;&x;&x;">]><a>' + "&y;" * 30 + "<!-- &y; --></a>"
    assert xml(spark, nested, options=ParseOptions(max_entity_expansions=119)).first().error == "too many entity expansions"
    assert xml(spark, nested, options=ParseOptions(max_entity_expansions=120)).first().error is None


def test_only_what_is_asked_for_is_sent(spark):
    from thicket.sources.xml import parse_xml

    docs = spark.createDataFrame([(0, '<a><b x="1">t<c>u</c></b><b>v</b></a>'), (1, "<a>w</a>"), (2, "<a>")], "doc_id long, text string")
    every = parse_xml(docs)
    some = parse_xml(docs, columns=["doc_id", "pre", "path", "content", "attrs"], paths=["/a/b"])
    assert some.columns == ["doc_id", "pre", "attrs", "content", "path"]
    b = every.filter("path = '/a/b'").select("doc_id", F.col("pre").alias("parent"))
    texts = every.filter("kind = 'text'").join(b, ["doc_id", "parent"], "left_semi")
    want = every.filter("kind = 'document' or path = '/a/b'").select(*some.columns).union(texts.select(*some.columns))
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and some.count() == 3 + 2 + 2
    with pytest.raises(ValueError):
        parse_xml(docs, columns=["nothing"])


def test_long_text_is_put_together_once():
    import time

    from thicket.sources.tree import Nodes
    from thicket.sources.xml import xml_reader

    took = []
    for n in (500_000, 2_000_000):
        nodes = Nodes()
        began = time.time()
        xml_reader(nodes, ParseOptions())(1, "<a>" + "line of text\n" * (n // 13) + "</a>")
        took.append(time.time() - began)
        assert len(nodes.content[-1]) == n // 13 * 13
    assert took[1] < 4 * took[0] * 3 + 0.5


def test_entities_doctype_and_defaults(spark):
    text = '<!DOCTYPE a PUBLIC "p" "s" [<!ENTITY e "v"><!ENTITY x SYSTEM "ext"><!ATTLIST b t CDATA "d">]><a><b/>&e;&x;<![CDATA[c]]></a>'
    rows = xml(spark, text, options=ParseOptions(entities={"ext": "<in>side</in>"})).orderBy("pre").collect()
    assert [(r.kind, r.name, r.content) for r in rows[1:]] == [("doctype", "a", 'PUBLIC "p" "s" [<!ENTITY e "v"><!ENTITY x SYSTEM "ext"><!ATTLIST b t CDATA "d">]'), ("element", "a", None), ("element", "b", None), ("text", None, "v"), ("element", "in", None), ("text", None, "side"), ("cdata", None, "c")]
    assert rows[3].attrs[0].value == "d"
    assert "in" not in [r.name for r in xml(spark, text).collect()]


def test_blanks_and_namespaces(spark):
    nodes = xml(spark, '<p:a xmlns:p="u" xmlns="d">\n <b p:x="1" y="2"/>\n</p:a>')
    assert drop_blanks(nodes).filter("kind = 'text'").count() == 0
    a, b = nodes.filter("kind = 'element'").orderBy("pre").collect()
    assert (a.name, a.prefix, a.namespace) == ("a", "p", "u") and (b.name, b.prefix, b.namespace) == ("b", None, "d")
    assert [(x.name, x.value, x.prefix, x.namespace) for x in b.attrs] == [("x", "1", "p", "u"), ("y", "2", None, None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>'.encode("latin-1"))
    (tmp_path / "b.xml").write_bytes("<a>漢</a>".encode("utf-16"))
    docs, nodes = read_xml(spark, str(tmp_path))
    assert docs.count() == 2
    assert {r.content for r in nodes.filter("kind = 'text'").collect()} == {"é", "漢"}


def test_decode(spark):
    rows = [("<a>é</a>".encode("utf-8-sig"),), ("<a/>".encode("utf-16"),), ('<?xml version="1.0" encoding="ISO-8859-1"?>é'.encode("latin-1"),), (b"\xff\xff",), ('<?xml version="1.0" encoding="nonsense"?>'.encode(),), (None,)]
    got = [r.d for r in spark.createDataFrame(rows, "c binary").coalesce(1).select(encoding.decode(F.col("c")).alias("d")).collect()]
    assert [(d.text, d.encoding) for d in got[:2]] == [("<a>é</a>", "UTF-8"), ("<a/>", "UTF-16LE")]
    assert got[2].text.endswith("é") and got[3].error and got[4].error and got[5].text is None


def paths(spark, text):
    return [r.path for r in html(spark, text).filter("kind = 'element'").orderBy("pre").collect()]


def test_html_structure(spark):
    assert paths(spark, "") == ["/html", "/html/body"]
    assert paths(spark, "<title>t</title><p>a<p>b") == ["/html", "/html/head", "/html/head/title", "/html/body", "/html/body/p", "/html/body/p"]
    assert paths(spark, "<ul><li>1<li>2<ul><li>3</ul><li>4</ul>")[2:] == ["/html/body/ul"] + ["/html/body/ul/li"] * 2 + ["/html/body/ul/li/ul", "/html/body/ul/li/ul/li", "/html/body/ul/li"]
    assert paths(spark, "<table><tr><td>1<td>2<tr><td>3</table>x")[2:] == ["/html/body/table", "/html/body/table/tr", "/html/body/table/tr/td", "/html/body/table/tr/td", "/html/body/table/tr", "/html/body/table/tr/td"]
    assert paths(spark, "<dl><dt>a<dd>b<dt>c</dl>")[3:] == ["/html/body/dl/dt", "/html/body/dl/dd", "/html/body/dl/dt"]
    assert paths(spark, "<p>a<br>b</p></p><img></div>")[2:] == ["/html/body/p", "/html/body/p/br", "/html/body/p", "/html/body/img"]
    assert paths(spark, "<select><option>1<option>2</select>")[2:] == ["/html/body/select", "/html/body/select/option", "/html/body/select/option"]


def test_html_text_and_attributes(spark):
    rows = html(spark, '<!DOCTYPE HTML><!-- c --><html lang=en><body class="a b" CLASS=z hidden>&lt;&eacute;&#x41;&notit;<script>"</p>" && 1 < 2</script>').orderBy("pre").collect()
    body = next(r for r in rows if r.name == "body")
    assert [(a.name, a.value) for a in body.attrs] == [("class", "a b"), ("hidden", "")]
    texts = [r.content for r in rows if r.kind == "text"]
    assert texts == ["<éA¬it;", '"</p>" && 1 < 2']
    assert rows[1].kind == "doctype" and rows[1].name == "html" and rows[2].kind == "comment"


def test_events_in_order(spark):
    nodes = xml(spark, "<a><b>x</b> <!--c--><?p d?><![CDATA[y]]></a>")
    got = [(r.event, r.name or r.value) for r in events(nodes).orderBy("at", "turn", "close").collect()]
    assert got == [("start_document", None), ("start_element", "a"), ("start_element", "b"), ("characters", "x"), ("end_element", "b"), ("whitespace", " "), ("comment", "c"), ("processing_instruction", "p"), ("cdata", "y"), ("end_element", "a"), ("end_document", None)]


def test_doctypes_come_back(spark):
    strict = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "http://www.w3.org/x.dtd" [<!ENTITY e "a]>b"><!-- ]> --><?p ]>?>]>'
    texts = [strict + "<html>&e;</html>", "<!DOCTYPE a SYSTEM 'say \"x\"'><a/>", "<!DOCTYPE a><a/>", '<!DOCTYPE a [<!ELEMENT a ANY>]><a/>', "<!DOCTYPE a [<!ENTITY e 'é'><!ENTITY f '漢'>]><a>é&e;</a>"]
    back = dict(serialize.to_xml(xml(spark, *texts), declaration=False).collect())
    for k, t in enumerate(texts):
        assert back[k].split(">\n<")[0] + ">" == t[: t.rindex(">", 0, t.rindex("<html" if k == 0 else "<a") + 1) + 1]
    assert back[0].endswith("<html>a]&gt;b</html>\n")
    nodes = xml(spark, *texts)
    assert nodes.filter("kind in ('comment', 'pi')").count() == 0
    raw = [x.encode("utf-16") for x in texts] + ["<?xml version='1.0' encoding='ISO-8859-1'?><!DOCTYPE a [<!ENTITY e 'é'>]><a>&e;</a>".encode("latin-1")]
    from thicket.sources.xml import parse_xml

    bytes_ = parse_xml(spark.createDataFrame(list(enumerate(raw)), "doc_id long, text binary")).filter("kind = 'doctype'")
    want = nodes.filter("kind = 'doctype'").select("doc_id", "content").collect() + [(5, "[<!ENTITY e 'é'>]")]
    assert sorted(tuple(r) for r in bytes_.select("doc_id", "content").collect()) == sorted(tuple(r) for r in want)
    few = '<!DOCTYPE a [<!ENTITY x "1"><!ENTITY y "&x; ]> &x;"><!ENTITY z "&y;&y;">]><a>&x;</a>'
    assert xml(spark, few, options=ParseOptions(max_entity_expansions=1)).first().error is None
    page = html(spark, '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN"\n"http://www.w3.org/TR/html4/strict.dtd"><p>x')
    assert serialize.to_html(page).first().text.startswith('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN"\n"http://www.w3.org/TR/html4/strict.dtd"><html>')


def test_deep_documents_stay_linear(spark):
    import time

    from thicket.schema import MOST_PATH
    from thicket.sources.html import MOST_OPEN

    took = []
    for n in (20_000, 80_000):
        began = time.time()
        rows = html(spark, "<div>" * n + "end").select("kind", "depth", "path", "content", "error").collect()
        took.append(time.time() - began)
        assert rows[0].error == "elements nested too deep" and max(r.depth for r in rows) == MOST_OPEN + 1
        assert sum(r.kind == "element" for r in rows) == n + 2 and [r.content for r in rows if r.kind == "text"] == ["end"]
        assert max(len(r.path or "") for r in rows) <= MOST_PATH
    assert took[1] < 8 * took[0] + 1
    deep = xml(spark, "<a>" * 5000 + "</a>" * 5000, options=ParseOptions(max_depth=10_000)).collect()
    assert [r.post - r.pre for r in deep] == list(range(5000, -1, -1)) and [r.depth for r in deep] == list(range(5001))
    assert deep[1000].path is not None and deep[2000].path is None
    assert html(spark, "<p>" + "<b x=1>" * 3).first().error is None


def test_references_without_an_end_are_text_where_options_say_so(spark):
    from thicket.sources.html import parse_html

    page = "<title>a&amp</title><script>1&amp2</script><!-- &lt --><h1 id='x&lt'>b &amp; c&amp d &nope; &#38 e&#38;&copy</h1>"
    docs = spark.createDataFrame([(0, page)], "page_id long, html string")

    def shown(options):
        rows = parse_html(docs, options=options).filter("kind in ('text', 'comment')").orderBy("pre").collect()
        return [r.content for r in rows]

    assert shown(ParseOptions(ended_references=True)) == ["a&amp", "1&amp2", " &lt ", "b & c&amp d &nope; &#38 e&&copy"]
    assert shown(None) == ["a&", "1&amp2", " &lt ", "b & c& d &nope; & e&©"]


def test_string_values_of_the_parser_are_those_of_joins(spark):
    from thicket.operators.edit import remove
    from thicket.operators.selection import string_value, valued
    from thicket.schema import ARROW, VALUE
    from thicket.sources.xml import parse_xml

    r = random.Random(5)
    texts = [random_document(r) for _ in range(40)] + ["<a>x<![CDATA[<y>]]><b/>&amp;<!--c-->z</a>", "<broken>", "<a/>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, nodes = parse_xml(docs), valued(parse_xml(docs, columns=[*ARROW.names, VALUE]))
    assert VALUE in nodes.columns and VALUE not in plain.columns
    values = lambda t: sorted(tuple(x) for x in string_value(t, t).select("doc_id", "pre", "value").collect())
    assert values(nodes) == values(plain)
    assert "Join" not in string_value(nodes, nodes)._jdf.queryExecution().executedPlan().toString()
    assert VALUE not in remove(nodes, nodes.filter("name = 'b'")).columns
    # One over the bound: the table goes without the column, and joins give the values.
    long = spark.createDataFrame([(0, f"<a><b>{'x' * 5000}</b><c>y</c></a>")], "doc_id long, text string")
    nodes = valued(parse_xml(long, columns=[*ARROW.names, VALUE]))
    assert VALUE not in nodes.columns
    assert [len(x[2]) for x in values(nodes)] == [5001, 5001, 5000, 5000, 1, 1]
