from pyspark.sql import functions as F

from tests.helpers import *  # noqa: F403
from thicket.operators.paths import xpath
from thicket.sinks import serialize
from thicket.sources import reader
from thicket.sources.declarations import declarations, dtd_declarations, identifiers, with_defaults
from thicket.sources.events import events
from thicket.sources.html import parse_html
from thicket.sources.reader import first_events, register_reader
from thicket.sources.xml import ParseOptions, parse_xml

DTD = "<!DOCTYPE a [<!ATTLIST b key ID #IMPLIED key CDATA 'x' kind (one|two) 'two' fixed CDATA #FIXED 'f'><!ATTLIST x:c ref ID #REQUIRED>]>"


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_declarations_and_ids(spark):
    xml = DTD + "<a id='t'><b key='k'/><b key=' k '/><x:c xmlns:x='u' ref='r'/><b id='k2' kind='one'/></a>"
    nodes = parse_xml(docs_of(spark, xml, "<a><b key='k'/></a>", "<a", None, ""))
    got = {tuple(r)[1:] for r in declarations(nodes).collect()}
    assert got == {("b", "key", "ID", None, False), ("b", "kind", "(one|two)", "two", False), ("b", "fixed", "CDATA", "f", True), ("x:c", "ref", "ID", None, True)}
    assert {r.doc_id for r in declarations(nodes).collect()} == {0}
    assert sorted((r.doc_id, r.id) for r in identifiers(nodes).collect()) == [(0, "k"), (0, "k"), (0, "k2"), (0, "r"), (0, "t")]
    # Of two elements with one id the last counts; without a declaration, key is no id.
    assert [(r.doc_id, r.name, r.elem_ord) for r in xpath(nodes, "id('k r')").orderBy("pre").collect()] == [(0, "b", 2), (0, "c", 3)]
    assert [r.kind for r in nodes.filter("name = 'b' and doc_id = 0").orderBy("pre").select(F.filter("attrs", lambda a: a["name"] == "kind")[0]["value"].alias("kind")).collect()] == ["two", "two", "one"]
    assert identifiers(nodes.limit(0)).count() == 0


def test_defaults_from_elsewhere(spark):
    nodes = parse_xml(docs_of(spark, "<a><b kind='own'/><b/>t</a>", "<a><b/></a>"))
    dtds = spark.createDataFrame([(0, "<!ATTLIST b kind CDATA 'd' xml:lang CDATA 'en' none CDATA #IMPLIED><!ATTLIST b kind CDATA 'later'>"), (1, None), (2, "<!ATTLIST b z CDATA 'z'>")], "doc_id long, text string")
    full = with_defaults(nodes, dtd_declarations(dtds))
    assert full.columns == nodes.columns and full.count() == nodes.count()
    got = [[(a.name, a.value, a.prefix) for a in r.attrs] for r in full.filter("name = 'b'").orderBy("doc_id", "pre").collect()]
    assert got == [[("kind", "own", None), ("lang", "en", "xml")], [("kind", "d", None), ("lang", "en", "xml")], []]
    assert full.filter("kind = 'text' and attrs is not null").count() == 0
    # The first declarations before an error in a subset count.
    broken = spark.createDataFrame([(0, "<!ATTLIST b q CDATA 'q'><!ATTLIST b"), (0, "")], "doc_id long, text string")
    assert [(r.attribute, r.default) for r in dtd_declarations(broken).collect()] == [("q", "q")]


def test_reader_gives_the_events(spark, monkeypatch):
    xml = DTD.replace("<!ATTLIST", "<!-- no --><?no no?><!ATTLIST", 1) + "<!--c--><?p d?><a xmlns='u' xmlns:y='v'> <b y:k='1'>x&amp;y<![CDATA[<z>]]>" + "long " * 60 + "</b>\n<y:c/></a><!--end-->"
    docs = docs_of(spark, xml, "<r/>")
    rows = events(parse_xml(docs)).orderBy("doc_id", "at", "turn", "close").collect()
    want = [(r.doc_id, r.event, r.depth, r.name, r.prefix, r.namespace, r.attrs or None, None if r.event == "doctype" else r.value) for r in rows]
    for size in (1, 7, reader.SLICE):
        monkeypatch.setattr(reader, "SLICE", size)
        pulled = [(k, e) for k, text in enumerate([xml, "<r/>"]) for e in reader.pull(text, 1000, ParseOptions())]
        assert [(k, e[1], e[2], e[3], e[4], e[5], [*e[6]] if e[6] else None, e[7]) for k, e in pulled] == [(*w[:6], [tuple(a) for a in w[6]] if w[6] else None, w[7]) for w in want]
    got = first_events(docs, 1000).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.event, r.depth, r.name, r.prefix, r.namespace, r.attrs or None, r.value) for r in got] == want
    assert [r.event for r in first_events(docs, 2).orderBy("doc_id", "seq").collect()] == ["start_document", "doctype", "start_document", "start_element"]


def test_reader_stops_early(spark):
    # What is broken, deep or huge after the events that were asked for is never seen.
    docs = docs_of(spark, "<a><b/>" + "<c>" * 100_000, "<a><b", None, "", "x")
    first = {(r.doc_id, r.seq): r.event for r in first_events(docs, 3).collect()}
    assert [first[0, k] for k in range(3)] == ["start_document", "start_element", "start_element"]
    assert [first[1, k] for k in range(3)] == ["start_document", "start_element", "error"]
    assert [first[k, 1] for k in (2, 3, 4)] == ["error"] * 3
    deep = first_events(docs.filter("doc_id = 0"), 10**6).orderBy(F.desc("seq")).first()
    assert deep.event == "error" and "deep" in deep.value and deep.seq < 300
    register_reader(spark)
    docs.createOrReplaceTempView("pulled_docs")
    rows = spark.sql("select doc_id, e.event, e.attrs from pulled_docs, lateral xml_events(text, 2) e where doc_id < 2 and e.seq = 1").collect()
    assert [r.event for r in rows] == ["start_element"] * 2 and rows[0].attrs == []


def test_html4(spark):
    def out(html):
        docs = spark.createDataFrame([(0, html)], "page_id long, html string")
        return serialize.to_html4(parse_html(docs)).first().text

    assert "<input checked disabled name=\"a&quot;b'\">" in out("<p><input checked=checked disabled='disabled' name='a&quot;b&#39;'></p>")
    assert "<a href=\"/x%20y?a&amp;b\" title='say \"so\"'>é&lt;</a>" in out("<meta charset=UTF-8><a href='/x y?a&amp;b' title='say \"so\"'>é&lt;</a>")
    assert '<i title="&Ouml;&copy;漢">&nbsp;&eacute;</i>' in out("<i title='Ö©漢'>\xa0é</i>")
    assert "é" in out("<meta http-equiv=Content-Type content='text/html; charset=utf-8'><b>é</b>")
    assert "<script>1 < 2 && 'é'</script>" in out("<script>1 < 2 && 'é'</script>")


def test_reader_stops_within_its_slice():
    import sys

    from thicket.sources.reader import pull
    from thicket.sources.xml import ParseOptions

    begun = []
    sys.setprofile(lambda frame, event, arg: begun.append(1) if event == "call" and frame.f_code.co_name == "start" and frame.f_code.co_filename.endswith("reader.py") else None)
    try:
        found = pull("<a>" + "<b/>" * 100 + "</a>", 3, ParseOptions())
    finally:
        sys.setprofile(None)
    assert [e[1] for e in found] == ["start_document", "start_element", "start_element"]
    assert len(begun) == 2


def test_declared_ids_read_a_bucketed_table(spark):
    from thicket import catalog

    plan = catalog.QUERIES["declared_ids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
