"""Axes and predicates against brute force; selectors, edits, links."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import html, pres, xml
from tests.test_parse import random_document
from thicket.operators import compare, css, edit, links
from thicket.operators.axes import REVERSE, in_scope_namespaces, step
from thicket.operators.selection import Selection, attr, string_value
from thicket.sinks import serialize


@pytest.fixture(scope="module")
def forest(spark):
    return xml(spark, *[random_document(random.Random(100 + i)) for i in range(25)]).cache()


def brute(rows, axis, c):
    up = {r.pre: r.parent for r in rows}

    def above(p):
        out = []
        while up[p] is not None:
            p = up[p]
            out.append(p)
        return out

    below = [r.pre for r in rows if c.pre in above(r.pre)]
    return {
        "child": [r.pre for r in rows if r.parent == c.pre],
        "parent": [c.parent] if c.parent is not None else [],
        "self": [c.pre],
        "descendant": below,
        "descendant-or-self": [c.pre, *below],
        "ancestor": above(c.pre),
        "ancestor-or-self": [c.pre, *above(c.pre)],
        "following-sibling": [r.pre for r in rows if r.parent == c.parent and r.parent is not None and r.pre > c.pre],
        "preceding-sibling": [r.pre for r in rows if r.parent == c.parent and r.parent is not None and r.pre < c.pre],
        "following": [r.pre for r in rows if r.pre > c.pre and r.pre not in below],
        "preceding": [r.pre for r in rows if r.pre < c.pre and r.pre not in above(c.pre)],
    }[axis]


@pytest.mark.parametrize("axis", ["child", "parent", "self", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding"])
def test_axis(forest, axis):
    docs: dict[int, list] = {}
    for r in forest.collect():
        docs.setdefault(r.doc_id, []).append(r)
    want = sorted((d, c.pre, t) for d, rows in docs.items() for c in rows for t in brute(rows, axis, c))
    context = forest
    got = sorted((r.doc_id, r.ctx, r.pre) for r in step(context, forest, axis, F.lit(True)).collect())
    assert got == want
    # The second of the axis, from every node, with the axis's own order.
    second = Selection(forest, forest.withColumn("ctx", F.col("pre")), False).step(axis, kind=None).nth(2).rows
    expected = sorted((d, c.pre, sorted(brute(rows, axis, c), reverse=axis in REVERSE)[1]) for d, rows in docs.items() for c in rows if len(brute(rows, axis, c)) > 1)
    assert sorted((r.doc_id, r.ctx, r.pre) for r in second.collect()) == expected


def test_string_value_and_paths(forest):
    rows = forest.collect()
    want = {(r.doc_id, r.pre): "".join(t.content for t in sorted(rows, key=lambda x: x.pre) if t.doc_id == r.doc_id and t.kind in ("text", "cdata") and r.pre < t.pre <= r.post) for r in rows if r.kind == "element"}
    assert {(r.doc_id, r.pre): r.value for r in string_value(forest.filter("kind = 'element'"), forest).collect()} == want
    some = next(r.path for r in rows if r.depth == 3 and r.kind == "element")
    a, b, c = some[1:].split("/")
    assert pres(Selection(forest).at_path(some).nodes()) == pres(Selection(forest).child(a).child(b).child(c).nodes())


def test_agrees_with_the_built_in_paths(spark):
    texts = ["<a><b i='1'>x</b><b>y<c/></b><d><b>z</b></d></a>", "<a/>"]
    nodes = xml(spark, *texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    built = {r.doc_id: r.x for r in df.select("doc_id", F.expr("xpath(text, '//b[1]/text()')").alias("x")).collect()}
    ours = Selection(nodes).descendant("b")
    ours = Selection(nodes, ours.rows.withColumn("ctx", F.col("parent")), False, "child").nth(1).text().nodes()
    got: dict[int, list] = {0: [], 1: []}
    for r in ours.orderBy("pre").collect():
        got[r.doc_id].append(r.content)
    assert got == built


def test_having_without_and_sets(spark):
    nodes = xml(spark, '<r><a><x k="1"/></a><a/><b><a><y><x k="2"/></y></a></b></r>')
    s = Selection(nodes).descendant("a")
    names = lambda sel: [r.pre for r in sel.nodes().orderBy("pre").collect()]
    assert len(names(s)) == 3
    assert names(s.having(lambda p: p.child("x"))) == [2]
    assert names(s.having(lambda p: p.descendant("x"))) == [2, 6]
    assert names(s.having(lambda p: p.descendant("x").having_attr("k", lambda v: v == "2"))) == [6]
    assert names(s.without(lambda p: p.descendant("x"))) == [4]
    assert names(s.having(lambda p: p.parent("b"))) == [6]
    assert names(s.intersect(s.where("pre = 4"))) == [4] and names(s.minus(s.where("pre = 4"))) == [2, 6]
    assert names(Selection(nodes).descendant("x").ancestor("a").union(s.where("pre = 4"))) == [2, 4, 6]
    assert [r.pre for r in Selection(nodes).descendant("a").nth_of_all(2).rows.collect()] == [4]
    assert Selection(nodes).descendant("none").fold().first().asDict() | {"min": 0, "max": 0} == {"doc_id": 0, "n": 0, "sum": 0.0, "min": 0, "max": 0, "first": "", "joined": ""}


def test_namespaces_language_and_ids(spark):
    nodes = xml(spark, '<a xmlns="d" xmlns:p="u" xml:lang="en-GB" id="one"><b xmlns="" xmlns:p="v"/><c xml:lang="de" id="two"><e/></c></a>')
    got = {(r.pre, r.prefix): r.namespace for r in in_scope_namespaces(nodes.filter("kind = 'element'"), nodes).collect()}
    assert got == {(1, ""): "d", (1, "p"): "u", (2, "p"): "v", (3, ""): "d", (3, "p"): "u", (4, ""): "d", (4, "p"): "u"}
    el = nodes.filter("kind = 'element'")
    assert [r.pre for r in compare.language(el, nodes, "EN").orderBy("pre").collect()] == [1, 2]
    assert [r.pre for r in compare.language(el, nodes, "de").orderBy("pre").collect()] == [3, 4]
    assert [r.pre for r in compare.by_id(spark.createDataFrame([(0, " two x")], "doc_id long, value string"), nodes).collect()] == [3]
    assert Selection(nodes).descendant("b", namespace="d").nodes().count() == 0 and Selection(nodes).descendant("c", namespace="d").nodes().count() == 1


def test_the_last_of_equal_ids_counts(spark):
    nodes = xml(spark, '<a id="x"><b id="x"/><c id="y"/></a>')
    assert [r.pre for r in compare.by_id(spark.createDataFrame([(0, "x")], "doc_id long, value string"), nodes).collect()] == [2]


def test_comparisons(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], "doc_id long, value string")
    b = spark.createDataFrame([(1, "y"), (2, "x"), (4, "x")], "doc_id long, value string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(compare.any_equal(a, b)) == [1, 2] and ids(compare.any_different(a, b)) == [1]
    n = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, float("nan")), (3, 2.0)], "doc_id long, number double")
    m = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 9.0), (3, 2.0)], "doc_id long, number double")
    assert ids(compare.any_less(n, m)) == [1] and ids(compare.any_less(n, m, or_equal=True)) == [1, 3]


def test_selectors(spark):
    nodes = html(spark, '<div id=m class="a b"><p class=b>1<p lang=en-GB>2<span></span><p title="Foo Bar"><!--c--><b>3</b></div><p>4')
    at = lambda df: [(r.name, r.pre) for r in df.orderBy("pre").collect()]
    n = lambda e: len(at(css.select(nodes, e)))
    assert n(css.id_("m")) == 1 and n(css.class_("b")) == 2 and n(css.tag("P") & css.class_("b")) == 1
    assert n(css.has("title")) == 1 and n(css.has("title", "=", "foo bar", ignore_case=True)) == 1 and n(css.has("title", "~=", "Bar")) == 1
    assert n(css.has("lang", "|=", "en")) == 1 and n(css.has("title", "^=", "Foo")) == 1 and n(css.has("title", "$=", "Bar")) == 1 and n(css.has("title", "*=", "o B")) == 1
    assert n(css.has("title", "^=", "")) == 0
    assert n(css.tag("p") & css.first_child()) == 1 and n(css.tag("p") & css.last_child()) == 2 and n(css.tag("b") & css.only_child()) == 1
    assert n(css.tag("p") & css.nth_child(2, 0)) == 2 and n(css.tag("p") & css.nth_last_child(0, 1)) == 2 and n(css.tag("p") & css.nth_child(-1, 2)) == 3
    assert n(css.tag("p") & css.not_(css.class_("b"))) == 3
    div = css.select(nodes, css.tag("div"))
    assert len(at(css.combine(div, " ", nodes, css.tag("b")))) == 1 and len(at(css.combine(div, ">", nodes, css.tag("b")))) == 0
    assert len(at(css.combine(div, "+", nodes, css.tag("p")))) == 1
    assert len(at(css.combine(css.select(nodes, css.class_("b")), "~", nodes, css.tag("p")))) == 3
    assert at(css.empty(css.select(nodes, css.tag("span")), nodes))[0][0] == "span"
    assert len(at(css.any_of(css.select(nodes, css.tag("p")), css.select(nodes, css.class_("b"))))) == 5
    assert len(at(css.first(css.select(nodes, css.tag("p"))))) == 1


def text_of(nodes):
    return {r.doc_id: r.text for r in serialize.to_xml(nodes, declaration=False).collect()}[0].strip()


def test_edits(spark):
    nodes = xml(spark, '<a><b x="1">t<c/></b><b/>u</a>')
    b = Selection(nodes).descendant("b")
    assert text_of(edit.remove(nodes, b.nth(1).nodes())) == "<a><b/>u</a>"
    assert text_of(edit.rename(nodes, b.nodes(), "z")) == '<a><z x="1">t<c/></z><z/>u</a>'
    assert text_of(edit.set_attribute(nodes, b.nodes(), "x", "2")) == '<a><b x="2">t<c/></b><b x="2"/>u</a>'
    assert text_of(edit.remove_attribute(nodes, b.nodes(), "x")) == "<a><b>t<c/></b><b/>u</a>"
    assert text_of(edit.set_text(nodes, b.nodes(), "<n>")) == '<a><b x="1">&lt;n&gt;</b><b>&lt;n&gt;</b>u</a>'
    for where, want in (("first", "<a><n/>"), ("last", "u<n/></a>")):
        assert want in text_of(edit.insert(nodes, Selection(nodes).child("a").nodes(), where, name="n"))
    assert text_of(edit.insert(nodes, b.nth(2).nodes(), "before", name="n")) == '<a><b x="1">t<c/></b><n/><b/>u</a>'
    assert text_of(edit.insert(nodes, b.nth(1).nodes(), "after", kind="comment", content="c")) == '<a><b x="1">t<c/></b><!--c--><b/>u</a>'
    twice = edit.clone(nodes, b.nth(1).nodes())
    assert text_of(twice) == '<a><b x="1">t<c/></b><b x="1">t<c/></b><b/>u</a>'
    assert [(r.pre, r.post, r.parent, r.path) for r in twice.filter("name = 'c'").orderBy("pre").collect()] == [(4, 4, 2, "/a/b/c"), (7, 7, 5, "/a/b/c")]


def test_include(spark):
    xi = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
    nodes = xml(spark, f'<a {xi}><xi:include href="r"/><xi:include href="t" parse="text"/><xi:include href="no"><xi:fallback><f/>g</xi:fallback></xi:include></a>', f'<a {xi}><xi:include href="loop"/></a>', f'<a {xi}><xi:include href="gone"/></a>')
    parsed = xml(spark, f'<r {xi}><xi:include href="s#x"/></r>', "<s>!</s>", f'<l {xi}><xi:include href="loop"/></l>')
    names = spark.createDataFrame([(0, "r"), (1, "s"), (2, "loop")], "doc_id long, href string")
    resources = parsed.join(names, "doc_id").drop("doc_id")
    out, errors = links.include(nodes, resources, spark.createDataFrame([("t", "<text>")], "href string, text string"))
    texts = {r.doc_id: r.text.strip() for r in serialize.to_xml(out, declaration=False).collect()}
    assert texts[0] == f"<a {xi}><r {xi}><s>!</s></r>&lt;text&gt;<f/>g</a>"
    assert {(r.doc_id, r.message) for r in errors.collect()} == {(1, "circular inclusion"), (2, "resource not found")}


def test_catalog(spark):
    catalog = xml(spark, """<catalog><system systemId="http://a/x.dtd" uri="exact"/><rewriteSystem systemIdStartString="http://a/" rewritePrefix="short/"/><rewriteSystem systemIdStartString="http://a/b/" rewritePrefix="long/"/>
      <systemSuffix systemIdSuffix=".ent" uri="suffix"/><delegateSystem systemIdStartString="urn:" catalog="delegate"/><public publicId="-//P  Q" uri="pub"/><delegatePublic publicIdStartString="-//" catalog="pdel"/><uri name="u" uri="v"/><other/></catalog>""")
    entries = links.catalog_entries(catalog)
    assert entries.count() == 8
    rows = [("http://a/x.dtd", None), ("http://a/b/c", None), ("http://a/q", None), ("http://z/y.ent", None), ("urn:x", None), ("nope", "-//P Q"), (None, " -//other"), ("nope", None)]
    got = [r.resolved for r in links.resolve_external(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, system_id string, public_id string"), entries).orderBy("i").collect()]
    assert got == ["exact", "long/c", "short/q", "suffix", "delegate", "pub", "pdel", None]
    assert links.resolve(spark.createDataFrame([("u",)], "x string"), entries, "uri", "x").first().resolved == "v"


def test_attr_ignores_declarations(spark):
    row = xml(spark, '<a xmlns:q="u" q:q="1" r="2"/>').filter("kind = 'element'").select(attr("q").alias("q"), attr("r").alias("r"), attr("s").alias("s")).first()
    assert tuple(row) == ("1", "2", None)


def test_includes_deeper_than_followed_are_errors(spark):
    xi = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
    docs = xml(spark, f'<a {xi}><xi:include href="0"/></a>')
    chain = xml(spark, *[f'<r {xi}><xi:include href="{k + 1}"/></r>' for k in range(4)], "<end/>").withColumn("href", F.col("doc_id").cast("string")).drop("doc_id")
    nodes, errors = links.include(docs, chain, max_depth=3)
    assert [r.message for r in errors.collect()] == ["inclusions nested over 3 deep"] and nodes.filter("name = 'include'").count() == 1
    nodes, errors = links.include(docs, chain)
    assert errors.count() == 0 and nodes.filter("name = 'end'").count() == 1


def test_large_catalogs_meet_identifiers_in_equi_joins(spark):
    rows = [(k, "rewriteURI", f"http://h{k}/", f"l{k}:") for k in range(300)] + [(500, "uri", "http://h7/x", "seven"), (501, "uriSuffix", "/end", "tail"), (502, "delegateURI", "ftp://", "d")]
    entries = spark.createDataFrame(rows, "ord int, kind string, match string, target string")
    asked = spark.createDataFrame([("http://h7/x",), ("http://h8/x",), ("z/end",), ("ftp://q",), ("none",), (None,)], "u string")
    out = links.resolve(asked, entries, "uri", "u")
    assert {r.u: r.resolved for r in out.collect()} == {"http://h7/x": "seven", "http://h8/x": "l8:x", "z/end": "tail", "ftp://q": "d", "none": None, None: None}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_replace_puts_one_node_in_place_of_a_subtree(spark):
    nodes = xml(spark, '<a><b x="1">t<c/></b><d/>u</a>')
    assert text_of(edit.replace(nodes, Selection(nodes).descendant("b").nodes(), name="n")) == "<a><n/><d/>u</a>"
    assert text_of(edit.replace(nodes, Selection(nodes).descendant("d").nodes(), kind="text", content="w")) == '<a><b x="1">t<c/></b>wu</a>'


def test_canonical_subtree_keeps_what_is_in_force(spark):
    nodes = xml(spark, '<a xmlns="d" xmlns:p="u" xml:lang="en" y="1"><p:b z="2" a="1"><c xmlns:p="u"/></p:b><!--x--></a>')
    one = lambda **k: serialize.canonical(nodes, roots=Selection(nodes).descendant("b").nodes(), **k).first().text
    assert one() == '<p:b xmlns="d" xmlns:p="u" a="1" z="2" xml:lang="en"><c></c></p:b>'
    assert one(exclusive=True) == '<p:b xmlns:p="u" a="1" z="2"><c xmlns="d"></c></p:b>'


def test_next_catalogs_follow_in_turn(spark):
    rows = [("m", 1, "nextCatalog", None, "x"), ("m", 2, "uri", "k", "own"), ("m", 3, "nextCatalog", None, "y"), ("x", 1, "uri", "k", "later"), ("x", 2, "uriSuffix", "q", "x-tail"), ("x", 3, "nextCatalog", None, "m"), ("x", 4, "nextCatalog", None, "gone"), ("y", 1, "uri", "q", "y-exact"), ("z", 1, "uri", "zz", "never")]
    entries = links.chained(spark.createDataFrame(rows, "uri string, ord int, kind string, match string, target string"), "m")
    out = links.resolve(spark.createDataFrame([("k",), ("q",), ("zz",)], "u string"), entries, "uri", "u")
    assert {r.u: r.resolved for r in out.collect()} == {"k": "own", "q": "x-tail", "zz": None}


def test_edits_by_conditions_and_by_nodes_are_the_same(spark):
    from pyspark.sql import functions as F

    from thicket.operators import edit

    texts = ["<a><b n='1'><b><c/>x</b>y</b><c>z<b n='2'/></c><!--k--><b/></a>", "<b><a/></b>", "<a>" + "<d><b n='1'><e/></b><b>t</b></d>" * 3000 + "</a>", "<a", "<?b?><a><?b x?><c/></a>"]
    nodes = xml(spark, *texts)
    is_b, marked = (F.col("kind") == "element") & (F.col("name") == "b"), F.exists("attrs", lambda a: a["name"] == "n")
    rows = lambda df: sorted(map(str, df.select(*[c for c in nodes.columns]).collect()))
    removed = edit.remove(nodes, nodes.filter(is_b & marked))
    assert rows(edit.remove(nodes, is_b & marked)) == rows(removed)
    want = edit.rename(removed, removed.filter(is_b), "q")
    later = edit.rename(edit.remove(nodes, is_b & marked, numbered=False), is_b, "q", numbered=False)
    assert rows(edit.renumber(later)) == rows(want)
    few = edit.renumber(later, ["doc_id", "path", "pre"])
    assert few.columns == ["doc_id", "pre", "path"] and sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, want.select(*few.columns).collect()), key=str)
