"""Schemas from their own documents, against documents that do and don't fit."""

import pytest

from tests.helpers import xml
from thicket.operators.content import el, seq, times
from thicket.operators.grammar import Attribute, Grammar, Type, check_grammar, element_types
from thicket.operators.schemas import SchemaError, check_schematron, relax_ng, schematron, xml_schema

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def wrong(spark, grammar, *texts):
    """Numbers of the documents that don't fit, and the rules they break."""
    found = check_grammar(xml(spark, *texts), grammar).collect()
    return sorted({r.doc_id for r in found}), sorted({r.rule for r in found})


def test_one_name_has_two_types(spark):
    leaf = lambda value: Type("i", text=lambda v: v == value)
    g = Grammar({"a": leaf("x"), "b": leaf("y"), "r": Type("r", seq(times(el("a")), times(el("b"), 1), times(el("s"), 0, 1))), "s": Type("r", times(el("b"), 2, 2), attributes=[Attribute("k", required=True)])}, ["r"])
    texts = ["<r><i>x</i><i>y</i></r>", "<r><i>y</i></r>", "<r><i>y</i><i>x</i></r>", "<r/>", "<r><i>z</i></r>", "<r><i>y</i><r k='1'><i>y</i><i>y</i></r></r>", "<r><i>y</i><r><i>y</i></r></r>", "<r k='1'><i>y</i><i>y</i></r>", "<q/>"]
    assert wrong(spark, g, *texts) == ([2, 3, 4, 6, 7, 8], ["attributes-or-text", "content", "root", "undeclared-element"])
    types = {(r.doc_id, r.pre): r.types for r in element_types(xml(spark, texts[0]), g).collect()}
    assert types == {(0, 1): [2], (0, 2): [0], (0, 4): [1]}


def test_xml_schema(spark):
    main = f"""<xs:schema {XS} xmlns:t="urn:t" xmlns:o="urn:o" targetNamespace="urn:t" elementFormDefault="qualified">
    <xs:include schemaLocation="part"/><xs:import namespace="urn:o" schemaLocation="other"/>
    <xs:element name="doc"><xs:complexType><xs:sequence>
      <xs:element name="v" type="t:code" nillable="true"/>
      <xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element name="n" type="xs:int"/><xs:element name="l" type="t:days"/></xs:choice>
      <xs:element ref="t:tree" minOccurs="0"/><xs:element ref="o:far" minOccurs="0" maxOccurs="2"/><xs:element name="price" type="t:money" minOccurs="0"/><xs:element name="big" type="t:larger" minOccurs="0"/>
      <xs:element name="w" minOccurs="0"><xs:complexType mixed="true"><xs:sequence><xs:any minOccurs="0"/></xs:sequence><xs:anyAttribute/></xs:complexType></xs:element>
    </xs:sequence><xs:attribute name="id" type="xs:NMTOKEN" use="required"/><xs:attribute name="u" fixed="1"/></xs:complexType></xs:element></xs:schema>"""
    part = f"""<xs:schema {XS} elementFormDefault="qualified"><xs:include schemaLocation="part"/>
    <xs:simpleType name="code"><xs:union memberTypes="xs:positiveInteger"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="a"/><xs:enumeration value="b"/></xs:restriction></xs:simpleType></xs:union></xs:simpleType>
    <xs:simpleType name="days"><xs:list itemType="xs:date"/></xs:simpleType>
    <xs:complexType name="money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="cur" use="required"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="[A-Z]{{3}}"/></xs:restriction></xs:simpleType></xs:attribute></xs:extension></xs:simpleContent></xs:complexType>
    <xs:complexType name="small"><xs:sequence><xs:element name="x" type="xs:byte"/></xs:sequence><xs:attribute name="k"/></xs:complexType>
    <xs:complexType name="larger"><xs:complexContent><xs:extension base="small"><xs:sequence><xs:element name="x" type="xs:date" minOccurs="0"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
    <xs:element name="tree"><xs:complexType><xs:sequence><xs:element ref="tree" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""
    other = f'<xs:schema {XS} targetNamespace="urn:o"><xs:element name="far"><xs:complexType><xs:sequence><xs:element name="near" type="xs:boolean"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    g = xml_schema(main, {"part": part, "other": other})
    doc = lambda body, attrs="id='a'": f"<doc xmlns='urn:t' xmlns:o='urn:o' xmlns:xsi='http://www.w3.org/2001/XMLSchema-instance' {attrs}>{body}</doc>"
    good = [
        "<v>a</v>", "<v>7</v><n>1</n><l>2020-01-31 2021-02-01</l><n>-5</n>", "<v xsi:nil='true'/>", "<v>b</v><tree><tree/><tree><tree/></tree></tree>", "<v>b</v><o:far><near xmlns=''>true</near></o:far>", "<v>b</v><price cur='EUR'>1.5</price>",
        "<v>b</v><big k='1'><x>5</x><x>2020-01-01</x></big>", "<v>b</v><big><x>5</x></big>", "<v>b</v><w z='1'>text</w>",
    ]
    bad = [
        "<v>c</v>", "<v>0</v>", "", "<v>a</v><n>x</n>", "<v>a</v><l>2020-02-31</l>", "<v>a</v><tree>t</tree>", "<v>b</v><o:far><near>true</near></o:far>", "<v>b</v><price>1.5</price>", "<v>b</v><price cur='eur'>1</price>", "<v>b</v><big><x>2020-01-01</x><x>5</x></big>",
        "<v>b</v><o:far/>", "<n>1</n><v>a</v>", "<v xmlns=''>a</v>", "<v>a</v>text", "<v xsi:nil='true'>x</v>", "<v>b</v><big><x>300</x></big>",
    ]
    texts = [doc(b) for b in good + bad] + [doc("<v>a</v>", "id='a' u='2'"), doc("<v>a</v>", "id='a b'"), doc("<v>a</v>", ""), doc("<v>a</v>", "id='a' z='1'"), "<doc id='a'><v>a</v></doc>", "<tree xmlns='urn:t'/>"]
    assert wrong(spark, g, *texts)[0] == list(range(len(good), len(texts) - 1))


def test_relax_ng(spark):
    ns = 'xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"'
    base = f'<grammar {ns}><start><ref name="list"/></start><define name="list"><element name="list"><zeroOrMore><ref name="item"/></zeroOrMore></element></define><define name="item"><notAllowed/></define></grammar>'
    g = relax_ng(
        f"""<grammar {ns}><include href="base"><define name="item"><element name="item">
          <choice><attribute name="n"><data type="int"><param name="minInclusive">3</param></data></attribute><group><attribute name="t"/><element name="t"><text/></element></group><ref name="list"/></choice></element></define></include>
        <define name="list" combine="choice"><element name="bag"><interleave><element name="x"><empty/></element><optional><element name="y"><data type="token"/></element></optional><zeroOrMore><element name="z"><empty/></element></zeroOrMore></interleave></element></define>
        <define name="list" combine="choice"><element name="para"><mixed><zeroOrMore><element name="b"><text/></element></zeroOrMore></mixed></element></define></grammar>""",
        {"base": base},
    )
    good = ["<list/>", "<list><item n='3'/><item t=''><t>a</t></item><item><list/></item></list>", "<list><item><bag><z/><x/><z/><y>k</y></bag></item></list>", "<bag><x/></bag>", "<para>a<b>c</b>d</para>"]
    bad = ["<list><item n='2'/></list>", "<list><item n='3' t=''/></list>", "<list><item t=''/></list>", "<list><item><t>a</t></item></list>", "<bag><y>k</y></bag>", "<bag><x/><x/></bag>", "<item n='3'/>", "<list>text</list>", "<para><i/></para>", "<list><item/></list>"]
    assert wrong(spark, g, *good, *bad)[0] == list(range(len(good), len(good) + len(bad)))


@pytest.mark.parametrize(
    "read, text",
    [
        (xml_schema, "<a/>"), (xml_schema, "<a"), (xml_schema, f'<xs:schema {XS}><xs:include schemaLocation="gone"/></xs:schema>'), (xml_schema, f'<xs:schema {XS}><xs:element name="a" type="b"/></xs:schema>'), (xml_schema, f"<xs:schema {XS}/>"), (xml_schema, f'<xs:schema {XS}><xs:element name="a" type="q:b"/></xs:schema>'),
        (relax_ng, "<a/>"), (relax_ng, '<element xmlns="http://relaxng.org/ns/structure/1.0" name="a"><ref name="b"/></element>'), (relax_ng, '<grammar xmlns="http://relaxng.org/ns/structure/1.0"><start><ref name="b"/></start><define name="b"><ref name="b"/></define></grammar>'),
        (relax_ng, '<element xmlns="http://relaxng.org/ns/structure/1.0" name="a"><interleave><group><element name="b"><empty/></element><element name="c"><empty/></element></group><element name="d"><empty/></element></interleave></element>'), (schematron, "<a/>"),
    ],
)
def test_schemas_that_cannot_be_read(read, text):
    with pytest.raises(SchemaError):
        read(text)


def test_schematron(spark):
    s = """<schema xmlns="http://purl.oclc.org/dsdl/schematron" defaultPhase="main"><ns prefix="p" uri="u"/><let name="top" value="count(//i)"/>
    <phase id="main"><active pattern="one"/><active pattern="two"/></phase><phase id="less"><active pattern="three"/></phase>
    <pattern id="one"><rule abstract="true" id="named"><assert test="@n">no n at <name/></assert></rule>
      <rule context="i[@k = 'a']"><let name="twice" value="@n * 2"/><extends rule="named"/><assert test="$twice &lt; 10 or not(@n)">twice <value-of select="$twice"/> of <value-of select="$top"/></assert></rule>
      <rule context="o/i | p:i"><extends rule="named"/><report test="@n = preceding-sibling::i/@n">again
          <emph>here</emph></report></rule></pattern>
    <pattern id="two"><rule context="i/@n"><assert test=". &gt; 0">n is <value-of select="."/></assert></rule></pattern>
    <pattern id="three"><rule context="/o"><report test="true()">seen</report></rule></pattern></schema>"""
    nodes = xml(spark, "<o><i k='a' n='7'/><i k='a'/><i n='7'/><i n='-1'/><i/><p:i xmlns:p='u'/></o>", "<o/>")
    got = sorted((r.doc_id, r.pre, r.rule, r.severity, r.message) for r in check_schematron(nodes, s).collect())
    assert got == [
        (0, 2, "one/0", "error", "twice 14 of 6"), (0, 3, "one/0", "error", "no n at i"), (0, 4, "one/1", "warning", "again here"), (0, 5, "two/0", "error", "n is -1"), (0, 6, "one/1", "error", "no n at i"), (0, 7, "one/1", "error", "no n at p:i"),
    ]
    assert sorted((r.doc_id, r.message) for r in check_schematron(nodes, s, "less").collect()) == [(0, "seen"), (1, "seen")]
    assert check_schematron(nodes, '<schema xmlns="http://purl.oclc.org/dsdl/schematron"/>').count() == 0
    circle = '<schema xmlns="http://purl.oclc.org/dsdl/schematron"><let name="a" value="$a"/><pattern><rule context="o"><assert test="$a">x</assert></rule></pattern></schema>'
    for bad, phase in ((circle, None), (s, "none"), (s.replace("$twice &lt;", "$other &lt;"), None)):
        with pytest.raises(SchemaError):
            check_schematron(nodes, bad, phase)


def test_folded_models_and_levels_agree(spark):
    """What the fold over whole documents finds is what the levels' tables say, with and without string-values."""
    from pyspark.sql import functions as F

    from thicket.operators.content import interleave, one_of, seq, times
    from thicket.schema import ARROW, VALUE
    from thicket.sources.xml import parse_xml

    g = Grammar(
        {
            "top": Type("a", seq(times(el("k1"), 0), times(el("k2"), 0))), "k1": Type("b", text=lambda v: v == "1", attributes=[Attribute("n")]), "k2": Type("b", one_of(el("c"), seq()), text="mixed", attributes=None),
            "c": Type("c", interleave(("k1", 0, 1), ("c", 1, None))), "end": Type("c", text=lambda v: F.length(v) < 3), "any": Type("d", None, text="mixed"),
        },
        ["top"],
    )
    texts = [
        "<a><b>1</b><b>2</b></a>", "<a><b>2</b><b>1</b></a>", "<a><b>1<!--x--></b><b n='1'>2<c/></b></a>", "<a><b><c><c/><c/><b>1</b></c></b></a>", "<a><b><c><b>1</b><b>1</b><c/></c></b>x</a>", "<b>1</b>", "<a><q/></a>", "<a>", "<d>x<a/><q><a/></q></d>",
        "<a>" + "<b>1</b>" * 2000 + "<b>2</b>" * 2000 + "</a>", "<a>" + "<b>1</b>" * 2000 + "<b>2</b>" * 2000 + "<b m='1'>1</b><b>1</b><c/></a>", "<a><b>1</b>\n <b>1</b></a>", "<a><b>1<?p?></b><b><![CDATA[1]]></b></a>", "<a><b>" + "1" * 5000 + "</b></a>", "<a><c>" + "1" * 5000 + "</c></a>",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for nodes in (parse_xml(docs), parse_xml(docs, columns=[*ARROW.names, VALUE])):
        types = element_types(nodes, g)
        bad = types.filter("size(types) = 0 and clear or depth = 1 and size(types) > 0 and not array_contains(types, 0)")
        got = check_grammar(nodes, g)
        assert sorted((r.doc_id, r.pre) for r in got.collect()) == sorted((r.doc_id, r.pre) for r in bad.collect())
        assert 0 < len({r.doc_id for r in got.collect()}) < len(texts)


def test_shapes_are_checked_without_joins_of_children(spark):
    from thicket import catalog

    for name in ("validate_schema", "validate_schema_document", "validate_tree_grammar"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "thicket-" not in plan


def test_shapes_of_odd_documents(spark):
    from thicket.operators.validate import Shape, check_shapes, interleave, one_of, seq, times

    shapes = {"a": Shape(seq(el("b"), times(one_of(el("c"), el("b")), 0, 2))), "b": Shape(interleave(("c", 1, 2), ("d", 0, 1))), "c": Shape(None, text="mixed"), "d": Shape(text="integer"), "e": Shape()}
    texts = ["<a><b><c/></b></a>", "<a><c/></a>", "<a>x<b><d>1</d><c/><c/></b><c/></a>", "<a><b><c/><c/><c/><d>y</d><d>1</d></b></a>", "<a><b><c><z/></c></b><b/><b/><b/></a>", "<e> <e/></e>", "<e><![CDATA[ ]]></e>", "<a><b><c/>t</b></a>", "<", "<d>1<!--x--></d>"]
    found = check_shapes(xml(spark, *texts), "a", shapes).groupBy("doc_id", "rule").count().collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, {})[r.rule] = r["count"]
    assert got == {1: {"content": 1}, 2: {"text": 1}, 3: {"content": 1, "type": 1}, 4: {"content": 4, "undeclared-element": 1}, 5: {"root": 1, "content": 1}, 6: {"root": 1, "text": 1}, 7: {"text": 1}, 9: {"root": 1}}
