"""Path and selector strings, against what they select by hand."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import html, pres, xml
from thicket.operators.paths import PathError, select, xpath

TEXT = '<a xmlns:p="u"><b id="1" k="x">t<c>5</c><c>7</c></b><b id="2"><c>x</c></b><p:b k="y"/><d><b id="3"><c>9</c><!--m--></b></d>u</a>'
# pre: 0 doc, 1 a, 2 b, 3 t, 4 c, 5 "5", 6 c, 7 "7", 8 b, 9 c, 10 x, 11 p:b, 12 d, 13 b, 14 c, 15 "9", 16 comment, 17 u


@pytest.fixture(scope="module")
def parsed(spark):
    return xml(spark, TEXT).cache()


@pytest.fixture(scope="module")
def two(spark):
    return xml(spark, TEXT, "<z/>").cache()


@pytest.mark.parametrize(
    "path, want",
    {
        "/": [0], "/a": [1], "/a/b": [2, 8, 11], "//c": [4, 6, 9, 14], "//b[@id]": [2, 8, 13], "//b[@id='2']/c": [9], "//p:b": [11], "/a/*": [2, 8, 11, 12], "/a/*[2]": [8], "//b[last()]": [11, 13], "//c[1]": [4, 9, 14],
        "//c[position() > 1]": [6], "//c[. > 6]": [6, 14], "//b[c = 'x']": [8], "//b[c != '5']": [2, 8, 13], "//b[not(c)]": [11], "//b[c and @k]": [2], "//b[@k or @id = '3']": [2, 11, 13], "//b[contains(@k, 'y')]": [11], "//b[5 < c]": [2, 13],
        "//c/..": [2, 8, 13], "//c[. = 9]/parent::b": [13], "//c/ancestor::d": [12], "//b/text()": [3], "//b/comment()": [16], "//d//c": [14], "/a/b[1]/following-sibling::*": [8, 11, 12], "//@k/..": [2, 11], "//b[c[. = '7']]": [2], "//b[c[2]]": [2],
        "//d | //b[@id='1']": [2, 12], "//b[starts-with(c, '9')]": [13], "/a/d/b/c/text()": [15], "/a/b[@id][2]": [8], "/descendant::c[3]": [9], "//b[.//c]": [2, 8, 13],
    }.items(),
)
def test_paths(parsed, path, want):
    assert [p for _, p in pres(xpath(parsed, path, {"p": "u"}))] == want


@pytest.mark.parametrize(
    "path, want",
    {
        "(//c)[1]": [4], "(//c)[last()]": [14], "(//b)[2]/c": [9], "//c[position() mod 2 = 1]": [4, 9, 14], "/a/*[last()-1]": [11], "/a/*[position() = last() - 1]": [11], "//b[count(c) = 2]": [2], "//b[count(*) > 0]": [2, 8, 13], "//*[count(c) >= 1]": [2, 8, 13],
        "//b[string-length(@k) > 0]": [2, 11], "//c[string-length() = 1]": [4, 6, 9, 14], "//c[normalize-space(.) = 'x']": [9], "//*[local-name() = 'd']": [12], "//*[name() = 'p:b']": [11], "//*[namespace-uri() = 'u']": [11], "//b[matches(@id, '[12]')]": [2, 8],
        "//b[c|comment()]": [2, 8, 13], "//b[@id = //c]": [], "//b[c = //b/@id]": [], "//b[@k = //@k]": [2, 11], "//b[@id != //b[1]/@id]": [2, 8, 13], "//b[c > //d/b/@id]": [2, 13], "//b[/a/d]": [2, 8, 11, 13], "//b[../d]": [2, 8, 11], "//b[not(/a/q)][1]": [2, 13],
        "//c[. + 2 = 7]": [4], "//c[. * 2 > 11]": [6, 14], "//c[-. = -5]": [4], "//c[. div 2 = 3.5]": [6], "//c[$n < .]": [6, 14], "//b[@id = $s]": [8], "id('2 3')": [8, 13], "id(//d/b/@id)/c": [14], "//b[@id][position() = 2]": [8],
        "//b[string(@id) = concat('', '1')]": [2], "//b[@id = position()]": [2, 8], "//b[c = 4 + 1]": [2], "//b[c = string-length('12345')]": [2], "//b[sum(c) = 12]": [2], "//b[number(c) = 5]": [2], "//b[string(c) = '5']": [2], "//b[substring-before(concat(@id, '-x'), '-') = '3']": [13],
        "//c[5]": [], "//c[0]": [], "//c['x']": [4, 6, 9, 14], "//c['']": [], "//c[true()]": [4, 6, 9, 14], "//c[true() = .]": [4, 6, 9, 14], "//b[lang('en')]": [], "//@k/parent::b": [2, 11], "//@id/ancestor::d": [12], "//@k/following::c": [4, 6, 9, 14], "//@id/preceding::b": [2, 8, 11],
        "/a/d/preceding-sibling::*[1]": [11], "//c[following::b]": [4, 6, 9], "//c[preceding::c][1]": [6, 9, 14], "//b[3 > count(preceding::c)]": [2, 8], "//b/namespace::p/self::b": [2, 8, 11, 13], "//text()[. = 't']": [3], "//node()[self::comment()]": [16], "//b[*]": [2, 8, 13], "//*[* and not(@*)]": [1, 12],
        "(//b | //d)[last()]": [13], "(//c)[. > 5][1]": [6], "//b[c[1] = 5 or c[. = '9']]": [2, 13], "//b[exists(c)][empty(@k)]": [8, 13], "//b[max(c) = 7]": [2], "//d//c[ancestor::b[@id = 3]]": [14], "/a[count(//c) = 4]": [1], "/a[//c = 'x']/b[1]": [2], "//b[(c)[2] = 7]": [2], "reverse(//c)[1]": [14],
    }.items(),
)
def test_expressions(parsed, path, want):
    assert [p for _, p in pres(xpath(parsed, path, {"p": "u"}, {"n": 6, "s": "2"}))] == want


@pytest.mark.parametrize(
    "path, want",
    {
        "//@id[. = '1']": ["1"], "//b/@id | //@k": ["1", "x", "2", "y", "3"], "(//@id)[2]": ["2"], "//@*[name() = 'k']": ["x", "y"], "//@id[../c > 6]": ["1", "3"], "//@id[count(ancestor::*) = 3]": ["3"], "//b/@*[2]": ["x"], "//b/attribute::node()[last()]": ["x", "2", "y", "3"], "//@id/.": ["1", "2", "3"], "//@k/self::node()": ["x", "y"],
    }.items(),
)
def test_attribute_nodes(parsed, path, want):
    assert [r.value for r in sorted(xpath(parsed, path).collect(), key=lambda r: (r.pre, r.attr_idx))] == want


def test_mixed_nodes(parsed):
    rows = xpath(parsed, "//d/b/@id | //d/b/c | //d/b/@id/descendant-or-self::node()").collect()
    assert sorted((r.pre, r.attr_idx, r.kind, r.name, r.value) for r in rows) == [(13, 0, "attribute", "id", "3"), (14, None, "element", "c", "9")]


@pytest.mark.parametrize(
    "text, want",
    {
        "count(//c) + 1": [5.0, 1.0], "string(//b/@id)": ["1", ""], "sum(//b/@id)": [6.0, 0.0], "count(//b | //c)": [8.0, 0.0], "1 div 0": [float("inf")] * 2, "-(3 mod 2)": [-1.0] * 2, "//c = 7": [True, False], "not(//c)": [False, True], "//b/@id = //b/@id": [True, False], "//c != //c": [True, False],
        "//c < //b/@id": [False, False], "//b/@id < //c": [True, False], "'a' = 'b' or 1 < 2": [True] * 2, "concat(name(/*), '-', local-name(//@k))": ["a-k", "z-"], "string-join(//b/@id, ',')": ["1,2,3", ""], "string-join(reverse(//c), '')": ["9x75", ""], "string(reverse(//c))": ["9", ""], "max(//c[. > 0])": [9.0, float("nan")],
        "substring('12345', 2, 3)": ["234"] * 2, "translate('bar', 'abc', 'AB')": ["BAr"] * 2, "normalize-space(' a  b ')": ["a b"] * 2, "round(2.5) + floor(-1.5) + ceiling(0.2)": [2.0] * 2, "abs(-2)": [2.0] * 2, "tokenize('a,b', ',')": ["a b"] * 2, "replace('aXb', 'X', '-')": ["a-b"] * 2, "upper-case(lower-case('aB'))": ["AB"] * 2,
        "boolean('')": [False] * 2, "number(true())": [1.0] * 2, "string(1 = 1)": ["true"] * 2, "count(//@*)": [5.0, 0.0], "string-length(//b)": [3.0, 0.0], "position() + last()": [2.0] * 2, "$n * 2": [12.0] * 2, "2 * 3 - 4 div 2": [4.0] * 2, "count(//*) - count(//b)": [6.0, 1.0], "name(//d/..)": ["a", ""], "contains(string(//b), '5')": [True, False],
    }.items(),
)
def test_values(two, text, want):
    got = [r.value for r in xpath(two, text, None, {"n": 6}).orderBy("doc_id").collect()]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_attributes_and_folds(spark):
    nodes = xml(spark, TEXT, "<z/>")
    assert sorted((r.pre, r.value) for r in xpath(nodes, "//b/@id").collect()) == [(2, "1"), (8, "2"), (13, "3")]
    value = lambda e: [r.value for r in xpath(nodes, e).orderBy("doc_id").collect()]
    assert value("count(//c)") == [4.0, 0.0] and value("boolean(//d)") == [True, False] and value("string(//b)") == ["t57", ""]
    assert value("sum(//b[@id='1']/c)") == [12.0, 0.0] and value("number(//d)")[0] == 9.0


@pytest.mark.parametrize("bad", ["//a[", "/a/", "//q:b", "foo(//a)", "//a[foo(b)]", "/a/sideways::b", "//a b", "", "#a", "$v", "count(3)", "(1)[1]", "//a[", "count()", "concat('a')", "1 +", "//a | 3", "a[matches(., b)]", "string-join('a')", "element(a)", "matches('a', 'b', 'q')", "//a/", "3 4"])
def test_bad_paths(spark, bad):
    with pytest.raises(PathError):
        xpath(xml(spark, "<a/>"), bad)


@pytest.mark.parametrize(
    "selector, n",
    {
        "p": 4, "#m > p": 3, "div b": 1, ".a.b": 1, "p.b, .b": 2, "p:nth-child(2n)": 2, "p:nth-child(odd)": 2, "p:not(.b)": 3, "span:empty": 1, "p:empty": 0, "div + p": 1, ".b ~ p": 3, '[title="foo bar" i]': 1, "p[lang|=en]": 1, "[title*='o B']": 1,
        "b:only-child": 1, "p:first-child , p:last-child": 3, "*[title^=Foo]>b": 1, "div p:nth-last-child(1) b": 1,
    }.items(),
)
def test_selectors(spark, selector, n):
    nodes = html(spark, '<div id=m class="a b"><p class=b>1<p lang=en-GB>2<span></span><p title="Foo Bar"><!--c--><b>3</b></div><p>4')
    assert select(nodes, selector).count() == n and F.col


@pytest.mark.parametrize("bad", ["p:hover", "p::before", "> p", "p >", "p,,b", "", "p:nth-child()", "[", "p:not(:empty)"])
def test_bad_selectors(spark, bad):
    with pytest.raises(PathError):
        select(html(spark, "<p>"), bad)


def test_children_of_contexts_are_found_without_a_join(spark):
    nodes = xml(spark, "<r><o><i><q>4</q></i><i><q>1</q></i><n>x</n></o><o><n>y</n></o></r>", "<i><q>9</q></i>")
    joins = lambda path: xpath(nodes, path)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins("//i[count(q) = 1]") == 1
    for path, found in {"//i[q > 3]": [(0, 3), (1, 1)], "//o[count(i[q > 0]) > 1]/n": [(0, 9)], "//o[self::o[i]]": [(0, 2)], "//o[(.)[n = 'y']/n]": [(0, 11)], "//@*[child::q]": [], "//o[i[2]/q = 1]": [(0, 2)], "//o[not(i)]": [(0, 11)]}.items():
        assert pres(xpath(nodes, path)) == found, path
