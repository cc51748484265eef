"""Plain documents are read many at once: with the nodes that expat gives, whatever stands beside them."""

import random

import pyarrow as pa
import pytest

from thicket.schema import ARROW, VALUE
from thicket.sources.plain import plain_nodes
from thicket.sources.xml import ParseOptions, _rows, xml_reader

COLUMNS = [*ARROW.names, VALUE]
ODD = [
    "<a/>", "<a></a>", "<a>x</a>", "<a>x</a >", "<a>x</a>\n", " <a/>", "", None, "x", "<a><b></a></b>", "<a></a><b></b>", "<a>x</a>y", "<a>]]></a>", "<a>></a>", "<a b=\"1\" b=\"2\"></a>", "<a b='1'></a>", "<a b=\"it's\">\"q\" 'r'</a>", '<a  b="1"></a>',
    '<a b ="1"></a>', '<a b= "1"></a>', '<a b="1" ></a>', '<a b="1"c="2"></a>', '<a ="x"></a>', '<a="x y"></a>', '<a b="1">', "</a>", "</a><a>", "<a></a></a>", "<></>", "< a></ a>", "<a >x</a>", "<a &amp;></a>", "<a>&lt;&#233;&amp;</a>", "<a>\r\n</a>", "<a>\n\t</a>",
    '<a b="x\ny"></a>', '<a b="x\ty"></a>', "<a\n></a>", "<a>\x01</a>", "<a>￾</a>", "﻿<a>x</a>", "<a>Ａé😀</a>", "<é>x</é>", "<a é=\"1\"></a>", "<p:a>x</p:a>", '<a xmlns="u">x</a>', '<a xmlns:p="u"><p:b></p:b></a>', '<a b=">"></a>', '<a b="<"></a>', '<?xml version="1.0"?><a>x</a>', "<!--c--><a>x</a>",
    "<a><!--c--></a>", "<a><![CDATA[x]]>y</a>", "<a><?t d?></a>", "<!DOCTYPE a [<!ENTITY e 'v'>]><a>&e;</a>", "<1>x</1>", "<a.-_1>x</a.-_1>", "<a><b>1</b>t<b>2</b><c><b>3</b></c></a>", '<a b=""></a>', '<a b="1" c="" d="é"><b b="2">z</b></a>', "<a>" * 300 + "</a>" * 300, "<a" + "".join(f' a{i}="{i}"' for i in range(300)) + "></a>", "<a>" + "é" * 3000 + "</a>", "<a>" + "xy" * 3000 + "<b></b></a>", '<a b="1"', "<a>x", "<a><b>x</a>", "<a\x7f></a\x7f>", "<a>\x7f</a>", '<a b="1"/ ></a>', "<a/ ></a>", "<a></a/>",
]


def rows(texts, plain, options=None):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    found = [r for b in _rows([batch], options or ParseOptions(), xml_reader, COLUMNS, None, plain=plain) for r in b.to_pylist()]
    return sorted(found, key=lambda r: (r["doc_id"], r["pre"]))


def test_odd_documents_alone_and_together():
    for t in ODD:
        assert rows([t], True) == rows([t], False), t
    assert rows(ODD, True) == rows(ODD, False)


def test_limits_are_the_same():
    for o in (ParseOptions(max_depth=2, max_attributes=1, max_attribute_length=3, max_text_length=4, max_name_length=2), ParseOptions(recover=True)):
        texts = [*ODD, "<a><b><c></c></b></a>", '<a b="1234"></a>', '<a b="123"></a>', "<a>12345</a>", "<a>1234</a>", "<abc></abc>", '<a abc="1"></a>']
        assert rows(texts, True, o) == rows(texts, False, o)


@pytest.mark.parametrize("seed", range(20))
def test_spoilt_documents(seed):
    """One character changed, left out or put in, among documents that are as they were."""
    r = random.Random(seed)

    def tree(depth=0):
        name = r.choice("abc")
        attrs = "".join(f' {k}="{r.choice(["", "1", "x y", "é"])}"' for k in r.sample("nmk", r.randrange(3)))
        return f"<{name}{attrs}>{''.join(r.choice(['t', 'x y', '', '\n', 'é', '"']) if depth > 3 or r.random() < 0.5 else tree(depth + 1) for _ in range(r.randrange(4)))}</{name}>"

    def spoilt(t):
        i = r.randrange(len(t))
        return t[:i] + r.choice(["", "<", ">", '"', " ", "/", "=", "&", "a", "\n", "'", "!", "?", ":", "<a>", "</a>"]) + t[i + r.randrange(2) :]

    texts = [t if r.random() < 0.6 else spoilt(t) for t in (tree() for _ in range(200))]
    assert rows(texts, True) == rows(texts, False)


def test_what_is_plain_is_read_at_once():
    texts = ['<order id="1"><item n="1">5.0</item>é</order>', "<a/>", "<a>x</a>"]
    nodes, left = plain_nodes([7, 8, 9], pa.array(texts), ParseOptions())
    assert [d[1] for d in nodes.documents] == [7, 9] and left.tolist() == [1]


SUBSETS = [
    "<!DOCTYPE a [<!ATTLIST b n ID #REQUIRED>]>", "<!DOCTYPE order [<!ATTLIST item n ID #IMPLIED k CDATA #REQUIRED><!ATTLIST b m NMTOKENS #IMPLIED>]>",
    "<!DOCTYPE a [<!ATTLIST b n ID #REQUIRED z CDATA 'd'>]>", "<!DOCTYPE a [<!ATTLIST b z (x|y) 'x'>]>", "<!DOCTYPE a [<!ENTITY e 'v'>]>", "<!DOCTYPE a SYSTEM 'u' [<!ATTLIST b n ID #REQUIRED>]>", "<!DOCTYPE a>", "<!DOCTYPE a []>", "<!DOCTYPE a [<!ATTLIST b n ID #REQUIRED> ]>", "<!DOCTYPE a [<!ATTLIST n n ID>]>",
]


@pytest.mark.parametrize("subset", SUBSETS)
def test_documents_behind_a_doctype(subset):
    texts = [*(subset + (t or "") for t in ODD), subset + '<a><b n="x"></b><b n=" x  y "></b></a>', subset + '<a><b m="x y" k="x  y" n="1"></b></a>', subset + subset + "<a></a>"]
    for t in texts:
        assert rows([t], True) == rows([t], False), t
    for mixed in (texts, [*texts, *ODD], [*ODD, *texts], [texts[1], *ODD, *texts, SUBSETS[0] + "<a>x</a>"]):
        assert rows(mixed, True) == rows(mixed, False)


def test_documents_with_one_subset_of_declarations_are_read_at_once():
    texts = [SUBSETS[0] + '<a><b n="1">x</b></a>', SUBSETS[0] + '<a><b n="x y">x</b></a>', SUBSETS[0] + "<a>y</a>"]
    nodes, left = plain_nodes([7, 8, 9], pa.array(texts), ParseOptions())
    assert [d[1] for d in nodes.documents] == [7, 9] and left.tolist() == [1]
