"""Attribute declarations of documents as a table beside the nodes, and the joins that use them: ids and defaults."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.schema import ATTR

DECLARED = "doc_id bigint, element string, attribute string, type string, default string, required boolean"
#: Subsets whose declarations a task remembers: a corpus mostly has few, many times each.
_REMEMBERED = 256
_XMLNS = "http://www.w3.org/2000/xmlns/"


def _read(name: str, inside: str) -> list[tuple]:
    """(element, attribute, type, default, required) of what follows a doctype's name; up to an error, if there is one."""
    found: dict[tuple[str, str], tuple] = {}
    parser = expat.ParserCreate()
    parser.AttlistDeclHandler = lambda element, attribute, kind, default, required: found.setdefault((element, attribute), (element, attribute, kind, default, bool(required)))
    try:
        parser.Parse(f"<!DOCTYPE {name} {inside}><{name}/>", True)
    except expat.ExpatError:
        pass
    return list(found.values())


def _rows(batches):
    known: dict[tuple[str, str], list[tuple]] = {}
    for b in batches:
        out: list[tuple] = []
        for doc_id, name, inside in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (rows := known.get((name, inside))) is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                rows = known[name, inside] = _read(name, inside)
            out += [(doc_id, *r) for r in rows]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.bool_()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DECLARED.split(", ")])


def declarations(nodes: DataFrame) -> DataFrame:
    """(doc_id, element, attribute, type, default, required) that the internal subsets of documents declare.

    Names are as they are written, with their prefixes.  Of several declarations of one
    attribute the first counts, of a broken subset those before the error.  A document
    without a subset has no rows.  Narrow: only doctype nodes are read, nothing is shuffled.
    """
    subsets = nodes.filter("kind = 'doctype' and content like '%<!ATTLIST%'").select("doc_id", "name", "content")
    return subsets.mapInArrow(_rows, DECLARED)


def dtd_declarations(dtds: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of DTD texts (external subsets), one per row; a null or empty text declares nothing."""
    return dtds.select(F.col(id_col).cast("long").alias("doc_id"), F.lit("x").alias("name"), F.concat(F.lit("["), F.coalesce(F.col(text_col), F.lit("")), F.lit("]")).alias("content")).mapInArrow(_rows, DECLARED)


def _qname(prefix, name):
    return F.when(F.length(prefix) > 0, F.concat(prefix, F.lit(":"), name)).otherwise(name)


def identifiers(nodes: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(doc_id, pre, id) of elements: attributes named id, and those that their document declares to be of type ID.

    One join of elements with the declared names of their document and element; documents that
    declare nothing take no part in it.
    """
    elements = nodes.filter("kind = 'element'")
    plain = elements.select("doc_id", "pre", F.explode(F.filter("attrs", lambda a: (a["name"] == "id") & a["prefix"].isNull())).alias("a")).select("doc_id", "pre", F.col("a.value").alias("id"))
    of_type = (declarations(nodes) if declared is None else declared).filter("type = 'ID' and attribute <> 'id'")
    names = of_type.groupBy("doc_id", F.col("element").alias("qname")).agg(F.collect_set("attribute").alias("names"))
    typed = elements.filter("size(attrs) > 0").select("doc_id", "pre", "attrs", _qname(F.col("prefix"), F.col("name")).alias("qname")).join(names, ["doc_id", "qname"])
    values = F.transform(F.filter("attrs", lambda a: F.array_contains("names", _qname(a["prefix"], a["name"]))), lambda a: F.trim(a["value"]))
    return plain.unionByName(typed.select("doc_id", "pre", F.explode(values).alias("id")))


def with_defaults(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """The node table in which elements have the attributes that ``declared`` gives a default or fixed value for and that they lack.

    The parser does so for internal subsets itself; this is for declarations from elsewhere
    (``dtd_declarations``).  Namespace declarations get their namespace; a prefixed attribute
    gets none.  One join on (doc_id, element); ``declared`` is first brought to one row each.
    """
    one = declared.filter("default is not null").dropDuplicates(["doc_id", "element", "attribute"])
    prefixed = F.col("attribute").contains(":")
    name, prefix = F.when(prefixed, F.substring_index("attribute", ":", -1)).otherwise(F.col("attribute")), F.when(prefixed, F.substring_index("attribute", ":", 1))
    given = F.struct(name.alias("name"), F.col("default").alias("value"), prefix.alias("prefix"), F.when((prefix == "xmlns") | (F.col("attribute") == "xmlns"), _XMLNS).alias("namespace")).cast(ATTR)
    defaults = one.select("doc_id", F.col("element").alias("d_element"), given.alias("given")).groupBy("doc_id", "d_element").agg(F.sort_array(F.collect_list("given")).alias("d_given"))
    qname = F.when(F.col("kind") == "element", _qname(F.col("prefix"), F.col("name")))
    own = F.transform("attrs", lambda a: _qname(a["prefix"], a["name"]))
    lacking = F.filter(F.coalesce("d_given", F.array().cast(f"array<{ATTR}>")), lambda d: ~F.array_contains(own, _qname(d["prefix"], d["name"])))
    joined = nodes.withColumn("d_element", qname).join(defaults, ["doc_id", "d_element"], "left")
    attrs = F.when(F.col("d_given").isNull(), F.col("attrs")).otherwise(F.concat(F.coalesce("attrs", F.array().cast(f"array<{ATTR}>")), lacking))
    return joined.withColumn("attrs", attrs).select(*nodes.columns)
