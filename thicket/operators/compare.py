"""Existential comparisons of node-sets, reduced to semi-joins and extremes; an empty set never compares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.axes import above
from thicket.sources.declarations import identifiers


def any_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_ids where some value of a equals some value of b (rows: doc_id, value)."""
    return a.select("doc_id", "value").join(b.select("doc_id", "value"), ["doc_id", "value"], "left_semi").select("doc_id").distinct()


def any_different(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_ids where some value of a differs from some value of b: not all values of both are one."""
    fold = lambda x, p: x.groupBy("doc_id").agg(F.min("value").alias(f"{p}_lo"), F.max("value").alias(f"{p}_hi"))
    both = fold(a, "a").join(fold(b, "b"), "doc_id")
    return both.filter("not (a_lo = a_hi and b_lo = b_hi and a_lo = b_lo)").select("doc_id")


def any_less(a: DataFrame, b: DataFrame, or_equal: bool = False) -> DataFrame:
    """doc_ids where some number of a is less than some number of b; NaN compares with nothing."""
    low = a.filter(~F.isnan("number")).groupBy("doc_id").agg(F.min("number").alias("lo"))
    high = b.filter(~F.isnan("number")).groupBy("doc_id").agg(F.max("number").alias("hi"))
    return low.join(high, "doc_id").filter("lo <= hi" if or_equal else "lo < hi").select("doc_id")


def by_id(tokens: DataFrame, nodes: DataFrame, attribute: str | None = None) -> DataFrame:
    """Elements whose id is one of the white-space separated tokens of (doc_id, value): an equi-join.

    Ids are attributes of this name; if none is given, those named id and those that a
    document declares to be of type ID.  Of several elements with one id in a document, the
    last counts.
    """
    from thicket.operators.selection import attr

    if attribute is None:
        ids = identifiers(nodes).withColumnRenamed("id", "id_")
    else:
        ids = nodes.filter("kind = 'element'").withColumn("id_", attr(attribute)).filter("id_ is not null")
    last = ids.groupBy("doc_id", "id_").agg(F.max("pre").alias("pre"))
    wanted = tokens.select("doc_id", F.explode(F.split(F.trim("value"), r"\s+")).alias("id_")).filter("id_ <> ''").distinct()
    return nodes.join(last.join(wanted, ["doc_id", "id_"]).select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")


def language(context: DataFrame, nodes: DataFrame, code: str) -> DataFrame:
    """Context nodes in language ``code``: the nearest xml:lang at or above is it or begins with it and a hyphen."""
    lang = F.try_element_at(F.filter("attrs", lambda a: (a["name"] == "lang") & ((a["prefix"] == "xml") | (a["namespace"] == "http://www.w3.org/XML/1998/namespace"))), F.lit(1))["value"]
    says = nodes.filter("kind = 'element'").select("doc_id", "pre", "post", lang.alias("l_lang")).filter("l_lang is not null")
    nearest = above(says, context).groupBy(F.col("c_doc").alias("doc_id"), F.col("c_pre").alias("pre")).agg(F.lower(F.max_by("l_lang", "pre")).alias("in_force"))
    hit = nearest.filter((F.col("in_force") == code.lower()) | F.col("in_force").startswith(code.lower() + "-"))
    return context.join(hit.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
