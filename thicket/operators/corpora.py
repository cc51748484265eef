"""Documents made of relational rows: an order with its items as XML text, built by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.sinks.serialize import escape_attribute, escape_text


#: What items of an order are sorted by: all that an item shows, so that their order is a matter of the tables alone.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


def element(name: str, *content: Column, **attributes: Column) -> Column:
    """<name a="..">content</name> as a text Column; contents are markup, attribute values are escaped."""
    attrs = [F.concat(F.lit(f' {k}="'), escape_attribute(v.cast("string")), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), *content, F.lit(f"</{name}>"))


def text(value: Column) -> Column:
    return escape_text(value.cast("string"))


def orders(orders_table: DataFrame, lineitem: DataFrame, customer: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, text): one document per order, its items in line order, then by ITEM_ORDER.

    Customers meet the orders' rows, not their texts, which are not shuffled once they are
    made.  ``partitions`` is the number of those that documents are dealt into by doc_id.
    """
    dealt = (lambda t, key: t) if partitions is None else lambda t, key: t.repartition(partitions, key)
    # Numbers hold nothing to escape.
    shown = lambda name: F.col(name).cast("string") if isinstance(lineitem.schema[name].dataType, T.NumericType) else text(F.col(name))
    item = element("item", element("partkey", shown("l_partkey")), element("qty", shown("l_quantity")), element("price", shown("l_extendedprice")), element("discount", shown("l_discount")), n=F.col("l_linenumber"), returnflag=F.col("l_returnflag"))
    items = dealt(lineitem.select("l_orderkey", *ITEM_ORDER), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ITEM_ORDER], item.alias("x")))), lambda s: s["x"]), "").alias("items"))
    o = orders_table.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_name")
    o = dealt(o, "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    who = element("customer", element("name", text(F.coalesce("c_name", F.lit("")))), id=F.col("o_custkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), element("order", who, F.coalesce("items", F.lit("")), id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("text"))
