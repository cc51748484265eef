"""The thirteen axes as structural joins: an equi-join on the document plus an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From a context node c to a target t.
CONDITIONS = {
    "child": lambda c, t: t("parent") == c("pre"),
    "parent": lambda c, t: t("pre") == c("parent"),
    "self": lambda c, t: t("pre") == c("pre"),
    "descendant": lambda c, t: (t("pre") > c("pre")) & (t("pre") <= c("post")),
    "descendant-or-self": lambda c, t: (t("pre") >= c("pre")) & (t("pre") <= c("post")),
    "ancestor": lambda c, t: (t("pre") < c("pre")) & (t("post") >= c("pre")),
    "ancestor-or-self": lambda c, t: (t("pre") <= c("pre")) & (t("post") >= c("pre")),
    "following-sibling": lambda c, t: (t("parent") == c("parent")) & (t("pre") > c("pre")),
    "preceding-sibling": lambda c, t: (t("parent") == c("parent")) & (t("pre") < c("pre")),
    "following": lambda c, t: t("pre") > c("post"),
    "preceding": lambda c, t: t("post") < c("pre"),
}
#: Axes whose nearest node comes last in document order.
REVERSE = frozenset({"ancestor", "ancestor-or-self", "parent", "preceding", "preceding-sibling"})
#: Axes by which two contexts never reach one node.
DISJOINT = frozenset({"child", "self"})


def node_test(name: str | None = None, kind: str | None = "element", namespace: str | None = None) -> Column:
    """Rows of a kind (None: any), a local name (None or "*": any) and a namespace (None: any).

    kind "text" takes CDATA sections too.
    """
    out = F.lit(True)
    if kind == "text":
        out = F.col("kind").isin("text", "cdata")
    elif kind is not None:
        out = F.col("kind") == kind
    if name not in (None, "*"):
        out = out & (F.col("name") == name)
    if namespace is not None:
        out = out & (F.coalesce("namespace", F.lit("")) == namespace)
    return out


#: Nodes of a document, by number, that are one key of a join on intervals.
BIN = 4096


def _bin(column: str) -> Column:
    return F.floor(F.col(column) / BIN)


def joined(targets: DataFrame, context: DataFrame, axis: str) -> DataFrame:
    """Targets with the context nodes (c_doc, c_pre, c_post, c_parent, ..) that reach them over an axis.

    Where one side's interval holds the other's number, numbers are dealt into bins and the
    interval is exploded over those it touches (one, in a small document), so a very large
    document is many keys of the join; a pair meets in one bin alone.
    """
    on = (F.col("doc_id") == F.col("c_doc")) & CONDITIONS[axis](lambda x: F.col(f"c_{x}"), F.col)
    every = lambda low, high: F.explode(F.sequence(_bin(low), _bin(high)))
    if axis.startswith("descendant"):
        targets, context = targets.withColumn("bin_", _bin("pre")), context.withColumn("c_bin_", every("c_pre", "c_post"))
    elif axis.startswith("ancestor"):
        targets, context = targets.withColumn("bin_", every("pre", "post")), context.withColumn("c_bin_", _bin("c_pre"))
    else:
        return targets.join(context, on)
    return targets.join(context, on & (F.col("bin_") == F.col("c_bin_"))).drop("bin_", "c_bin_")


def below(nodes: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """nodes at or below the roots, once for each, with the root's c_pre, c_post and further ``columns`` of it as they are."""
    r = roots.select(F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("post").alias("c_post"), *columns)
    return joined(nodes, r, "descendant-or-self").drop("c_doc")


def above(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """nodes at or above the context's nodes, once for each, with c_doc and c_pre."""
    return joined(nodes, context.select(F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre")), "ancestor-or-self")


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Column) -> DataFrame:
    """Nodes of the axis that pass the test, each with ``ctx``, the ``pre`` of the node it was reached from.

    The test is applied to the node table before the join, so it reaches the scan.
    """
    if axis == "self":
        return context.filter(test).withColumn("ctx", F.col("pre"))
    c = context.select(F.col("doc_id").alias("c_doc"), *[F.col(x).alias(f"c_{x}") for x in ("pre", "post", "parent")])
    return joined(nodes.filter(test), c, axis).select(*[F.col(x) for x in nodes.columns], F.col("c_pre").alias("ctx"))


def attributes(context: DataFrame, name: str | None = None, namespace: str | None = None) -> DataFrame:
    """One row per attribute (namespace declarations aside): the owner's columns, attr_idx and attr; no join."""
    rows = context.select("*", F.posexplode("attrs").alias("attr_idx", "attr")).filter("attr.prefix is distinct from 'xmlns' and not (attr.name = 'xmlns' and attr.prefix is null)")
    if name not in (None, "*"):
        rows = rows.filter(F.col("attr.name") == name)
    if namespace is not None:
        rows = rows.filter(F.coalesce("attr.namespace", F.lit("")) == namespace)
    return rows


def in_scope_namespaces(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, namespace): the declarations in scope of each context node, the nearest wins."""
    declared = nodes.filter("kind = 'element'").select("doc_id", "pre", "post", F.explode("attrs").alias("a")).filter("a.prefix = 'xmlns' or (a.name = 'xmlns' and a.prefix is null)")
    declared = declared.select("doc_id", "pre", "post", F.when(F.col("a.prefix").isNull(), "").otherwise(F.col("a.name")).alias("prefix"), F.col("a.value").alias("uri"))
    reach = above(declared, context).select(F.col("c_doc").alias("doc_id"), F.col("c_pre").alias("pre"), "prefix", "uri", F.col("pre").alias("d_pre"))
    return reach.groupBy("doc_id", "pre", "prefix").agg(F.max_by("uri", "d_pre").alias("namespace")).filter("namespace <> ''")
