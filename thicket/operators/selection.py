"""Paths over a corpus: each step, predicate and fold is a DataFrame operation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.numbers import to_number
from thicket.operators.axes import BIN, DISJOINT, REVERSE, attributes, joined, node_test, step
from thicket.schema import VALUE


def attr(name: str) -> Column:
    """The value of a row's attribute of that local name, else null."""
    return F.try_element_at(F.filter("attrs", lambda a: (a["name"] == name) & (F.coalesce(a["prefix"], F.lit("")) != "xmlns")), F.lit(1))["value"]


class Selection:
    """A set of nodes of every document, as ``rows`` of the node table with ``ctx``.

    Starts at the document nodes.  ``ctx`` is the node from which the last step came, by
    which positions count; a step from several contexts to one node keeps one row per
    context until ``nodes()`` or the next step makes them distinct.
    """

    def __init__(self, table: DataFrame, rows: DataFrame | None = None, root: bool | None = None, axis: str = "self"):
        self.table, self.axis, self.root = table, axis, rows is None if root is None else root
        self.rows = table.filter("kind = 'document'").withColumn("ctx", F.col("pre")) if rows is None else rows

    def _with(self, rows: DataFrame, axis: str | None = None) -> Selection:
        return Selection(self.table, rows, False, axis or self.axis)

    def nodes(self) -> DataFrame:
        """The distinct nodes."""
        rows = self.rows.drop("ctx")
        return rows if self.root or self.axis in DISJOINT else rows.dropDuplicates(["doc_id", "pre"])

    def step(self, axis: str, name: str | None = None, kind: str | None = "element", namespace: str | None = None) -> Selection:
        test = node_test(name, kind, namespace)
        if self.root and axis in ("child", "descendant", "descendant-or-self"):  # all other nodes are below the root: a filter
            near = test & {"child": F.col("depth") == 1, "descendant": F.col("depth") > 0, "descendant-or-self": F.lit(True)}[axis]
            return Selection(self.table, self.table.filter(near).withColumn("ctx", F.lit(0)), False, "child")
        return self._with(step(self.nodes(), self.table, axis, test), axis)

    def child(self, name=None, kind="element", namespace=None):
        return self.step("child", name, kind, namespace)

    def descendant(self, name=None, kind="element", namespace=None):
        return self.step("descendant", name, kind, namespace)

    def parent(self, name=None):
        return self.step("parent", name)

    def ancestor(self, name=None):
        return self.step("ancestor", name)

    def following_sibling(self, name=None):
        return self.step("following-sibling", name)

    def preceding_sibling(self, name=None):
        return self.step("preceding-sibling", name)

    def text(self):
        return self.step("child", kind="text")

    def at_path(self, path: str) -> Selection:
        """Elements of an absolute child path such as /order/item: a filter on ``path``, no join.

        Their context is their parent.
        """
        return Selection(self.table, self.table.filter(F.col("path") == path).withColumn("ctx", F.col("parent")), False, "child")

    def where(self, condition: Column | str) -> Selection:
        return self._with(self.rows.filter(condition))

    def _position(self) -> Column:
        order = F.col("pre").desc() if self.axis in REVERSE else F.col("pre")
        return F.row_number().over(Window.partitionBy("doc_id", "ctx").orderBy(order))

    def marked(self) -> DataFrame:
        """The rows with position_ and last_ in their context; nearest first on reverse axes."""
        last = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "ctx"))
        return self.rows.withColumn("position_", self._position()).withColumn("last_", last)

    def position(self, condition: Callable[[Column, Column], Column]) -> Selection:
        """Rows whose (position, last) in their context meet the condition; nearest first on reverse axes."""
        rows = self.marked()
        return self._with(rows.filter(condition(F.col("position_"), F.col("last_"))).drop("position_", "last_"))

    def nth(self, n: int) -> Selection:
        rows = self.rows.withColumn("position_", self._position()).filter(F.col("position_") == n)
        return self._with(rows.drop("position_"))

    def last(self) -> Selection:
        return self.position(lambda p, n: p == n)

    def nth_of_all(self, n: int) -> Selection:
        """(E)[n]: the n-th node of each document's whole set, in document order."""
        over = Window.partitionBy("doc_id").orderBy("pre")
        rows = self.nodes().withColumn("ctx", F.lit(0)).withColumn("position_", F.row_number().over(over))
        return self._with(rows.filter(F.col("position_") == n).drop("position_"), "child")

    def _sub(self, path: Callable[[Selection], Selection]) -> DataFrame:
        """(doc_id, origin) of the nodes from which the relative path reaches something."""
        start = self.nodes()
        marked = Selection(self.table.withColumn("origin", F.lit(None).cast("int")), start.withColumn("origin", F.col("pre")).withColumn("ctx", F.col("pre")), False)
        return _carry(marked, path, self.table)

    def flagged(self, path: Callable[[Selection], Selection], name: str) -> DataFrame:
        """The rows with a boolean column: whether the path reaches something from them; one join."""
        found = self._sub(path).select(F.col("doc_id").alias("f_doc"), F.col("origin").alias("f_pre"), F.lit(True).alias(name))
        on = (F.col("doc_id") == F.col("f_doc")) & (F.col("pre") == F.col("f_pre"))
        return self.rows.join(found, on, "left").drop("f_doc", "f_pre").withColumn(name, F.coalesce(name, F.lit(False)))

    def having(self, path: Callable[[Selection], Selection]) -> Selection:
        """[path]: a semi-join with the nodes that the path starts from with success."""
        found = self._sub(path).select(F.col("doc_id").alias("f_doc"), F.col("origin").alias("f_pre"))
        return self._with(self.rows.join(found, (F.col("doc_id") == F.col("f_doc")) & (F.col("pre") == F.col("f_pre")), "left_semi"))

    def without(self, path: Callable[[Selection], Selection]) -> Selection:
        """[not(path)]: an anti-join."""
        found = self._sub(path).select(F.col("doc_id").alias("f_doc"), F.col("origin").alias("f_pre"))
        return self._with(self.rows.join(found, (F.col("doc_id") == F.col("f_doc")) & (F.col("pre") == F.col("f_pre")), "left_anti"))

    def union(self, other: Selection) -> Selection:
        both = self.nodes().unionByName(other.nodes()).dropDuplicates(["doc_id", "pre"])
        return self._with(both.withColumn("ctx", F.lit(0)), "child")

    def intersect(self, other: Selection) -> Selection:
        return self._with(self.rows.join(other.nodes().select("doc_id", "pre"), ["doc_id", "pre"], "left_semi"))

    def minus(self, other: Selection) -> Selection:
        return self._with(self.rows.join(other.nodes().select("doc_id", "pre"), ["doc_id", "pre"], "left_anti"))

    def attributes(self, name: str | None = None) -> DataFrame:
        rows = attributes(self.nodes(), name)
        return rows.select("doc_id", "pre", "attr_idx", F.col("attr.name").alias("name"), F.col("attr.value").alias("value"))

    def strings(self) -> DataFrame:
        """The nodes with ``value``, their string-value."""
        return string_value(self.nodes(), self.table)

    def numbers(self) -> DataFrame:
        return self.strings().withColumn("number", to_number(F.col("value")))

    def documents(self) -> DataFrame:
        return self.table.filter("kind = 'document'").select("doc_id")

    def count(self) -> DataFrame:
        """(doc_id, n) for every document, 0 included."""
        counts = self.nodes().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        return self.documents().join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))

    def fold(self) -> DataFrame:
        """(doc_id, n, sum, min, max, first, joined): count, number folds, first string and all strings.

        sum of nothing is 0; min and max of nothing, or with a NaN, are NaN; first is the
        string-value of the first node in document order, joined those of all.
        """
        v = self.numbers()
        nan = F.lit(float("nan"))
        folds = v.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("number").alias("sum"),
            F.when(F.bool_or(F.isnan("number")), nan).otherwise(F.min("number")).alias("min"),
            F.when(F.bool_or(F.isnan("number")), nan).otherwise(F.max("number")).alias("max"),
            F.min_by("value", "pre").alias("first"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), " ").alias("joined"),
        )
        out = self.documents().join(folds, "doc_id", "left")
        return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce("min", nan).alias("min"), F.coalesce("max", nan).alias("max"), F.coalesce("first", F.lit("")).alias("first"), F.coalesce("joined", F.lit("")).alias("joined"))


def _carry(start: Selection, path, table: DataFrame) -> DataFrame:
    """Runs a relative path while every row remembers the node it started from."""
    probe = _Origin(table, start.rows, "self")
    return path(probe).rows.select("doc_id", "origin").distinct()


class _Origin(Selection):
    """A selection whose rows carry ``origin``; contexts are pairs of origin and node."""

    def __init__(self, table, rows, axis):
        super().__init__(table, rows, False, axis)

    def _with(self, rows, axis=None):
        return _Origin(self.table, rows, axis or self.axis)

    def nodes(self):
        return self.rows.drop("ctx").dropDuplicates(["doc_id", "pre", "origin"])

    def step(self, axis, name=None, kind="element", namespace=None):
        test = node_test(name, kind, namespace)
        if axis == "self":
            return self._with(self.rows.filter(test), axis)
        c = self.nodes().select(F.col("doc_id").alias("c_doc"), F.col("origin").alias("c_origin"), *[F.col(x).alias(f"c_{x}") for x in ("pre", "post", "parent")])
        rows = joined(self.table.filter(test), c, axis).select(*self.table.columns, F.col("c_origin").alias("origin"), F.col("c_pre").alias("ctx"))
        return self._with(rows, axis)

    def _position(self):
        order = F.col("pre").desc() if self.axis in REVERSE else F.col("pre")
        return F.row_number().over(Window.partitionBy("doc_id", "origin", "ctx").orderBy(order))

    def marked(self):
        last = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "origin", "ctx"))
        return self.rows.withColumn("position_", self._position()).withColumn("last_", last)

    def having_value(self, condition: Column | str):
        """Keeps rows whose string-value (``value``) meets the condition."""
        rows = string_value(self.rows.drop("ctx").dropDuplicates(["doc_id", "pre", "origin"]), self.table)
        return self._with(rows.filter(condition).drop("value").withColumn("ctx", F.lit(0)))

    def having_attr(self, name: str, condition: Callable[[Column], Column]):
        return self._with(self.rows.filter(F.coalesce(condition(attr(name)), F.lit(False))))


def valued(nodes: DataFrame) -> DataFrame:
    """nodes, with the parser's string-values if no document or element lacks its own (see ``schema.MOST_VALUE``)."""
    return nodes if nodes.filter(F.col("kind").isin("element", "document") & F.col(VALUE).isNull()).isEmpty() else nodes.drop(VALUE)


def string_value(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with ``value``: the text below an element or document, else the node's own content.

    A node with one text below it takes it in an equi-join; elements with more meet their text
    nodes by bins of numbers with an interval (see ``axes.joined``), and the text is put
    together in document order by one aggregation.  All joins hold doc_id, so those of a
    bucketed table shuffle nothing.  Rows of a table that holds all string-values (``valued``)
    have theirs already: no join.
    """
    if VALUE in rows.columns:
        lacking = F.when(F.col("kind").isin("element", "document"), F.raise_error("a string-value isn't in the table (see valued)").cast("string"))
        return rows.withColumn("value", F.coalesce(VALUE, lacking, "content", F.lit("")))
    texts = table.filter("kind in ('text', 'cdata')").select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("content").alias("t_text"))
    inner = F.col("kind").isin("element", "document")
    many = rows.filter(inner & (F.col("post") > F.col("pre") + 1)).select("doc_id", "pre", "post").distinct().withColumn("bin_", F.explode(F.sequence(F.floor(F.col("pre") / BIN), F.floor(F.col("post") / BIN))))
    on = (F.col("doc_id") == F.col("t_doc")) & (F.col("bin_") == F.col("t_bin_")) & (F.col("t_pre") > F.col("pre")) & (F.col("t_pre") <= F.col("post"))
    found = many.join(texts.withColumn("t_bin_", F.floor(F.col("t_pre") / BIN)), on).groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_pre", "t_text"))), lambda x: x["t_text"]), "").alias("below_"))
    only = F.when(inner & (F.col("post") == F.col("pre") + 1), F.col("pre") + 1)
    out = rows.join(found, ["doc_id", "pre"], "left").withColumn("only_", only).join(texts, (F.col("doc_id") == F.col("t_doc")) & (F.col("only_") == F.col("t_pre")), "left")
    value = F.when(inner, F.coalesce("t_text", "below_", F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    return out.select(*[F.col(c) for c in rows.columns], value.alias("value"))
