"""CSS selectors as Columns over the node table, and their combinators as structural joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.axes import CONDITIONS
from thicket.operators.selection import attr

Element = Column


def tag(name: str = "*") -> Element:
    """A type selector; names are compared without ASCII case."""
    e = F.col("kind") == "element"
    return e if name == "*" else e & (F.lower("name") == name.lower())


def _value(name: str) -> Column:
    return attr(name)


def id_(name: str) -> Element:
    return F.coalesce(_value("id") == name, F.lit(False))


def class_(name: str) -> Element:
    return F.coalesce(F.array_contains(F.split(_value("class"), "[ \\t\\n\\f\\r]+"), name), F.lit(False))


def has(name: str, op: str | None = None, value: str = "", ignore_case: bool = False) -> Element:
    """[name], or [name op value] with op one of = ~= |= ^= $= *=."""
    v, w = _value(name), value
    if ignore_case:
        v, w = F.lower(v), value.lower()
    if op is None:
        return v.isNotNull()
    test = {
        "=": lambda: v == w,
        "~=": lambda: F.array_contains(F.split(v, "[ \\t\\n\\f\\r]+"), w) if w and not w.split()[1:] else F.lit(False),
        "|=": lambda: (v == w) | v.startswith(w + "-"),
        "^=": lambda: v.startswith(w) if w else F.lit(False),
        "$=": lambda: v.endswith(w) if w else F.lit(False),
        "*=": lambda: v.contains(w) if w else F.lit(False),
    }[op]()
    return F.coalesce(test, F.lit(False))


def first_child() -> Element:
    return F.col("elem_ord") == 1


def last_child() -> Element:
    return F.col("elem_ord_last") == 1


def only_child() -> Element:
    return first_child() & last_child()


def _nth(n: Column, a: int, b: int) -> Column:
    if a == 0:
        return n == b
    return (F.pmod(n - b, F.lit(abs(a))) == 0) & ((n >= b) if a > 0 else (n <= b))


def nth_child(a: int, b: int) -> Element:
    """:nth-child(an+b); odd is (2, 1), even is (2, 0)."""
    return _nth(F.col("elem_ord"), a, b)


def nth_last_child(a: int, b: int) -> Element:
    return _nth(F.col("elem_ord_last"), a, b)


def not_(e: Element) -> Element:
    return ~e


def select(nodes: DataFrame, e: Element) -> DataFrame:
    """All elements that the compound selector matches."""
    return nodes.filter(tag() & e)


def empty(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """:empty, of elements already matched: no element, text or CDATA child (an anti-join)."""
    full = nodes.filter("kind in ('element', 'text', 'cdata')").select("doc_id", F.col("parent").alias("pre"))
    return matched.join(full, ["doc_id", "pre"], "left_anti")


_COMBINATORS = {" ": "descendant", ">": "child", "~": "following-sibling", "+": "next"}


def combine(left: DataFrame, combinator: str, nodes: DataFrame, e: Element) -> DataFrame:
    """``left combinator e`` for the elements ``left``: " " descendant, > child, + next, ~ later sibling.

    A semi-join from the candidates, so each comes once whatever the number of its partners.
    """
    axis = _COMBINATORS[combinator]
    c = left.select(F.col("doc_id").alias("l_doc"), *[F.col(x).alias(f"l_{x}") for x in ("pre", "post", "parent", "elem_ord")])
    if axis == "next":
        on = (F.col("parent") == F.col("l_parent")) & (F.col("elem_ord") == F.col("l_elem_ord") + 1)
    else:
        on = CONDITIONS[axis](lambda x: F.col(f"l_{x}"), F.col)
    return select(nodes, e).join(c, (F.col("doc_id") == F.col("l_doc")) & on, "left_semi")


def any_of(*matched: DataFrame) -> DataFrame:
    """A selector group: what any of its members matches, each element once."""
    out = matched[0]
    for m in matched[1:]:
        out = out.unionByName(m)
    return out.dropDuplicates(["doc_id", "pre"])


def first(matched: DataFrame) -> DataFrame:
    """The first match of every document."""
    return matched.groupBy("doc_id").agg(F.min("pre").alias("pre")).join(matched, ["doc_id", "pre"]).select(*matched.columns)
