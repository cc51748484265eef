"""XPath expressions over a corpus: every sub-expression is one column per context node.

A string is read once, on the driver, and each part becomes what one would write by hand.
Node-sets are DataFrames whose rows carry the node they were reached from (``o_pre``,
``o_idx``); where a value is needed, they are folded by it and joined to the contexts once.
So arithmetic, functions and comparisons are plain columns, a predicate is a filter, and
what Catalyst gets is a tree of joins, aggregations and windows with ``doc_id`` as their key.

A node is (doc_id, pre, idx): idx is 0 for nodes of the table and k + 1 for the attribute k of
the element ``pre``, which stands between the element and its children in document order.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions import numbers, strings
from thicket.operators.axes import CONDITIONS, REVERSE, attributes, in_scope_namespaces, joined, node_test
from thicket.operators.compare import language
from thicket.operators.selection import attr, string_value
from thicket.sources.declarations import identifiers

Term = tuple


class PathError(ValueError):
    """A path or selector that can't be read, or that names what isn't there."""


# Reading

_NAME = r"[^\W\d][\w.-]*"
_TOKEN = re.compile(rf"""\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>'[^']*'|"[^"]*")|(?P<var>\$(?:{_NAME}:)?{_NAME})|(?P<name>{_NAME}(?::(?!:)(?:\*|{_NAME}))?)|(?P<sign>//|::|\.\.|!=|<=|>=|[/@\[\]()|,.=<>*+-]))""")
_KINDS = {"text": "text", "node": None, "comment": "comment", "processing-instruction": "pi"}
_LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))
_AXES = {*CONDITIONS, "attribute", "namespace"}
_ANY = ("descendant-or-self", (None, None, None, None), [])


class Reader:
    """Reads an expression into terms.

    ("num", x), ("str", s), ("var", name), ("call", name, terms), ("neg", term), (operator,
    term, term), ("filter", term, predicates) and ("path", start, steps), where start is
    "/", "." or a term and a step is (axis, (name, kind, namespace, target), predicates).
    """

    def __init__(self, text: str, namespaces: dict[str, str]):
        self.text, self.namespaces, self.tokens, at, end = text, namespaces, [], 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"{text!r} can't be read from {text[at:]!r}")
            kind, token = m.lastgroup, m[m.lastgroup]
            # After an operand, * and the names of operators are operators.
            after = self.tokens and (self.tokens[-1][0] not in ("sign", "op") or self.tokens[-1] in (("sign", "*"), *(("sign", x) for x in ("]", ")", ".", ".."))))
            if after and token in ("and", "or", "div", "mod", "*"):
                kind = "op"
            self.tokens.append((kind, token))
            at = m.end()
        self.at = 0

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def next(self, ahead: int = 0) -> str:
        """The token, but for texts: these are never a sign."""
        kind, token = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("", "")
        return "" if kind == "str" else token

    def take(self, *wanted: str) -> str:
        token = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
        if not token or (wanted and self.next() not in wanted):
            raise PathError(f"{self.text!r}: {' or '.join(wanted) or 'more'} expected, not {token or 'the end'!r}")
        self.at += 1
        return token

    def whole(self) -> Term:
        out = self.term()
        if self.at < len(self.tokens):
            raise PathError(f"{self.text!r} can't be read from {self.tokens[self.at][1]!r}")
        return out

    def term(self, level: int = 0) -> Term:
        if level == len(_LEVELS):
            if self.next() == "-":
                self.take()
                return "neg", self.term(level)
            return self.union()
        out = self.term(level + 1)
        while self.next() in _LEVELS[level] and self.kind() in ("op", "sign"):
            out = (self.take(), out, self.term(level + 1))
        return out

    def union(self) -> Term:
        out = self.path()
        while self.next() == "|":
            out = (self.take(), out, self.path())
        return out

    def path(self) -> Term:
        start = "."
        if self.next() in ("/", "//"):
            start = "/"
            if self.next() == "/":
                self.take()
                if not (self.kind() == "name" or self.next() in ("@", ".", "..", "*")):
                    return "path", "/", []
                return "path", "/", self.steps([])
            self.take()
            return "path", "/", self.steps([_ANY])
        primary = self.primary()
        if primary is None:
            return "path", start, self.steps([])
        predicates = self.predicates()
        if predicates:
            primary = ("filter", primary, predicates)
        if self.next() in ("/", "//"):
            return "path", primary, self.steps([_ANY] if self.take() == "//" else [])
        return primary

    def primary(self) -> Term | None:
        kind, token = self.kind(), self.next()
        if kind == "num":
            return "num", float(self.take())
        if kind == "str":
            return "str", self.take()[1:-1]
        if kind == "var":
            return "var", self.take()[1:]
        if token == "(":
            self.take()
            out = self.term()
            self.take(")")
            return out
        if kind == "name" and self.next(1) == "(" and token not in _KINDS:
            name, args = self.take(), []
            self.take("(")
            while self.next() != ")":
                args.append(self.term())
                if self.next() != ")":
                    self.take(",")
            self.take(")")
            return "call", name, args
        return None

    def predicates(self) -> list[Term]:
        out = []
        while self.next() == "[":
            self.take()
            out.append(self.term())
            self.take("]")
        return out

    def steps(self, before: list) -> list:
        out = before
        while True:
            out.append(self.step())
            if self.next() not in ("/", "//"):
                return _shortened(out)
            if self.take() == "//":
                out.append(_ANY)

    def step(self):
        if self.next() in (".", ".."):
            return ("self" if self.take() == "." else "parent"), (None, None, None, None), []
        axis = "child"
        if self.next() == "@":
            self.take()
            axis = "attribute"
        elif self.kind() == "name" and self.next(1) == "::":
            axis = self.take()
            if axis not in _AXES:
                raise PathError(f"{self.text!r}: no such axis: {axis}")
            self.take("::")
        if not (self.kind() == "name" or self.next() == "*"):
            raise PathError(f"{self.text!r}: a step expected, not {self.next() or 'the end'!r}")
        name, kind, namespace, target = self.take(), "element", None, None
        if self.next() == "(":
            if name not in _KINDS:
                raise PathError(f"{self.text!r}: no such node test: {name}()")
            self.take("(")
            if name == "processing-instruction" and self.kind() == "str":
                target = self.take()[1:-1]
            self.take(")")
            name, kind = None, _KINDS[name]
        elif ":" in name:
            prefix, name = name.split(":")
            if prefix not in self.namespaces:
                raise PathError(f"{self.text!r}: no namespace for the prefix {prefix}")
            namespace = self.namespaces[prefix]
        return axis, (name, kind, namespace, target), self.predicates()


def _shortened(steps: list) -> list:
    """descendant-or-self::node()/child::x is descendant::x where no predicate asks for a position."""
    out: list = []
    for s in steps:
        if out and out[-1] == _ANY and s[0] == "child" and not any(_asks(p) or kind_of(p) == "number" for p in s[2]):
            out[-1] = ("descendant", *s[1:])
        else:
            out.append(s)
    return out


_NUMBERS = {"position", "last", "count", "sum", "number", "floor", "ceiling", "round", "abs", "string-length", "min", "max"}
_BOOLEANS = {"boolean", "not", "true", "false", "lang", "contains", "starts-with", "ends-with", "matches", "exists", "empty"}
_NODES = {"id", "reverse"}


def kind_of(term: Term, variables: dict | None = None) -> str:
    """The type of a term: number, string, boolean or nodes; it is known before anything runs."""
    head = term[0]
    if head in ("num", "neg", "+", "-", "*", "div", "mod"):
        return "number"
    if head == "str":
        return "string"
    if head == "var":
        v = (variables or {}).get(term[1])
        return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
    if head == "call":
        return "number" if term[1] in _NUMBERS else "boolean" if term[1] in _BOOLEANS else "nodes" if term[1] in _NODES else "string"
    return "nodes" if head in ("path", "filter", "|") else "boolean"


def _asks(term, what: tuple[str, ...] = ("position", "last")) -> bool:
    """Whether a predicate calls position() or last() for its own context."""
    if term[0] == "call":
        return term[1] in what or any(_asks(t, what) for t in term[2])
    if term[0] in ("num", "str", "var"):
        return False
    if term[0] == "path":
        return isinstance(term[1], tuple) and _asks(term[1], what)
    if term[0] == "filter":
        return _asks(term[1], what)
    return any(_asks(t, what) for t in term[1:])


# Node-sets and contexts


@dataclass(frozen=True)
class Nodes:
    """A node-set: rows of the node table with idx, the context (c_pre, c_idx) that positions count in and, if carried, the origin."""

    rows: DataFrame
    carried: bool
    attrs: bool = False  # whether attribute nodes may be among the rows
    trees: bool = True
    axis: str = "self"
    unique: bool = True  # whether each node comes once for an origin
    root: bool = False  # just the document nodes
    backward: bool = False  # reverse(): the first node is the last in document order
    own: bool = False  # whether these are just the contexts, each as its own origin

    @property
    def key(self) -> list[str]:
        return ["doc_id", "o_pre", "o_idx"] if self.carried else ["doc_id"]

    def distinct(self) -> Nodes:
        if self.unique:
            return self
        return replace(self, rows=self.rows.dropDuplicates([*self.key, "pre", "idx"]), unique=True)


class Contexts:
    """The rows in which an expression is evaluated; each value that has to be joined becomes a column of ``rows``."""

    def __init__(self, nodes: Nodes, top: bool):
        self.nodes, self.base, self.rows, self.top, self.n = nodes, nodes.rows, nodes.rows, top, 0

    def name(self) -> str:
        self.n += 1
        return f"value{self.n}_"

    def join(self, folded: DataFrame, carried: bool, *columns: str) -> list[Column]:
        """Columns of a table that is folded by the origin, if carried, or else by document; null where it has no row."""
        names = [self.name() for _ in columns]
        keys = {"doc_id": self.name()} | ({"o_pre": self.name(), "o_idx": self.name()} if carried else {})
        table = folded.select(*[F.col(k).alias(v) for k, v in keys.items()], *[F.col(c).alias(x) for c, x in zip(columns, names, strict=True)])
        mine = {"doc_id": "doc_id", "o_pre": "pre", "o_idx": "idx"}
        on = [F.col(mine[k]) == F.col(v) for k, v in keys.items()]
        self.rows = self.rows.join(table, on, "left").drop(*keys.values())
        return [F.col(x) for x in names]


_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "div": numbers.divide, "mod": numbers.modulo}


def _compared(op: str, a: Column, b: Column, kind: str) -> Column:
    """Two values of one type; NaN equals nothing and is in no order."""
    if kind != "number":
        return _COMPARE[op](a, b)
    nan = F.isnan(a) | F.isnan(b)
    return (nan | (a != b)) if op == "!=" else ~nan & _COMPARE[op](a, b)


class Compiler:
    """Turns terms into columns of contexts, and paths into node-sets."""

    def __init__(self, table: DataFrame, variables: dict[str, float | str | bool]):
        self.table, self.variables = table.withColumn("idx", F.lit(0)), variables
        self.columns = self.table.columns

    # Paths

    def root(self) -> Nodes:
        rows = self.table.filter("kind = 'document'").withColumn("c_pre", F.lit(0)).withColumn("c_idx", F.lit(0))
        return Nodes(rows, False, root=True)

    def start(self, at: Contexts) -> Nodes:
        """Each context node, as the origin of a path."""
        if at.top:
            return self.root()
        rows = at.base.select(*self.columns)
        if at.nodes.carried or not at.nodes.unique:
            rows = rows.dropDuplicates(["doc_id", "pre", "idx"])
        for a in ("o", "c"):
            rows = rows.withColumn(f"{a}_pre", F.col("pre")).withColumn(f"{a}_idx", F.col("idx"))
        return Nodes(rows, True, at.nodes.attrs, at.nodes.trees, own=True)

    def nodes(self, term: Term, at: Contexts) -> Nodes:
        if term[0] == "|":
            return self.union(self.nodes(term[1], at), self.nodes(term[2], at), at)
        if term[0] == "path":
            s = self.root() if term[1] == "/" else self.start(at) if term[1] == "." else self.nodes(term[1], at)
            for axis, test, predicates in term[2]:
                s = self.step(s, axis, test, any(_asks(p) or self.kind(p) == "number" for p in predicates))
                for p in predicates:
                    s = self.predicate(s, p)
            return s
        if term[0] == "filter":
            s = self.nodes(term[1], at).distinct()
            rows = s.rows.withColumn("c_pre", F.lit(0)).withColumn("c_idx", F.lit(0))
            s = replace(s, rows=rows, axis="preceding" if s.backward else "self", root=False, own=False)
            for p in term[2]:
                s = self.predicate(s, p)
            return s
        if term[:2] == ("call", "id"):
            return self.by_id(self.arguments(term, 1)[0], at)
        if term[:2] == ("call", "reverse"):
            s = self.nodes(self.arguments(term, 1)[0], at)
            return replace(s, backward=not s.backward)
        raise PathError(f"a node-set expected, not {term[0]} {term[1]!r}")

    def step(self, s: Nodes, axis: str, test: tuple, positions: bool) -> Nodes:
        name, kind, namespace, target = test
        wanted = node_test(name, kind, namespace)
        if target is not None:
            wanted = wanted & (F.col("name") == target)
        origin = ["o_pre", "o_idx"] if s.carried else []
        if axis == "self":
            if kind is not None:
                return replace(s, rows=s.rows.filter((F.col("idx") == 0) & wanted), attrs=False, root=False, own=False)
            return s
        if s.root and axis in ("child", "descendant", "descendant-or-self"):
            # All other nodes are below the root: a filter.
            depth = {"child": F.col("depth") == 1, "descendant": F.col("depth") > 0, "descendant-or-self": F.lit(True)}[axis]
            rows = self.table.filter(wanted & depth).withColumn("c_pre", F.lit(0)).withColumn("c_idx", F.lit(0))
            return Nodes(rows, False, axis="child")
        if s.own and s.trees and axis == "child":
            # A child tells its parent, and what is made of a set meets the contexts by their origin: no join is needed for the step.
            rows = self.table.filter(wanted & F.col("parent").isNotNull()).select(*self.columns, *[F.col("parent").alias(x) if x.endswith("pre") else F.lit(0).alias(x) for x in (*origin, "c_pre", "c_idx")])
            return Nodes(rows, True, axis="child")
        s = s.distinct()
        if axis == "attribute":
            if kind not in ("element", None):
                return replace(s, rows=s.rows.filter("false"), attrs=True, trees=False, root=False, own=False)
            owners = s.rows.filter("idx = 0") if s.attrs else s.rows
            a = F.col("attr")
            rows = attributes(owners.drop("c_pre", "c_idx"), name, namespace)
            own = {"idx": F.col("attr_idx") + 1, "kind": F.lit("attribute"), "name": a["name"], "prefix": a["prefix"], "namespace": a["namespace"], "content": a["value"], "post": F.col("pre"), "parent": F.col("pre"), "depth": F.col("depth") + 1, "attrs": F.lit(None).cast(self.table.schema["attrs"].dataType)}
            rows = rows.select(*[own.get(c, F.col(c)).alias(c) for c in self.columns], *origin, F.col("pre").alias("c_pre"), F.lit(0).alias("c_idx"))
            return Nodes(rows, s.carried, attrs=True, trees=False, axis="child")
        if axis == "namespace":
            # As the namespaces of an element stand for the element, it is what this axis gives.
            rows = s.rows.filter("kind = 'element'")
            if name not in (None, "*", "xml"):
                scope = in_scope_namespaces(rows.select("doc_id", "pre").distinct(), self.table).filter(F.col("prefix") == name)
                rows = rows.join(scope.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
            return replace(s, rows=rows.select(*s.rows.columns), attrs=False, axis="self", root=False, own=False)
        parts = []
        if s.trees:
            parts.append(self.reached(s.rows.filter("idx = 0") if s.attrs else s.rows, axis, wanted, origin, positions))
        if s.attrs:
            owned = s.rows.filter("idx > 0")
            if axis in ("parent", "ancestor", "ancestor-or-self", "following", "preceding"):
                parts.append(self.reached(owned, "ancestor-or-self" if axis == "ancestor" else axis, wanted, origin, positions))
            if kind is None and axis.endswith("-or-self"):
                parts.append(owned.withColumn("c_pre", F.col("pre")).withColumn("c_idx", F.col("idx")).select(*self.columns, *origin, "c_pre", "c_idx"))
        if not parts:
            return replace(s, rows=s.rows.filter("false"), root=False, own=False)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return Nodes(rows, s.carried, attrs=s.attrs and kind is None and axis.endswith("-or-self"), axis=axis, unique=axis == "child")

    def reached(self, context: DataFrame, axis: str, wanted: Column, origin: list[str], positions: bool) -> DataFrame:
        columns = [F.col("doc_id").alias("c_doc"), *origin, *[F.col(x).alias(f"c_{x}") for x in ("pre", "idx", "post", "parent")]]
        c = context.select(*columns)
        if axis in ("following", "preceding") and not positions:
            # All that follows any of a set follows the one that ends first: one context is left.
            best = F.min("c_post") if axis == "following" else F.max("c_pre")
            c = c.groupBy("c_doc", *origin).agg(best.alias("c_post" if axis == "following" else "c_pre"))
            for x in ({"c_pre", "c_post", "c_idx", "c_parent"} - set(c.columns)):
                c = c.withColumn(x, F.lit(0))
        return joined(self.table.filter(wanted), c, axis).select(*self.columns, *origin, "c_pre", "c_idx")

    def predicate(self, s: Nodes, term: Term) -> Nodes:
        names, whole = s.rows.columns, term[0] == "num"
        by = [*s.key, "c_pre", "c_idx"]
        order = [F.col("pre"), F.col("idx")]
        if s.axis in REVERSE:
            order = [c.desc() for c in order]
        rows = s.rows
        if self.kind(term) == "number" or _asks(term, ("position",)):
            rows = rows.withColumn("position_", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        if _asks(term, ("last",)):
            rows = rows.withColumn("last_", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        if whole:
            return replace(s, rows=rows.filter(F.col("position_") == F.lit(term[1])).select(*names), root=False, own=False)
        at = Contexts(replace(s, rows=rows), False)
        kind, value = self.scalar(term, at) if self.kind(term) != "nodes" else ("boolean", self.truth(term, at))
        test = (F.col("position_").cast("double") == value) if kind == "number" else self.converted("boolean", kind, value)
        return replace(s, rows=at.rows.filter(F.coalesce(test, F.lit(False))).select(*names), root=False, own=False)

    def union(self, a: Nodes, b: Nodes, at: Contexts) -> Nodes:
        if a.carried != b.carried:  # one side is the document's, the other the context's
            start = self.start(at).rows.select(F.col("doc_id").alias("s_doc"), "o_pre", "o_idx")
            give = lambda s: s if s.carried else replace(s.distinct(), rows=s.distinct().rows.join(start, F.col("doc_id") == F.col("s_doc")).drop("s_doc"), carried=True)
            a, b = give(a), give(b)
        columns = [*self.columns, *(["o_pre", "o_idx"] if a.carried else [])]
        rows = a.rows.select(*columns).unionByName(b.rows.select(*columns)).withColumn("c_pre", F.lit(0)).withColumn("c_idx", F.lit(0))
        return Nodes(rows, a.carried, a.attrs or b.attrs, a.trees or b.trees, unique=False).distinct()

    def by_id(self, term: Term, at: Contexts) -> Nodes:
        """Elements whose id, by name or by declared type, is one of the tokens; of several with one id in a document, the last."""
        if self.kind(term) == "nodes":
            found = self.nodes(term, at)
            tokens, carried = self.valued(found), found.carried
        else:
            value, carried = self.value("string", term, at), not at.top
            tokens = at.rows.withColumn("value", value).withColumn("o_pre", F.col("pre")).withColumn("o_idx", F.col("idx"))
        key = ["doc_id", "o_pre", "o_idx"] if carried else ["doc_id"]
        tokens = tokens.select(*key, F.explode(F.split(F.trim("value"), r"\s+")).alias("id_")).filter("id_ <> ''").distinct()
        ids = identifiers(self.table).withColumnRenamed("id", "id_")
        last = ids.groupBy("doc_id", "id_").agg(F.max("pre").alias("pre"))
        hit = tokens.join(last, ["doc_id", "id_"]).select(*key, "pre")
        rows = self.table.join(hit, ["doc_id", "pre"]).select(*self.columns, *key[1:], F.lit(0).alias("c_pre"), F.lit(0).alias("c_idx"))
        return Nodes(rows, carried, unique=True)

    # Values

    def kind(self, term: Term) -> str:
        return kind_of(term, self.variables)

    def arguments(self, term: Term, least: int, most: int | None = None) -> list[Term]:
        if not least <= len(term[2]) <= (least if most is None else most):
            raise PathError(f"{term[1]}() doesn't take {len(term[2])} arguments")
        return term[2]

    def inline(self, term: Term, at: Contexts) -> tuple[Column, Column] | None:
        """(value, existence) of a path that reaches one node of each context at most without a join: an attribute by name, or the context itself."""
        if term[0] != "path" or term[1] != "." or len(term[2]) != 1 or at.top:
            return None
        axis, (name, kind, namespace, target), predicates = term[2][0]
        if predicates or target is not None or namespace is not None:
            return None
        if axis == "attribute" and kind == "element" and name != "*":
            value = attr(name)
            return value, value.isNotNull()
        if axis == "self" and kind is None:
            name = at.name()
            valued = string_value(at.rows, self.table) if at.nodes.trees else at.rows.withColumn("value", F.coalesce("content", F.lit("")))
            at.rows = valued.withColumnRenamed("value", name)
            return F.col(name), F.lit(True)
        return None

    def valued(self, s: Nodes) -> DataFrame:
        """The distinct nodes with ``value``, their string-value."""
        s = s.distinct()
        rows = s.rows.drop("c_pre", "c_idx")
        return string_value(rows, self.table) if s.trees else rows.withColumn("value", F.coalesce("content", F.lit("")))

    def fold(self, s: Nodes, at: Contexts, rows: DataFrame, *folds: Column) -> list[Column]:
        named = [f.alias(f"fold{k}_") for k, f in enumerate(folds)]
        return at.join(rows.groupBy(*s.key).agg(*named), s.carried, *[f"fold{k}_" for k in range(len(folds))])

    def first(self, s: Nodes, at: Contexts, rows: DataFrame, what: Column) -> Column:
        pick = F.max_by if s.backward else F.min_by
        return self.fold(s, at, rows, pick(what, F.struct("pre", "idx")))[0]

    def truth(self, term: Term, at: Contexts) -> Column:
        """Whether a node-set holds anything."""
        if found := self.inline(term, at):
            return found[1]
        s = self.nodes(term, at)
        flagged = s.rows.select(*s.key).distinct().withColumn("flag_", F.lit(True))
        return F.coalesce(at.join(flagged, s.carried, "flag_")[0], F.lit(False))

    def scalar(self, term: Term, at: Contexts) -> tuple[str, Column]:
        """(type, column) of a term that is no node-set."""
        head = term[0]
        if head in ("num", "str"):
            return ("number" if head == "num" else "string"), F.lit(term[1])
        if head == "var":
            if term[1] not in self.variables:
                raise PathError(f"no such variable: ${term[1]}")
            v = self.variables[term[1]]
            return self.kind(term), F.lit(v if isinstance(v, (bool, str)) else float(v))
        if head in ("or", "and"):
            a, b = (self.value("boolean", t, at) for t in term[1:])
            return "boolean", (a | b if head == "or" else a & b)
        if head in _COMPARE:
            return "boolean", self.compare(head, term[1], term[2], at)
        if head == "neg":
            return "number", -self.value("number", term[1], at)
        if head in _ARITHMETIC:
            a, b = (self.value("number", t, at) for t in term[1:])
            return "number", _ARITHMETIC[head](a, b)
        return self.call(term, at)

    def value(self, want: str, term: Term, at: Contexts) -> Column:
        """A term as a string, number or boolean."""
        if self.kind(term) != "nodes":
            return self.converted(want, *self.scalar(term, at))
        if want == "boolean":
            return self.truth(term, at)
        if found := self.inline(term, at):
            text = F.coalesce(found[0], F.lit(""))
        else:
            s = self.nodes(term, at)
            text = F.coalesce(self.first(s, at, self.valued(s), F.col("value")), F.lit(""))
        return self.converted(want, "string", text)

    @staticmethod
    def converted(want: str, kind: str, value: Column) -> Column:
        if want == kind:
            return value
        if want == "number":
            return numbers.to_number(value) if kind == "string" else F.when(value, 1.0).otherwise(0.0)
        if want == "string":
            return numbers.to_text(value) if kind == "number" else F.when(value, "true").otherwise("false")
        return numbers.truth_of_number(value) if kind == "number" else numbers.truth_of_text(value)

    def compare(self, op: str, a: Term, b: Term, at: Contexts) -> Column:
        ka, kb = self.kind(a), self.kind(b)
        if ka != "nodes" and kb == "nodes":
            return self.compare(_FLIP.get(op, op), b, a, at)
        ordered = op not in ("=", "!=")
        if ka != "nodes":
            kind = "number" if ordered or "number" in (ka, kb) and "boolean" not in (ka, kb) else "boolean" if "boolean" in (ka, kb) else "string"
            return _compared(op, self.value(kind, a, at), self.value(kind, b, at), kind)
        if kb == "boolean":
            kind = "number" if ordered else "boolean"
            truth = self.truth(a, at)
            return _compared(op, self.converted(kind, "boolean", truth), self.value(kind, b, at), kind)
        if kb != "nodes":
            kind = "number" if ordered or kb == "number" else "string"
            return self.any_of(op, a, kind, self.value(kind, b, at), b[0] in ("num", "str", "var"), at)
        return self.two_sets(op, a, b, at)

    def any_of(self, op: str, term: Term, kind: str, other: Column, fixed: bool, at: Contexts) -> Column:
        """Whether some node's value compares with a value of the context."""
        own = (lambda v: numbers.to_number(v)) if kind == "number" else (lambda v: v)
        if found := self.inline(term, at):
            return F.coalesce(found[1] & _compared(op, own(found[0]), other, kind), F.lit(False))
        s = self.nodes(term, at)
        rows = self.valued(s).withColumn("own_", own(F.col("value")))
        if fixed:
            hit = rows.filter(_compared(op, F.col("own_"), other, kind)).select(*s.key).distinct().withColumn("flag_", F.lit(True))
            return F.coalesce(at.join(hit, s.carried, "flag_")[0], F.lit(False))
        if op == "=":  # a semi-join on the value, back to the contexts by it
            name = at.name()
            at.rows = at.rows.withColumn(name, F.nanvl(other, F.lit(None).cast("double")) if kind == "number" else other)
            hit = rows.filter(~F.isnan("own_")) if kind == "number" else rows
            hit = hit.select(*s.key, "own_").distinct()
            keys = {k: at.name() for k in [*s.key, "own_"]}
            mine = {"doc_id": "doc_id", "o_pre": "pre", "o_idx": "idx", "own_": name}
            flag = at.name()
            table = hit.select(*[F.col(k).alias(v) for k, v in keys.items()], F.lit(True).alias(flag))
            at.rows = at.rows.join(table, [F.col(mine[k]) == F.col(v) for k, v in keys.items()], "left").drop(*keys.values())
            return F.coalesce(F.col(flag), F.lit(False))
        low, high, nan = self.extremes(s, at, rows, kind)
        if op == "!=":
            some = low.isNotNull() & ((low != other) | (high != other) | (F.isnan(other) if kind == "number" else F.lit(False)))
            return F.coalesce(nan, F.lit(False)) | F.coalesce(some, F.lit(False))
        return F.coalesce(_compared(op, low if op in ("<", "<=") else high, other, kind), F.lit(False))

    def extremes(self, s: Nodes, at: Contexts, rows: DataFrame, kind: str) -> tuple[Column, Column, Column]:
        """Least and largest value by origin (NaN aside), and whether there is a NaN."""
        if kind != "number":
            low, high = self.fold(s, at, rows, F.min("own_"), F.max("own_"))
            return low, high, F.lit(False)
        real = F.when(~F.isnan("own_"), F.col("own_"))
        low, high, nan = self.fold(s, at, rows, F.min(real), F.max(real), F.bool_or(F.isnan("own_")))
        return low, high, nan

    def two_sets(self, op: str, a: Term, b: Term, at: Contexts) -> Column:
        """Whether some node of a compares with some node of b: a semi-join on the value, or their extremes."""
        x, y = self.nodes(a, at), self.nodes(b, at)
        if op == "=":
            if x.carried < y.carried:
                x, y = y, x
            mine, other = self.valued(x).select(*x.key, "value").distinct(), self.valued(y).select(*y.key, "value").distinct()
            hit = mine.join(other, [*y.key, "value"], "left_semi").select(*x.key).distinct().withColumn("flag_", F.lit(True))
            return F.coalesce(at.join(hit, x.carried, "flag_")[0], F.lit(False))
        kind = "string" if op == "!=" else "number"
        both = []
        for s in (x, y):
            rows = self.valued(s)
            both.append(self.extremes(s, at, rows.withColumn("own_", numbers.to_number(F.col("value")) if kind == "number" else F.col("value")), kind))
        (low, high, _), (low_b, high_b, _) = both
        if op == "!=":
            found = low.isNotNull() & low_b.isNotNull() & ~((low == high) & (low_b == high_b) & (low == low_b))
        else:
            found = _COMPARE[op](low, high_b) if op in ("<", "<=") else _COMPARE[op](high, low_b)
        return F.coalesce(found, F.lit(False))

    # Functions

    def call(self, term: Term, at: Contexts) -> tuple[str, Column]:
        name = term[1]
        if (make := _FUNCTIONS.get(name)) is None:
            raise PathError(f"no such function: {name}()")
        return make(self, term, at)

    def set_of(self, term: Term, at: Contexts) -> Nodes:
        if self.kind(term) != "nodes":
            raise PathError(f"a node-set expected, not {term[0]} {term[1]!r}")
        return self.nodes(term, at)


def _position(c: Compiler, term, at):
    c.arguments(term, 0)
    return "number", F.lit(1.0) if at.top else F.col(f"{term[1]}_").cast("double")


def _count(c: Compiler, term, at):
    (a,) = c.arguments(term, 1)
    if (found := c.inline(a, at)) is not None:
        return "number", F.when(found[1], 1.0).otherwise(0.0)
    s = c.set_of(a, at).distinct()
    return "number", F.coalesce(c.fold(s, at, s.rows, F.count(F.lit(1)))[0].cast("double"), F.lit(0.0))


def _number_fold(c: Compiler, term, at):
    (a,) = c.arguments(term, 1)
    s = c.set_of(a, at)
    rows = c.valued(s).withColumn("own_", numbers.to_number(F.col("value")))
    if term[1] == "sum":
        return "number", F.coalesce(c.fold(s, at, rows, F.sum("own_"))[0], F.lit(0.0))
    low, high, nan = c.extremes(s, at, rows, "number")
    return "number", F.coalesce(F.when(~nan, low if term[1] == "min" else high), F.lit(float("nan")))


def _empty(c: Compiler, term, at):
    (a,) = c.arguments(term, 1)
    if c.kind(a) != "nodes":
        raise PathError(f"{term[1]}() takes a node-set")
    found = c.truth(a, at)
    return "boolean", found if term[1] == "exists" else ~found


def _name(c: Compiler, term, at):
    qualified = F.when(F.length("prefix") > 0, F.concat(F.col("prefix"), F.lit(":"), F.col("name"))).otherwise(F.col("name"))
    named = F.col("kind").isin("element", "attribute", "pi")
    what = F.when(named, {"name": qualified, "local-name": F.col("name"), "namespace-uri": F.col("namespace")}[term[1]])
    if not c.arguments(term, 0, 1):
        return "string", F.coalesce(what, F.lit(""))
    s = c.set_of(term[2][0], at)
    return "string", F.coalesce(c.first(s, at, s.rows, F.coalesce(what, F.lit(""))), F.lit(""))


def _texts(least: int, most: int, kind: str, make: Callable[..., Column]):
    """A function of strings; a missing first argument is the context's string-value."""

    def of(c: Compiler, term, at):
        args = c.arguments(term, least, most) or [("path", ".", [("self", (None, None, None, None), [])])]
        return kind, make(*[c.value("string", a, at) for a in args])

    return of


def _of_number(make):
    def of(c: Compiler, term, at):
        return "number", make(c.value("number", c.arguments(term, 1)[0], at))

    return of


def _cast(kind: str):
    def of(c: Compiler, term, at):
        args = c.arguments(term, 1 if kind == "boolean" else 0, 1) or [("path", ".", [("self", (None, None, None, None), [])])]
        return kind, c.value(kind, args[0], at)

    return of


def _not(c: Compiler, term, at):
    return "boolean", ~c.value("boolean", c.arguments(term, 1)[0], at)


def _constant(c: Compiler, term, at):
    c.arguments(term, 0)
    return "boolean", F.lit(term[1] == "true")


def _substring(c: Compiler, term, at):
    text, *ends = c.arguments(term, 2, 3)
    return "string", strings.substring(c.value("string", text, at), *[c.value("number", e, at) for e in ends])


def _pattern(c: Compiler, term, at):
    """matches, replace and tokenize: the pattern, the replacement and the flags are literals."""
    name = term[1]
    args = c.arguments(term, {"matches": 2, "replace": 3, "tokenize": 1}[name], {"replace": 4}.get(name, 3))
    if any(a[0] != "str" for a in args[1:]):
        raise PathError(f"{name}() takes its pattern as a literal")
    text, rest = c.value("string", args[0], at), [a[1] for a in args[1:]]
    try:
        if name == "tokenize":
            return "string", F.array_join(strings.tokens(text, *rest), " ")
        return ("boolean", strings.matches(text, *rest)) if name == "matches" else ("string", strings.replace(text, *rest))
    except ValueError as e:
        raise PathError(str(e)) from e


def _translate(c: Compiler, term, at):
    args = c.arguments(term, 3)
    if any(a[0] != "str" for a in args[1:]):
        raise PathError("translate() takes its characters as literals")
    return "string", strings.translate(c.value("string", args[0], at), args[1][1], args[2][1])


def _join(c: Compiler, term, at):
    args = c.arguments(term, 1, 2)
    s = c.set_of(args[0], at)
    rows = c.valued(s)
    found = c.fold(s, at, rows, F.sort_array(F.collect_list(F.struct("pre", "idx", "value")), not s.backward))[0]
    between = c.value("string", args[1], at) if len(args) > 1 else F.lit("")
    return "string", F.coalesce(F.call_function("array_join", F.transform(found, lambda x: x["value"]), between), F.lit(""))


def _language(c: Compiler, term, at):
    (code,) = c.arguments(term, 1)
    if code[0] != "str":
        raise PathError("lang() takes a literal")
    s = c.start(at)
    rows = language(s.rows.select("doc_id", "pre").distinct(), c.table, code[1])
    flags = rows.select("doc_id", "pre").distinct().withColumn("flag_", F.lit(True))
    if at.top:
        return "boolean", F.lit(False)  # a document has no language
    name, keys = at.name(), [at.name(), at.name()]
    at.rows = at.rows.join(flags.toDF(*keys, name), (F.col("doc_id") == F.col(keys[0])) & (F.col("pre") == F.col(keys[1])), "left").drop(*keys)
    return "boolean", F.coalesce(F.col(name), F.lit(False))


_FUNCTIONS: dict[str, Callable] = {
    "position": _position, "last": _position, "count": _count, "sum": _number_fold, "min": _number_fold, "max": _number_fold, "empty": _empty, "exists": _empty, "name": _name, "local-name": _name, "namespace-uri": _name,
    "string": _cast("string"), "number": _cast("number"), "boolean": _cast("boolean"), "not": _not, "true": _constant, "false": _constant, "lang": _language, "string-join": _join, "substring": _substring, "translate": _translate,
    "matches": _pattern, "replace": _pattern, "tokenize": _pattern, "floor": _of_number(numbers.floor), "ceiling": _of_number(numbers.ceiling), "round": _of_number(numbers.round_half_up), "abs": _of_number(F.abs),
    "concat": _texts(2, 99, "string", F.concat), "contains": _texts(2, 2, "boolean", F.contains), "starts-with": _texts(2, 2, "boolean", F.startswith), "ends-with": _texts(2, 2, "boolean", F.endswith),
    "substring-before": _texts(2, 2, "string", strings.before), "substring-after": _texts(2, 2, "string", strings.after), "upper-case": _texts(1, 1, "string", F.upper), "lower-case": _texts(1, 1, "string", F.lower),
    "string-length": _texts(0, 1, "number", lambda s: F.char_length(s).cast("double")), "normalize-space": _texts(0, 1, "string", strings.normalize_space),
}


def evaluate(nodes: DataFrame, expression: str, namespaces: dict[str, str] | None = None, variables: dict[str, float | str | bool] | None = None) -> DataFrame:
    """The value of an expression in every document; the document node is the context.

    * A node-set of nodes of the table gives their rows, each once.
    * One of attributes gives (doc_id, pre, attr_idx, name, value), pre being the element's.
    * One that may hold both gives (doc_id, pre, attr_idx, kind, name, value), attr_idx null
      for nodes of the table and value the string-value.
    * A string, number or boolean gives (doc_id, value), every document one row.

    All of XPath 1.0 but node-valued variables, and of 2.0 the functions matches, replace,
    tokenize (joined by blanks), upper-case, lower-case, ends-with, string-join, exists,
    empty, abs, min, max and reverse.  ``namespaces`` gives the prefixes, ``variables`` the
    values of $names.  A name without a prefix matches in any namespace.  The namespace axis
    gives the element that has such a namespace in scope.  Patterns of regular expressions,
    the characters of translate() and the code of lang() are literals.

    What can't be read, an unknown function, axis, prefix or variable and a wrong type are a
    PathError, before anything runs.
    """
    c = Compiler(nodes, variables or {})
    term = Reader(expression, namespaces or {}).whole()
    at = Contexts(c.root(), True)
    if c.kind(term) != "nodes":
        _, value = c.scalar(term, at)
        return at.rows.select("doc_id", value.alias("value"))
    s = c.nodes(term, at).distinct()
    if not s.attrs:
        return s.rows.select(*nodes.columns)
    if not s.trees:
        return s.rows.select("doc_id", "pre", (F.col("idx") - 1).alias("attr_idx"), "name", F.coalesce("content", F.lit("")).alias("value"))
    return c.valued(s).select("doc_id", "pre", F.when(F.col("idx") > 0, F.col("idx") - 1).alias("attr_idx"), "kind", "name", "value")

