"""Validation as set operations: rules are small tables or Columns, violations a DataFrame.

Every check returns rows (doc_id, pre, rule, message); a document is valid if it has none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.types import BUILTIN
from thicket.operators.content import EMPTY, Model, el, fits, interleave, names_of, one_of, parse, seq, times
from thicket.operators.folding import Children, Fold
from thicket.operators.ordered import in_order, whole
from thicket.operators.selection import Selection, attr

__all__ = ["Dtd", "Rule", "Shape", "check_dtd", "check_rules", "check_shapes", "dtd_table", "el", "interleave", "one_of", "seq", "times", "verdicts"]

NAME = r"^[\p{L}_:][\p{L}\p{N}._:\-·\p{M}]*$"
NMTOKEN = r"^[\p{L}\p{N}._:\-·\p{M}]+$"


def _violation(rows: DataFrame, rule: str, message: Column | str) -> DataFrame:
    return rows.select("doc_id", "pre", F.lit(rule).alias("rule"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(nodes: DataFrame, violations: DataFrame) -> DataFrame:
    """(doc_id, is_valid, n_errors) for every document."""
    counts = violations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_errors"))
    docs = nodes.filter("kind = 'document'").select("doc_id").join(counts, "doc_id", "left")
    return docs.select("doc_id", F.col("n_errors").isNull().alias("is_valid"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"))


def child_names(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, depth, name, attrs, children, n_text): each element with its child elements' names in order."""
    inner = nodes.filter("kind in ('element', 'text', 'cdata') and depth > 1").select("doc_id", F.col("parent").alias("pre"), F.when(F.col("kind") == "element", F.struct("ord", "name")).alias("c"), ((F.col("kind") == "cdata") | ((F.col("kind") == "text") & F.col("content").rlike(r"[^ \t\r\n]"))).alias("t"))
    found = inner.groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list("c")).alias("cs"), F.sum(F.col("t").cast("int")).alias("n_text"))
    own = nodes.filter("kind = 'element'").select("doc_id", "pre", "depth", "name", "attrs").join(found, ["doc_id", "pre"], "left")
    names = F.coalesce(F.transform("cs", lambda x: x["name"]), F.array().cast("array<string>"))
    return own.select("doc_id", "pre", "depth", "name", "attrs", names.alias("children"), F.coalesce("n_text", F.lit(0)).alias("n_text"))


def _found(rule: str, message: Column | str, bad: Column) -> Column:
    """A struct(rule, message) where ``bad`` holds, else null."""
    message = message if isinstance(message, Column) else F.lit(message)
    return F.when(bad, F.struct(F.lit(rule).alias("rule"), message.alias("message")))


_FOUND = "array<struct<rule:string,message:string>>"


def _by_name(checks: dict[str, list[Column]], otherwise: list[Column]) -> Column:
    """The violations of a row: those of its element's name, found in one pass over the rows."""
    out = None
    for name, found in checks.items():
        value = F.array(*found).cast(_FOUND)
        out = F.when(F.col("name") == name, value) if out is None else out.when(F.col("name") == name, value)
    rest = F.array(*otherwise).cast(_FOUND)
    return F.array_compact(rest if out is None else out.otherwise(rest))


def _listed(rows: DataFrame, found: Column) -> DataFrame:
    """A row for each violation in an array of them."""
    return rows.select("doc_id", "pre", F.explode(found).alias("v")).select("doc_id", "pre", F.col("v.rule").alias("rule"), F.col("v.message").alias("message"))


def _real(a: Column) -> Column:
    """Whether an attribute is one, and no namespace declaration."""
    return (F.coalesce(a["prefix"], F.lit("")) != "xmlns") & (a["name"] != "xmlns")


def _strangers(known: list[str], message) -> Column:
    """A violation for each attribute of other names."""
    other = F.filter(F.coalesce("attrs", F.array()), lambda a: _real(a) & ~a["name"].isin(known or [""]))
    return F.transform(other, lambda a: F.struct(F.lit("undeclared-attribute").alias("rule"), message(a).alias("message"))).cast(_FOUND)


@dataclass
class Dtd:
    """Declarations as values: element -> content model, (element, attribute) -> (type, default)."""

    elements: dict[str, str] = field(default_factory=dict)
    attributes: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    root: str | None = None

    @classmethod
    def parse(cls, text: str, root: str | None = None) -> Dtd:
        """From declarations in text; parameter entities are put in first, comments left out.

        Entities that name each other in a circle, or lie over 32 deep, raise a ValueError.
        """
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
        entities = dict(re.findall(r"<!ENTITY\s+%\s+([\w.:-]+)\s+[\"']([^\"']*)[\"']\s*>", text))
        for _ in range(32):
            new = re.sub(r"%([\w.:-]+);", lambda m: entities.get(m[1], ""), text)
            if new == text:
                break
            text = new
        else:
            raise ValueError("parameter entities are nested over 32 deep or in a circle")
        dtd = cls(root=root)
        for name, model in re.findall(r"<!ELEMENT\s+(\S+)\s+([^>]+?)\s*>", text):
            if name in dtd.elements:
                raise ValueError(f"element {name} is declared twice")
            dtd.elements[name] = model
        for element, body in re.findall(r"<!ATTLIST\s+(\S+)\s+([^>]*)>", text):
            for name, kind, default in re.findall(r"(\S+)\s+(NOTATION\s*\([^)]*\)|\([^)]*\)|\w+)\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"[^\"]*\"|'[^']*'))", body):
                dtd.attributes.setdefault((element, name), (kind, default))
        return dtd


def _content_model(flat: str) -> Column | None:
    """What is wrong with an element's content under a declared model; None for any content."""
    if flat == "ANY":
        return None
    if flat == "EMPTY":
        return (F.size("children") > 0) | (F.col("n_text") > 0)
    if "#PCDATA" in flat:
        allowed = [x for x in re.split(r"[()|*]", flat) if x and x != "#PCDATA"]
        return F.exists("children", lambda x: ~x.isin(allowed)) if allowed else F.size("children") > 0
    return ~fits(F.col("children"), parse(flat)) | (F.col("n_text") > 0)


def check_dtd(nodes: DataFrame, dtd: Dtd) -> DataFrame:
    """Root, declared elements, content models, attributes, ID uniqueness, IDREF resolution.

    All declarations of an element are one branch of one expression, so a document's elements
    are passed over once; content models are folded over the children (``content``), however
    many; identifiers are an aggregation and an anti-join.
    """
    rows, elements = child_names(nodes), nodes.filter("kind = 'element'")
    typed = {"ID": NAME, "IDREF": NAME, "ENTITY": NAME, "NMTOKEN": NMTOKEN}
    lists = {"IDREFS": NAME, "ENTITIES": NAME, "NMTOKENS": NMTOKEN}
    checks: dict[str, list[Column]] = {name: [] for name in [*dtd.elements, *[e for e, _ in dtd.attributes]]}
    for name, declared in dtd.elements.items():
        flat = re.sub(r"\s+", "", declared)
        bad = _content_model(flat)
        if bad is not None:
            checks[name].append(_found("content-model", f"content of {name} doesn't fit {flat}", bad))
    ids, refs = [], []
    for (element, name), (kind, default) in dtd.attributes.items():
        value, found = attr(name), checks[element]
        mine = elements.filter((F.col("name") == element) & value.isNotNull())
        if default == "#REQUIRED":
            found.append(_found("required-attribute", f"{element} lacks {name}", value.isNull()))
        if default.startswith("#FIXED"):
            found.append(_found("fixed-attribute", f"{name} differs from its fixed value", value != default[6:].strip()[1:-1]))
        if kind in typed:
            found.append(_found("attribute-type", f"{name} isn't a valid {kind}", ~value.rlike(typed[kind])))
        if kind in lists:
            found.append(_found("attribute-type", f"{name} isn't a valid {kind}", ~F.forall(F.split(F.trim(value), r"\s+"), _is(lists[kind]))))
        if "(" in kind:
            allowed = [x.strip() for x in kind[kind.index("(") + 1 : -1].split("|")]
            found.append(_found("attribute-type", f"{name} isn't one of {', '.join(allowed)}", ~value.isin(allowed)))
        if kind == "ID":
            ids.append(mine.select("doc_id", "pre", value.alias("value")))
        if kind in ("IDREF", "IDREFS"):
            refs.append(mine.select("doc_id", "pre", F.explode(F.split(F.trim(value), r"\s+")).alias("value")))
    stranger = _found("undeclared-element", F.concat(F.lit("undeclared element "), F.col("name")), ~F.col("name").isin(list(dtd.elements) or [""]))
    wrong_root = _found("root", "root element isn't the declared one", (F.col("depth") == 1) & (F.col("name") != (dtd.root or ""))) if dtd.root else None
    always = [x for x in (stranger, wrong_root) if x is not None]
    unknown = _by_element(dtd)
    out = [_listed(rows, F.concat(_by_name({n: [*found, *always] for n, found in checks.items()}, always), unknown))]
    if ids:
        every = _all(ids)
        twice = every.groupBy("doc_id", "value").agg(F.min("pre").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        out.append(_violation(every.join(twice, ["doc_id", "value"]).filter("pre > first"), "duplicate-id", F.concat(F.lit("id "), F.col("value"), F.lit(" occurs before"))))
    if refs:
        target = _all(ids) if ids else nodes.limit(0).select("doc_id", "pre", F.lit("").alias("value"))
        out.append(_violation(_all(refs).join(target.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti"), "dangling-idref", F.concat(F.lit("no id "), F.col("value"))))
    return _all(out)


def _by_element(dtd: Dtd) -> Column:
    """The violations by attributes that a row's element doesn't declare."""
    message = lambda a: F.concat(F.lit("undeclared attribute "), a["name"])
    out = None
    for element in dict.fromkeys(e for e, _ in dtd.attributes):
        value = _strangers([a for e, a in dtd.attributes if e == element], message)
        out = F.when(F.col("name") == element, value) if out is None else out.when(F.col("name") == element, value)
    rest = _strangers([], message)
    return rest if out is None else out.otherwise(rest)


def _is(pattern: str):
    return lambda x: x.rlike(pattern)


@dataclass
class Shape:
    """What an element of a name may be: a grammar's rule with its types as names or Columns.

    ``content`` is a model of the children (see ``content``), None for any; ``text`` the type
    of the text (None: no text, "mixed": any); ``attributes`` name -> (type, required);
    ``closed`` forbids other attributes.
    """

    content: Model | None = EMPTY
    text: str | None = None
    attributes: dict[str, tuple[str, bool]] = field(default_factory=dict)
    facets: dict[str, object] = field(default_factory=dict)
    closed: bool = False


def check_shapes(nodes: DataFrame, root: str, shapes: dict[str, Shape]) -> DataFrame:
    """XSD- and RelaxNG-like rules: root, content, text types with facets, attributes.

    One pass over the elements for what they show themselves, one over the values of those that
    have a text type, one for texts where none may be; models are folded over the children
    document by document (``folding``).
    """
    from thicket.functions.types import facets_ok

    elements = nodes.filter("kind = 'element'")
    always = [_found("root", f"root element isn't {root}", (F.col("depth") == 1) & (F.col("name") != root))]
    stranger = _found("undeclared-element", F.concat(F.lit("undeclared element "), F.col("name")), F.lit(True))
    checks, values = {}, {}
    for name, s in shapes.items():
        found = list(always)
        if s.text not in (None, "mixed"):
            ok = BUILTIN[s.text](F.col("value")) & facets_ok(F.col("value"), s.text, s.facets)
            values[name] = [_found("type", f"text of {name} isn't a valid {s.text}", ~F.coalesce(ok, F.lit(False)))]
        for a, (kind, required) in s.attributes.items():
            if required:
                found.append(_found("required-attribute", f"{name} lacks {a}", attr(a).isNull()))
            found.append(_found("attribute-type", f"{a} isn't a valid {kind}", attr(a).isNotNull() & ~F.coalesce(BUILTIN[kind](attr(a)), F.lit(False))))
        if s.closed:
            found.append(_found("undeclared-attribute", f"{name} has other attributes", F.exists("attrs", _other(list(s.attributes) or [""]))))
        checks[name] = found
    out = [_listed(elements, _by_name(checks, [*always, stranger]))]
    models = {name: s.content for name, s in shapes.items() if s.content is not None}
    if models:
        rows = in_order(elements.select("doc_id", "pre", "parent", "name"), "doc_id")
        out.append(rows.mapInArrow(lambda it: _misfits(it, models), "doc_id bigint, pre int, rule string, message string"))
    bare = [name for name, s in shapes.items() if s.text is None]
    if bare:
        texts = nodes.filter((F.col("depth") > 1) & ((F.col("kind") == "cdata") | ((F.col("kind") == "text") & F.col("content").rlike(r"[^ \t\r\n]")))).select("doc_id", F.col("parent").alias("pre"))
        having = elements.filter(F.col("name").isin(bare)).select("doc_id", "pre", "name").join(texts, ["doc_id", "pre"], "left_semi")
        out.append(_violation(having, "text", F.concat(F.col("name"), F.lit(" has text"))))
    if values:
        valued = Selection(nodes, elements.filter(F.col("name").isin(list(values))).withColumn("ctx", F.lit(0)), False, "child").strings()
        out.append(_listed(valued, _by_name(values, [])))
    return _all(out)


def _misfits(batches, models: dict[str, Model]):
    """The elements of whole documents whose children's names don't fit the model of their own."""
    number = {}
    for m in models.values():
        for name in names_of(m):
            number.setdefault(name, len(number))
    folds = {name: Fold(m, number) for name, m in models.items()}
    sets = [frozenset(), *[frozenset([i]) for i in range(len(number))]]
    for table in whole(batches, "doc_id"):
        children = Children(table)
        coded = table.column("name").combine_chunks().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        kind = np.array([number.get(x, -1) + 1 for x in names], np.int64)[codes]
        bad = []
        for code, name in enumerate(names):
            if name in folds:
                mine = np.flatnonzero(codes == code)
                bad.append(mine[~folds[name].takes(children, mine, kind, sets)])
        rows = np.concatenate([np.zeros(0, np.int64), *bad])
        said = pa.array([f"content of {names[c]} doesn't fit" for c in codes[rows]], pa.string())
        yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(pa.array(rows)) for c in ("doc_id", "pre")], pa.array(["content"] * len(rows), pa.string()), said], names=["doc_id", "pre", "rule", "message"])


def _other(names: list[str]):
    return lambda x: _real(x) & ~x["name"].isin(names)


@dataclass
class Rule:
    """A Schematron rule: a context selection and tests, each a Column over ``facts`` of the node."""

    context: object  # Selection -> Selection
    asserts: list[tuple[Column, str]] = field(default_factory=list)
    reports: list[tuple[Column, str]] = field(default_factory=list)
    facts: object = None  # (rows, nodes) -> rows with more columns, by which tests are written


def check_rules(nodes: DataFrame, patterns: dict[str, list[Rule]], phase: list[str] | None = None) -> DataFrame:
    """Of a pattern's rules, the first whose context holds a node fires for it.

    A failed assert is an error, a report that holds a warning: (doc_id, pre, rule, message, severity).
    Messages name columns in braces, whose values are put in.
    """
    unknown = set(phase or []) - set(patterns)
    if unknown:
        raise ValueError(f"no such pattern: {sorted(unknown)}")
    out = []
    for pattern, rules in patterns.items():
        if phase is not None and pattern not in phase:
            continue
        fired = None
        for k, rule in enumerate(rules):
            rows = rule.context(Selection(nodes)).nodes()
            if fired is not None:
                rows = rows.join(fired, ["doc_id", "pre"], "left_anti")
            here = rows.select("doc_id", "pre")
            fired = here if fired is None else fired.union(here)
            if rule.facts:
                rows = rule.facts(rows, nodes)
            for kind, tests in (("error", rule.asserts), ("warning", rule.reports)):
                for test, message in tests:
                    holds = F.coalesce(test, F.lit(False))
                    hit = rows.filter(~holds if kind == "error" else holds)
                    out.append(_violation(hit, f"{pattern}/{k}", _filled(message)).withColumn("severity", F.lit(kind)))
    return _all(out)


def _filled(message: str) -> Column:
    parts = re.split(r"\{(\w+)\}", message)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def dtd_table(spark: SparkSession, dtd: Dtd) -> DataFrame:
    """The declarations as text, in order: (ord, declaration)."""
    lines = [f"<!ELEMENT {n} {m}>" for n, m in dtd.elements.items()] + [f"<!ATTLIST {e} {a} {k} {d}>" for (e, a), (k, d) in dtd.attributes.items()]
    return spark.createDataFrame(list(enumerate(lines)) or [(0, "")], "ord int, declaration string")
