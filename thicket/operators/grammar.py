"""Regular tree grammars: an element may have one of several types, which its content decides.

Validation is a bottom-up tree automaton over the node table, one level of many documents at a
time, from the deepest: an element's types are those of its name whose attributes and text
fit and whose content model takes some choice of its children's types.  ``check_grammar`` folds
each model's automaton over the children of a batch of documents (``folding``); in
``element_types`` a level is an equi-join of all elements with their children's types and a fold
with the set of states as accumulator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.content import EMPTY, Model, automaton
from thicket.operators.folding import Children, Fold
from thicket.operators.ordered import in_order, whole
from thicket.schema import VALUE
from thicket.storage import bucketed, written

Test = Callable[[Column], Column]
#: Levels of elements that a document may have.
MOST_LEVELS = 1000


@dataclass
class Attribute:
    """What an attribute may be; namespace "" is none."""

    name: str
    test: Test | None = None
    required: bool = False
    namespace: str = ""

    def value(self) -> Column:
        same = lambda a: (a["name"] == self.name) & (F.coalesce(a["namespace"], F.lit("")) == self.namespace)
        return F.try_element_at(F.filter("attrs", same), F.lit(1))["value"]


@dataclass
class Type:
    """A type of elements.

    ``content`` is a model whose names are keys of the grammar's types, None for anything;
    ``text`` is None for no text, "mixed" for any among the children, or a test of the
    value; ``attributes`` None allows any.  namespace "" is none, None any.
    """

    name: str
    content: Model | None = EMPTY
    text: str | Test | None = None
    attributes: list[Attribute] | None = field(default_factory=list)
    namespace: str | None = ""


@dataclass
class Grammar:
    types: dict[str, Type]
    start: list[str]


#: Attributes that every element may have.
_FREE = ("http://www.w3.org/2000/xmlns/", "http://www.w3.org/2001/XMLSchema-instance", "http://www.w3.org/XML/1998/namespace")


def _able_by_text(t: Type) -> Column:
    if t.text is None:
        return ~F.col("has_text")
    return F.lit(True) if t.text == "mixed" else F.coalesce(t.text(F.col("text")), F.lit(False))


def _able_by_attributes(t: Type) -> Column:
    """Whether an element's namespace and attributes fit a type."""
    ok = F.lit(True) if t.namespace is None else F.coalesce("namespace", F.lit("")) == t.namespace
    if t.attributes is None:
        return ok
    for a in t.attributes:
        v = a.value()
        if a.required:
            ok = ok & v.isNotNull()
        if a.test is not None:
            ok = ok & (v.isNull() | F.coalesce(a.test(v), F.lit(False)))
    if not t.attributes:
        ok = ok & ((F.size("attrs") == 0) | F.forall("attrs", _free))
        return ok
    keys = [f"{a.namespace} {a.name}" for a in t.attributes]
    known = lambda a: F.concat_ws(" ", F.coalesce(a["namespace"], F.lit("")), a["name"]).isin(keys)
    return ok & F.forall("attrs", lambda a: known(a) | _free(a))


def _free(a: Column) -> Column:
    return F.coalesce(a["namespace"], F.lit("")).isin(*_FREE) | F.coalesce(a["prefix"] == "xmlns", F.lit(False)) | (a["name"] == "xmlns")


def _takes(m: Model | None, number: dict[str, int]) -> Column:
    """Whether a model takes some choice of the types in ``kids``, an array of arrays of type numbers."""
    if m is None:
        return F.lit(True)
    kids = F.col("kids")
    if m.kind == "all":
        mine = F.array(*[F.lit(number[n]) for n, *_ in m.counts])
        ok = F.forall(kids, lambda k: F.arrays_overlap(k, mine))
        for n, low, high in m.counts:
            count = F.size(F.filter(kids, _holding(number[n])))
            ok = ok & (count >= low) & (F.lit(True) if high is None else count <= high)
        return ok
    moves, final = automaton(m)
    if not moves:
        return F.size(kids) == 0 if final else F.lit(False)
    many = len(number)
    table = F.create_map(*[F.lit(x) for (s, name), to in moves.items() for x in (s * many + number[name], to)])
    step = lambda s, k: F.array_compact(F.transform(k, lambda t: F.try_element_at(table, s * many + t)))
    start = F.array(F.lit(0))
    end = F.aggregate(kids, start, lambda states, k: F.array_distinct(F.flatten(F.transform(states, lambda s: step(s, k)))))
    return F.arrays_overlap(end, F.array(*[F.lit(s) for s in sorted(final)])) if final else F.lit(False)


def _holding(number: int):
    return lambda k: F.array_contains(k, number)


def element_types(nodes: DataFrame, grammar: Grammar, buckets: int | None = None) -> DataFrame:
    """(doc_id, pre, depth, name, able, types, clear) of all elements: the types that all but the
    children allow, those that the children allow too, and whether every child has a type.

    One written table a level, as each level needs the next deeper one alone.  ``buckets`` is the
    number of those by doc_id that ``nodes`` lie in: the levels then do too, and shuffle nothing.
    """
    keep = written if buckets is None else lambda rows: bucketed(rows, "doc_id", buckets)
    number = {k: i for i, k in enumerate(grammar.types)}
    rows = _able_elements(nodes, grammar)
    rows = keep(rows.select("doc_id", "pre", "parent", "depth", "ord", "name", "able"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    if deepest > MOST_LEVELS:
        raise ValueError(f"elements lie {deepest} deep; {MOST_LEVELS} levels are taken")

    def fitting(t: Column) -> Column:
        out = None
        for k, i in number.items():
            test = _takes(grammar.types[k].content, number)
            out = F.when(t == i, test) if out is None else out.when(t == i, test)
        return F.lit(False) if out is None else out

    levels, below = [], None
    for d in range(deepest, 0, -1):
        here = rows.filter(F.col("depth") == d)
        if below is None:
            here = here.withColumn("kids", F.array().cast("array<array<int>>"))
        else:
            kids = below.groupBy(F.col("doc_id").alias("k_doc"), F.col("parent").alias("k_pre")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "types"))), lambda x: x["types"]).alias("kids"))
            here = here.join(kids, (F.col("doc_id") == F.col("k_doc")) & (F.col("pre") == F.col("k_pre")), "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<array<int>>")))
        here = here.withColumn("types", F.filter("able", fitting)).withColumn("clear", F.forall("kids", lambda k: F.size(k) > 0))
        below = keep(here.select("doc_id", "pre", "parent", "depth", "ord", "name", "able", "types", "clear"))
        levels.append(below)
    out = levels[0] if levels else rows.withColumn("types", F.col("able")).withColumn("clear", F.lit(True))
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "pre", "depth", "name", "able", "types", "clear")


def check_grammar(nodes: DataFrame, grammar: Grammar, buckets: int | None = None) -> DataFrame:
    """(doc_id, pre, rule, message) of every element that has no type while all its children have one, and of roots of a wrong type.

    rule is "undeclared-element" for a name that no type has, "attributes-or-text" where no
    type of the name allows these, "content" where none takes the children, "root" where the
    root's types aren't the grammar's start.  Documents stream through a task one behind
    another, so it holds one of them and a batch (``element_types`` holds no document, and
    writes a table a level).  ``buckets`` is as there; nothing depends on it here.
    """
    names = list({t.name for t in grammar.types.values()}) or [""]
    number = {k: i for i, k in enumerate(grammar.types)}
    start = frozenset(number[k] for k in grammar.start)
    models = [t.content for t in grammar.types.values()]
    rows = _able_elements(nodes, grammar).withColumn("able", F.array_join("able", ","))
    rows = in_order(rows.select("doc_id", "pre", "parent", "depth", "name", "able"), "doc_id")
    found = rows.mapInArrow(lambda it: _misfits(it, models, number, start, frozenset(names)), "doc_id bigint, pre int, name string, rule string")
    return found.select("doc_id", "pre", "rule", F.concat(F.lit("element "), F.col("name"), F.lit(" fits no type that is allowed there")).alias("message"))


def _able_elements(nodes: DataFrame, grammar: Grammar) -> DataFrame:
    """Elements with ``able``, the numbers of the types that all of them but their children fits.

    Their text is what lies in them but not in their children.  Where the table has
    string-values, that is the text of an element with one node below it or none; only texts of
    the others are put together.
    """
    texts = nodes.filter("kind in ('text', 'cdata')").select("doc_id", F.col("parent").alias("pre"), "ord", "content")
    rows, own = nodes.filter("kind = 'element'"), F.lit("")
    if VALUE in nodes.columns:
        own = F.when(F.col("post") <= F.col("pre") + 1, F.col(VALUE)).otherwise(own)
        texts = texts.join(rows.filter((F.col("post") > F.col("pre") + 1) | F.col(VALUE).isNull()).select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")
    texts = texts.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "").alias("text"))
    rows = rows.select("doc_id", "pre", "parent", "depth", "ord", "name", _by_name(grammar, lambda t, _: _able_by_attributes(t)).alias("attributes_fit"), own.alias("own_")).join(texts, ["doc_id", "pre"], "left")
    rows = rows.withColumn("text", F.coalesce("text", "own_", F.lit(""))).withColumn("has_text", F.col("text").rlike(r"[^ \t\r\n]"))
    able = _by_name(grammar, lambda t, i: F.array_contains("attributes_fit", i) & _able_by_text(t))
    return rows.withColumn("able", able).drop("attributes_fit", "own_", "text", "has_text")


def _by_name(grammar: Grammar, fits: Callable[[Type, int], Column]) -> Column:
    """The numbers of the types of an element's name that fit."""
    found, nothing = None, F.array().cast("array<int>")
    for name in dict.fromkeys(t.name for t in grammar.types.values()):
        mine = F.array(*[F.when(fits(t, i), F.lit(i)) for i, t in enumerate(grammar.types.values()) if t.name == name])
        found = F.when(F.col("name") == name, mine) if found is None else found.when(F.col("name") == name, mine)
    return F.array_compact(nothing if found is None else found.otherwise(nothing))


def _misfits(batches, models: list[Model | None], number: dict[str, int], start: frozenset, names: frozenset):
    """The elements of whole documents that have no type though their children do, and roots of a wrong type."""
    folds = [Fold(m, number) for m in models]
    sets = [frozenset()]  # of types, by numbers that stay while the task lasts
    known = {sets[0]: 0}

    def numbered(s: frozenset) -> int:
        if s not in known:
            known[s] = len(sets)
            sets.append(s)
        return known[s]

    for table in whole(batches, "doc_id"):
        children = Children(table)
        coded = table.column("able").combine_chunks().dictionary_encode()
        able, codes = [sorted(map(int, x.split(","))) if x else [] for x in coded.dictionary.to_pylist()], coded.indices.to_numpy()
        types = np.zeros(table.num_rows, np.int64)
        for here in children.levels():
            for code in np.unique(codes[here]).tolist():
                mine = here[codes[here] == code]
                if able[code]:
                    fit = np.column_stack([folds[t].takes(children, mine, types, sets) for t in able[code]])
                    kinds, which = np.unique(fit, axis=0, return_inverse=True)
                    types[mine] = np.array([numbered(frozenset(t for t, ok in zip(able[code], k, strict=True) if ok)) for k in kinds], np.int64)[which.ravel()]
        every = np.arange(table.num_rows)
        none = (types == 0) & children.all_of(every, types != 0)
        root = (table.column("depth").to_numpy() == 1) & (types != 0) & ~np.array([bool(s & start) for s in sets], bool)[types]
        bad = pa.array(np.flatnonzero(none | root))
        name = table.column("name").combine_chunks().take(bad).to_pylist()
        empty = np.array([not a for a in able], bool)[codes]
        rule = ["root" if r else "undeclared-element" if x not in names else "attributes-or-text" if e else "content" for r, e, x in zip(root[bad], empty[bad], name, strict=True)]
        columns = [*[table.column(c).combine_chunks().take(bad) for c in ("doc_id", "pre")], pa.array(name, pa.string()), pa.array(rule, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pre", "name", "rule"])
