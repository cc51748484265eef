"""Edits of the node table: rows change, and each document is numbered anew.

Targets are a DataFrame of nodes, which is joined, or a condition on rows, which is not.  With
``numbered=False`` an edit leaves numbers, which still nest, and paths as they were: of several
edits, ``renumber`` needs to come once, after the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.axes import below
from thicket.operators.ordered import in_order, whole
from thicket.schema import KEY, MOST_PATH, VALUE
from thicket.sources.tree import ordinals, spans


def _children(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys of the rows at or below the targets."""
    return below(nodes.select("doc_id", "pre", "post"), targets).select(*KEY)


def remove(nodes: DataFrame, targets: DataFrame | Column, numbered: bool = True) -> DataFrame:
    """Without the targets' subtrees."""
    if isinstance(targets, Column):
        # Subtrees nest: a node is in one if some target before it, or itself, ends at it or later.
        so_far = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = nodes.withColumn("gone_", F.max(F.when(targets, F.col("post"))).over(so_far)).filter("gone_ is null or gone_ < pre").drop("gone_")
    else:
        left = nodes.join(_children(nodes, targets), KEY, "left_anti")
    return renumber(left) if numbered else left


def set_attribute(nodes: DataFrame, targets: DataFrame | Column, name: str, value: str | Column) -> DataFrame:
    """The attribute with that local name gets the value, where it is or at the end."""
    v = F.lit(value) if isinstance(value, str) else value
    kind = "struct<name:string,value:string,prefix:string,namespace:string>"
    new = F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("namespace")).cast(kind)
    there = F.exists("attrs", lambda a: a["name"] == name)
    changed = F.transform("attrs", lambda a: F.when(a["name"] == name, a.withField("value", v)).otherwise(a))
    return _touch(nodes, targets, attrs=F.when(there, changed).otherwise(F.array_append("attrs", new)))


def remove_attribute(nodes: DataFrame, targets: DataFrame | Column, name: str) -> DataFrame:
    return _touch(nodes, targets, attrs=F.filter("attrs", lambda a: a["name"] != name))


def rename(nodes: DataFrame, targets: DataFrame | Column, name: str, numbered: bool = True) -> DataFrame:
    named = _touch(nodes, targets, name=F.lit(name))
    return renumber(named) if numbered else named


def set_text(nodes: DataFrame, targets: DataFrame, value: str | Column) -> DataFrame:
    """The targets' content becomes one text node."""
    kept = nodes.join(_children(nodes, targets).join(targets.select(*KEY), KEY, "left_anti").select(*KEY), KEY, "left_anti")
    return insert(kept, targets.join(kept.select(*KEY), KEY, "left_semi"), "last", kind="text", content=value)


def insert(nodes: DataFrame, at: DataFrame, where: str, kind: str = "element", name: str | None = None, content: str | Column | None = None) -> DataFrame:
    """One new node for each of ``at``: its "first" or "last" child, or "before" or "after" it."""
    return renumber(nodes.withColumn("pre", F.col("pre").cast("double")).unionByName(_new(nodes, at, where, kind, name, content), allowMissingColumns=True))


def _new(nodes: DataFrame, at: DataFrame, where: str, kind: str, name: str | None, content: str | Column | None) -> DataFrame:
    text = content if isinstance(content, Column) else F.lit(content).cast("string")
    # Places between the numbers there are: doubles, which renumber() makes whole.
    pre = {"first": F.col("pre") + 0.5, "last": F.col("post") + 0.5, "before": F.col("pre") - 0.5, "after": F.col("post") + 0.5}[where]
    depth = F.col("depth") + (1 if where in ("first", "last") else 0)
    return at.select(
        "doc_id", pre.alias("pre"), depth.alias("depth"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("name"),
        F.when(F.lit(kind == "element"), F.array().cast(nodes.schema["attrs"].dataType)).alias("attrs"), text.alias("content"),
    )


def replace(nodes: DataFrame, targets: DataFrame, kind: str = "element", name: str | None = None, content: str | Column | None = None) -> DataFrame:
    """One new node in place of each target and what is below it."""
    rest = nodes.join(_children(nodes, targets), KEY, "left_anti").withColumn("pre", F.col("pre").cast("double"))
    return renumber(rest.unionByName(_new(nodes, targets, "before", kind, name, content), allowMissingColumns=True))


def clone(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """A copy of each target's subtree right after it."""
    place = lambda p: F.col("c_post") + (p - F.col("c_pre") + 1) / (F.col("c_post") - F.col("c_pre") + 2)
    copy = below(nodes, targets).withColumn("pre", place(F.col("pre")))
    return renumber(nodes.withColumn("pre", F.col("pre").cast("double")).unionByName(copy.select(*nodes.columns)))


def _touch(nodes: DataFrame, targets: DataFrame | Column, **columns: Column) -> DataFrame:
    if isinstance(targets, Column):
        return nodes.select(*[F.when(targets, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else c for c in nodes.columns])
    marked = nodes.join(targets.select(*KEY).distinct().withColumn("hit_", F.lit(True)), KEY, "left")
    for c, value in columns.items():
        marked = marked.withColumn(c, F.when(F.col("hit_"), value).otherwise(F.col(c)))
    return marked.select(*nodes.columns)


def renumber(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All numbers and paths from the order of ``pre`` (whole or not) and ``depth``, document by document.

    Documents stream through a task one behind another, so it holds one of them and a batch.
    Of ``columns``, only these are made and sent, for the optimizer can't see into the numbering.
    """
    nodes = nodes.drop(VALUE)  # those of before the edit
    wanted = [c for c in nodes.columns if columns is None or c in columns]
    kept = [c for c in wanted if c not in NUMBERS and c not in ("doc_id", "depth", "path")]
    # Elements are told by their names.
    rows = nodes.select("doc_id", "pre", "depth", F.when(F.col("kind") == "element", F.col("name")).alias(_ELEMENT), *kept)
    kinds = ", ".join(f"{c} {NUMBERS.get(c) or nodes.schema[c].dataType.simpleString()}" for c in wanted)
    return in_order(rows, "doc_id").drop("pre").mapInArrow(lambda it: _streamed(it, wanted), kinds)


def _streamed(batches, wanted: list[str]):
    for table in whole(batches, "doc_id"):
        yield from _numbered(table, wanted).to_batches()


_ELEMENT = "element_"
NUMBERS = dict.fromkeys(("pre", "post", "parent", "ord", "elem_ord", "elem_ord_last"), "int")


def _numbered(table: pa.Table, wanted: list[str]) -> pa.Table:
    """The wanted columns of whole documents, one behind another, numbered in the order of their rows."""
    n, depth = table.num_rows, table.column("depth").to_numpy().astype(np.int64)
    docs = _codes(table.column("doc_id"))[0]
    new_doc = np.append(True, docs[1:] != docs[:-1])
    starts = np.flatnonzero(new_doc)
    if np.any(depth[starts]) or np.any((np.diff(depth) > 1) & ~new_doc[1:]):  # a level is left out
        depth = _closed_up(depth, new_doc)
    parent, end = spans(depth)
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    element = pc.is_valid(table.column(_ELEMENT)).to_numpy() & (parent >= 0)
    numbered, inner = np.flatnonzero(element), np.flatnonzero(parent >= 0)
    order, forth, back = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order[inner] = ordinals(parent, inner)[0]
    forth[numbered], back[numbered] = ordinals(parent, numbered)
    new = {"pre": (np.arange(n) - first, None), "post": (end - first, None), "parent": (parent - first, parent < 0), "ord": (order, None), "elem_ord": (forth, ~element), "elem_ord_last": (back, ~element)}

    def column(c: str):
        if c == "path":
            return _paths(table.column(_ELEMENT), depth, parent, element)
        return pa.array(new[c][0].astype(np.int32), mask=new[c][1]) if c in new else table.column(c)

    return pa.Table.from_arrays([column(c) for c in wanted], names=wanted)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """The values as numbers (null: -1) of a list of them."""
    coded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _closed_up(depth: np.ndarray, new_doc: np.ndarray) -> np.ndarray:
    """Depths as numbers of the nodes above, where levels are left out."""
    out, above = [], []
    for d, new in zip(depth.tolist(), new_doc.tolist(), strict=True):
        if new:
            above = []
        while above and above[-1] >= d:
            above.pop()
        out.append(len(above))
        above.append(d)
    return np.array(out, np.int64)


def _paths(names: pa.ChunkedArray, depth: np.ndarray, parent: np.ndarray, element: np.ndarray) -> pa.Array:
    """Element paths, level by level: each pair of a path and a name below it is put together once."""
    name, known = _codes(names)
    spot, paths, many = np.where(parent < 0, 0, -1), [""], max(1, len(known))
    order = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
    for d in range(1, len(level) - 1):
        here = order[level[d] : level[d + 1]]
        here = here[element[here]]
        here = here[spot[parent[here]] >= 0]
        pairs, which = np.unique(spot[parent[here]] * many + name[here], return_inverse=True)
        made = np.full(len(pairs), -1, np.int64)
        for k, pair in enumerate(pairs.tolist()):
            base, last = paths[pair // many], known[pair % many]
            if len(base) + len(last) < MOST_PATH:
                made[k] = len(paths)
                paths.append(f"{base}/{last}")
        spot[here] = made[which]
    return pa.DictionaryArray.from_arrays(pa.array(spot.astype(np.int32), mask=spot < 0), pa.array(paths, pa.string())).cast(pa.string())
