"""Collects nodes in document order, as columns, and makes the node table's Arrow batches of them.

A node is appended as three plain values: its depth and kind in one number, a number for its
name and path, and its content.  All else (``pre``, ``post``, ``parent``, ordinals) follows
from the depths, and is computed for a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from thicket.schema import ARROW, KINDS, MOST_PATH, MOST_VALUE, VALUE, VALUE_FIELD

DOCUMENT, ELEMENT, TEXT, CDATA, COMMENT, PI, DOCTYPE = range(len(KINDS))


class Nodes:
    """The nodes of a batch of documents.

    ``code`` is 8 * depth + kind; ``spot`` numbers ``spots``, pairs of a name and a path;
    names are tuples of name, prefix and namespace.  ``owner`` and ``attributes`` are a row
    for each attribute: its element and the tuple of name, value, prefix and namespace.  Where
    a batch is read at once, these are arrays, ``content`` an Arrow one and ``attributes`` four.
    """

    def __init__(self):
        self.code: list[int] = []
        self.spot: list[int] = []
        self.content: list[str | None] = []
        self.owner: list[int] = []
        self.attributes: list[tuple] = []
        self.names: list[tuple] = [(None, None, None)]
        self.named: dict[tuple, int] = {self.names[0]: 0}
        self.spots: list[tuple[int, str | None]] = [(0, ""), (0, None)]  # 0 is the document's, 1 that of texts
        self.below: dict[tuple[int, int], int] = {}
        self.leaves: dict[int, int] = {0: 1}
        self.documents: list[tuple] = []  # first node, id and error

    def __len__(self) -> int:
        return len(self.code)

    def name_of(self, name, prefix=None, namespace=None) -> int:
        key = (name, prefix, namespace)
        if (k := self.named.get(key)) is None:
            k = self.named[key] = len(self.names)
            self.names.append(key)
        return k

    def spot_below(self, above: int, name: int) -> int:
        """That of an element, by its parent's and its name; without a path where it would be over ``MOST_PATH``."""
        if (k := self.below.get((above, name))) is None:
            base = self.spots[above][1]
            path = None if base is None else f"{base}/{self.names[name][0]}"
            k = self.below[above, name] = len(self.spots)
            self.spots.append((name, None if path is None or len(path) > MOST_PATH else path))
        return k

    def spot_of(self, name: int) -> int:
        """That of a node without a path."""
        if (k := self.leaves.get(name)) is None:
            k = self.leaves[name] = len(self.spots)
            self.spots.append((name, None))
        return k

    def contents(self) -> pa.Array:
        return self.content if isinstance(self.content, pa.Array) else pa.array(self.content, pa.string())

    def attribute_columns(self) -> list:
        """Names, values, prefixes and namespaces."""
        return list(self.attributes) if isinstance(self.attributes, tuple) else list(zip(*self.attributes, strict=True)) or [()] * 4

    def add(self, kind: int, depth: int, spot: int, content: str | None = None) -> None:
        self.code.append(8 * depth + kind)
        self.spot.append(spot)
        self.content.append(content)

    def begin(self, doc_id) -> tuple[int, int, int]:
        """A document's node; what the mark tells ``drop`` and ``end``."""
        mark = (len(self.code), len(self.owner), len(self.documents))
        self.documents.append((mark[0], doc_id, None))
        self.add(DOCUMENT, 0, 0)
        return mark

    def drop(self, mark: tuple[int, int, int]) -> None:
        """Only the document's node stays."""
        for column in (self.code, self.spot, self.content):
            del column[mark[0] + 1 :]
        del self.owner[mark[1] :]
        del self.attributes[mark[1] :]

    def end(self, mark: tuple[int, int, int], error: str | None) -> None:
        first, doc_id, _ = self.documents[mark[2]]
        self.documents[mark[2]] = (first, doc_id, error)


def spans(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's parent (-1: none) and the last node below it, by rows, where no depth is left out on the way down."""
    n = len(depth)
    parent, end = np.full(n, -1, np.int64), np.empty(n, np.int64)
    order = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[order], np.arange((int(depth.max()) if n else -1) + 2))
    closed = np.zeros(0, np.int64)  # nodes that end what is open at this depth
    for d in range(len(level) - 1):
        here = order[level[d] : level[d + 1]]
        if d:
            above = order[level[d - 1] : level[d]]
            parent[here] = above[np.searchsorted(above, here) - 1]
        closed = here if not d else np.sort(np.concatenate([closed, here]), kind="stable")
        after = np.append(closed, n)
        end[here] = after[np.searchsorted(closed, here, "right")] - 1
    return parent, end


def ordinals(parent: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row among those of its parent, from either end."""
    order = np.argsort(parent[rows], kind="stable")
    p = parent[rows][order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    at = np.arange(len(p))
    first = np.maximum.accumulate(np.where(new, at, 0))
    size = np.diff(np.append(np.flatnonzero(new), len(p)))
    out, last = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    out[order] = at - first + 1
    last[order] = np.repeat(size, size) - (at - first)
    return out, last


def _strings(values: list, numbers: np.ndarray) -> pa.Array:
    """The values at these places, of a short list of which many are repeated."""
    if all(x is None for x in values):
        return pa.nulls(len(numbers), pa.string())
    return pa.DictionaryArray.from_arrays(pa.array(numbers, pa.int32()), pa.array(values, pa.string())).cast(pa.string())


def record_batch(nodes: Nodes, columns: list[str], paths: frozenset[str] | None) -> pa.RecordBatch:
    """The nodes as Arrow columns; of ``paths``, only document nodes, the elements there and their texts."""
    n = len(nodes)
    code = np.array(nodes.code, np.int64)
    depth, kind = code >> 3, code & 7
    starts = np.array([d[0] for d in nodes.documents], np.int64)
    size = np.diff(np.append(starts, n))
    pre = np.arange(n) - np.repeat(starts, size)
    parent, end = spans(depth)
    element = np.flatnonzero(kind == ELEMENT)
    keep, content = None, nodes.contents()
    spot = np.array(nodes.spot, np.int64)
    if paths is not None:
        wanted = np.array([x in paths for _, x in nodes.spots], bool)[spot] & (kind == ELEMENT)
        text = (kind == TEXT) | (kind == CDATA)
        keep = np.flatnonzero((kind == DOCUMENT) | wanted | (text & wanted[parent]))

    def taken(x: np.ndarray) -> np.ndarray:
        return x if keep is None else x[keep]

    def ints(x: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
        return pa.array(taken(x).astype(np.int32), mask=None if absent is None else taken(absent))

    def column(name: str) -> pa.Array:
        if name == "doc_id":
            return pa.array([d[1] for d in nodes.documents], pa.int64()).take(pa.array(taken(np.repeat(np.arange(len(starts)), size))))
        if name == "pre":
            return ints(pre)
        if name == "post":
            return ints(end - np.repeat(starts, size))
        if name == "parent":
            return ints(pre[parent], parent < 0)
        if name == "depth":
            return ints(depth)
        if name == "ord":
            out = np.ones(n, np.int64)
            inner = np.flatnonzero(parent >= 0)
            out[inner] = ordinals(parent, inner)[0]
            return ints(out)
        if name in ("elem_ord", "elem_ord_last"):
            out, absent = np.zeros(n, np.int64), kind != ELEMENT
            out[element] = ordinals(parent, element)[name != "elem_ord"]
            return ints(out, absent)
        if name == "kind":
            return _strings(list(KINDS), taken(kind))
        if name in ("name", "prefix", "namespace"):
            k = ("name", "prefix", "namespace").index(name)
            return _strings([nodes.names[x][k] for x, _ in nodes.spots], taken(spot))
        if name == "path":
            return _strings([x for _, x in nodes.spots], taken(spot))
        if name == "content":
            out = content
            return out if keep is None else out.take(pa.array(keep))
        if name == "error":
            errors = np.zeros(n, np.int64)
            errors[starts] = np.arange(len(starts)) + 1
            return _strings([None, *(d[2] for d in nodes.documents)], taken(errors))
        if name == VALUE:
            out = _values(content, kind, end)
            return out if keep is None else out.take(pa.array(keep))
        out = _attributes(nodes, kind == ELEMENT)
        return out if keep is None else out.take(pa.array(keep))

    return pa.RecordBatch.from_arrays([column(c) for c in columns], schema=pa.schema([VALUE_FIELD if c == VALUE else ARROW.field(c) for c in columns]))


def _values(content: pa.Array, kind: np.ndarray, end: np.ndarray) -> pa.Array:
    """String-values of documents and elements: stretches of the batch's texts, copied from their bytes."""
    text = (kind == TEXT) | (kind == CDATA)
    pieces = content.take(pa.array(np.flatnonzero(text)))
    upto = np.append(0, np.cumsum(text))
    low, high = upto[:-1], upto[end + 1]
    length = np.append(0, np.cumsum(pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)))
    fits = (kind <= ELEMENT) & (length[high] - length[low] <= MOST_VALUE)
    _, borders, data = pieces.buffers()
    at = np.frombuffer(borders, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64) if len(pieces) else np.zeros(1, np.int64)
    size = np.where(fits, at[high] - at[low], 0)
    place = np.append(0, np.cumsum(size))
    made = np.frombuffer(data, np.uint8)[np.arange(place[-1]) + np.repeat(at[low] - place[:-1], size)] if place[-1] else np.zeros(0, np.uint8)
    known = pa.py_buffer(np.packbits(fits, bitorder="little"))
    return pa.StringArray.from_buffers(len(kind), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(made), known)


def _attributes(nodes: Nodes, element: np.ndarray) -> pa.Array:
    """Lists of attributes as an Arrow column, built from flat columns; null but for elements."""
    kind = ARROW.field("attrs").type
    offsets = np.zeros(len(element) + 1, np.int32)
    np.cumsum(np.bincount(np.array(nodes.owner, np.int64), minlength=len(element)), out=offsets[1:])
    fields = list(kind.value_type)
    values = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(nodes.attribute_columns(), fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~element, False)), values).cast(kind)
