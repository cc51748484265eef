"""Periodic runs of words by Crochemore's partition refinement.

Positions of a word sequence are refined by the factor of length 1, 2, 3, ... that begins
there.  A step only looks at the positions before members of *small* classes (of the parts of
a class that was split, all but the largest), so a sequence of n words costs O(n log n).  A
class is a linked list in order of position; two neighbours at a distance equal to the length
are a square of a primitive word, and squares at consecutive positions are one run.

A run of ``repeats`` periods and ``least`` words consists of windows of ``least // 3`` words
that all occur twice in their document, so only stretches of such windows are refined.  The
windows are compared by 64-bit hashes, which may let a stretch more through and loses none;
within a stretch the words themselves are compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thicket.llm.common import free_name, without_results
from thicket.llm.text import mix, utf8, window_owner, windows, words

#: Bytes of text that are hashed in one go, and of a text that are split into words at once.
PIECE, SLICE = 4 << 20, 1 << 20
_RUNS = ("n_runs", "runs", "strongest", "collapsed")
_SCHEMA = "n_runs long, runs array<struct<start: long, length: long, period: long>>, strongest struct<start: long, length: long, period: long>, collapsed string"
_BLANKS = b" \t\n\v\f\r"


def repetitions(symbols: list[int], repeats: int = 2, least: int = 0) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, period) of ``repeats`` periods and ``least`` symbols, by period and start.

    ``symbols`` are numbers from 0, each used at least once.  The period is the smallest.
    """
    n = len(symbols)
    most = n // repeats
    if not most:
        return []
    kinds = max(symbols) + 1
    of = [*symbols, kinds]  # a position's class; the end is a class of its own
    after, before = [-1] * (n + 1), [-1] * (n + 1)
    head, last, size = [-1] * (kinds + 1), [-1] * (kinds + 1), [0] * (kinds + 1)
    at_distance: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(of):
        size[c] += 1
        if (j := last[c]) < 0:
            head[c] = i
        else:
            after[j], before[i] = i, j
            if i - j <= most:
                at_distance[i - j].append(j)
        last[c] = i
    several = sum(k > 1 for k in size)

    def members(c: int) -> list[int]:
        out, i = [], head[c]
        while i >= 0:
            out.append(i)
            i = after[i]
        return out

    largest = max(range(kinds + 1), key=size.__getitem__)
    small = [members(c) for c in range(kinds + 1) if c != largest]
    found, length = [], 1
    while True:
        squares = sorted({i for i in at_distance.pop(length, ()) if after[i] == i + length})
        k = 0
        while k < len(squares):
            first = k
            while k + 1 < len(squares) and squares[k + 1] == squares[k] + 1:
                k += 1
            whole = squares[k] - squares[first] + 2 * length
            if whole >= least and whole >= repeats * length:
                found.append((squares[first], whole, length))
            k += 1
        if length == most or not several:
            return found
        length += 1
        split: dict[int, list[tuple[int, list[int]]]] = {}
        for positions in small:
            parts: dict[int, list[int]] = {}
            for i in positions:
                if i:
                    parts.setdefault(of[i - 1], []).append(i - 1)
            for c, moved in parts.items():
                if len(moved) == size[c]:  # all of it is followed alike
                    continue
                new, tail = len(size), -1
                split.setdefault(c, []).append((new, moved))
                several -= size[c] > 1
                size[c] -= len(moved)
                several += (size[c] > 1) + (len(moved) > 1)
                size.append(len(moved))
                head.append(moved[0])
                for j in moved:
                    of[j] = new
                    left, right = before[j], after[j]
                    if left < 0:
                        head[c] = right
                    else:
                        after[left] = right
                    if right >= 0:
                        before[right] = left
                        if left >= 0 and length <= right - left <= most:
                            at_distance[right - left].append(left)
                    before[j], after[j] = tail, -1
                    if tail >= 0:
                        after[tail] = j
                        if length <= j - tail <= most:
                            at_distance[j - tail].append(tail)
                    tail = j
        small = []
        for c, parts in split.items():
            biggest = max(len(x) for _, x in parts)
            if size[c] >= biggest:
                small += [x for _, x in parts]
            else:
                skip = next(k for k, (_, x) in enumerate(parts) if len(x) == biggest)
                small += [x for k, (_, x) in enumerate(parts) if k != skip]
                small.append(members(c))


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, slice by slice."""
    pos = 0
    while pos < len(text):
        end = pos + SLICE
        while end < len(text) and text[end] not in _BLANKS:
            ahead = text[end : end + SLICE]
            end += min((k for k in (ahead.find(b) for b in _BLANKS) if k >= 0), default=len(ahead))
        yield text[pos:end].split()
        pos = end


def _stretches(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in it, end) of the maximal stretches whose windows all occur twice in their document."""
    size = least // 3
    start, owner = window_owner(first, size)
    key = windows(hashes, size)[start] if len(start) else np.zeros(0, np.uint64)
    key = mix(key ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 2, bool)
    twice[1:-1][order] = same[1:] | same[:-1]
    border = np.zeros(len(key) + 1, bool)  # between windows k - 1 and k
    border[1:-1] = owner[1:] != owner[:-1]
    now, then = twice[1:], twice[:-1]
    begin = np.flatnonzero(now & (~then | border))
    close = np.flatnonzero(then & (~now | border))
    long_ = close - begin >= least - size + 1
    begin, close = begin[long_], close[long_]
    doc = owner[begin]
    return doc, start[begin] - first[doc], start[close - 1] + size - first[doc]


def _document_runs(text: bytes, spans: list[tuple[int, int]], repeats: int, least: int) -> list[tuple[int, int, int]]:
    """The runs of a text within spans of its words."""
    out, at, k, held = [], 0, 0, []
    for part in _word_lists(text):
        while k < len(spans) and spans[k][0] < at + len(part):
            a, b = spans[k]
            held += part[max(a - at, 0) : b - at]
            if b > at + len(part):
                break
            number: dict[bytes, int] = {}
            out += [(a + s, n, q) for s, n, q in repetitions([number.setdefault(w, len(number)) for w in held], repeats, least)]
            held, k = [], k + 1
        if k == len(spans):
            break
        at += len(part)
    return sorted((s, n, q) for s, n, q in out)


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    gone: list[list[int]] = []
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if gone and a <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    out, at = [], 0
    for part in _word_lists(text):
        pos = at
        for a, b in gone:
            if b > pos and a < at + len(part):
                out += part[pos - at : max(a - at, pos - at)]
                pos = max(pos, min(b, at + len(part)))
        out += part[pos - at :]
        at += len(part)
        if len(out) > 1:
            out = [b" ".join(out)]
    return b" ".join(out)


def _strongest(runs: list[tuple[int, int, int]]):
    best = None
    for s, n, q in runs:  # by start, then period
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def _marked(batches, text: str, repeats: int, least: int):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.diff(utf8(column)[1])
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b <= a:
                continue
            raw, at = utf8(column.slice(a, b - a))
            (hashes,), first = words(raw, at)
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for d, s, e in zip(*(x.tolist() for x in _stretches(hashes, first, least)), strict=True):
                if spans[d] and s < spans[d][-1][1]:  # the words of two stretches may overlap
                    s, _ = spans[d].pop()
                spans[d].append((s, e))
            del hashes
            runs, kept = [], []
            for d in range(b - a):
                body = raw[at[d] : at[d + 1]].tobytes()
                runs.append(_document_runs(body, spans[d], repeats, least) if d in spans else [])
                kept.append(_collapsed(body, runs[-1]))
            as_dict = lambda x: None if x is None else dict(zip(("start", "length", "period"), x, strict=True))
            new = [
                pa.array([len(x) for x in runs], pa.int64()),
                pa.array([[as_dict(y) for y in x] for x in runs], pa.list_(_RUN)),
                pa.array([as_dict(_strongest(x)) for x in runs], _RUN),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]
            others = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns) if batch.schema.names[k] != text]
            yield pa.RecordBatch.from_arrays([*others, *new], names=[*(x for x in batch.schema.names if x != text), *_RUNS])


def periodic_runs(docs: DataFrame, text_col: str = "text", repeats: int = 3, least: int = 24) -> DataFrame:
    """docs with n_runs, runs, strongest and collapsed.

    A text's words (maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``) are numbered from 0.
    A run is a stretch of consecutive words with smallest period q and a length of at least
    ``least`` and ``repeats * q`` that no neighbouring word extends with that period.  runs
    are all of them as (start, length, period), by start and then period; strongest is that
    of the greatest exact length / period, ties to the smallest start, then period (null
    without runs); collapsed is the text's words without those that any run holds after its
    first period, joined by one space.

    Null, empty and blank texts have no runs and the empty text as collapsed.  Rows stand for
    themselves: repeated rows, null or repeated ids and other columns don't matter.  Columns
    that bear a result's name, in any case, are replaced.  An empty table gives an empty
    result.  Texts are taken whole; a batch is hashed in pieces, a long text is split into
    words in slices, and only stretches of repeated windows are refined.
    """
    if repeats < 3 or least < 3:
        raise ValueError("repeats and least are 3 at least: windows of a third of a run occur twice in it")
    docs = without_results(docs, _RUNS, text_col)
    if text_col.lower() in _RUNS:
        raise ValueError(f"the text column can't be called {text_col}")
    (body,) = free_name(docs, "body")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(_SCHEMA).fields])
    rows = docs.withColumn(body, F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(partial(_marked, text=body, repeats=repeats, least=least), schema)
