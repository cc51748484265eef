"""Content models folded over the children of many elements at once.

Elements come whole document by whole document, in order.  A child counts as the set of types
that it may have, and a model's automaton moves by such sets: each pair of states and a set is
worked out once, and a step is taken for the n-th child of all elements together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from thicket.operators.content import Model, automaton
from thicket.operators.ordered import starts


class Children:
    """The elements of whole documents, by rows, and which of them are children of which."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        first = starts(table, ("doc_id",))
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        pre = table.column("pre").to_numpy().astype(np.int64)
        above = table.column("parent").fill_null(-1).to_numpy().astype(np.int64)
        far = int(pre.max()) + 2
        key = doc * far + pre
        at = np.minimum(np.searchsorted(key, doc * far + above), n - 1)
        self.parent = np.where((above >= 0) & (key[at] == doc * far + above), at, -1)
        inner = np.flatnonzero(self.parent >= 0)
        self.rows = inner[np.argsort(self.parent[inner], kind="stable")]  # children, by parents and in order
        self.count = np.bincount(self.parent[inner], minlength=n)
        self.first = np.cumsum(self.count) - self.count

    def levels(self):
        """Rows that lie equally deep, the deepest first."""
        here, out = np.flatnonzero(self.parent < 0), []
        while len(here):
            out.append(here)
            below = np.zeros(len(self.parent), bool)
            below[here] = True
            here = self.rows[below[self.parent[self.rows]]]
        return out[::-1]

    def all_of(self, rows: np.ndarray, holds: np.ndarray) -> np.ndarray:
        """Whether all children of these rows are of the rows that ``holds`` says."""
        return self.count_of(rows, ~holds) == 0

    def count_of(self, rows: np.ndarray, holds: np.ndarray) -> np.ndarray:
        """How many children of these rows are of the rows that ``holds`` says."""
        upto = np.append(0, np.cumsum(holds[self.rows]))
        return upto[self.first[rows] + self.count[rows]] - upto[self.first[rows]]


class Fold:
    """A model over types that have numbers; None takes anything."""

    def __init__(self, model: Model | None, number: dict[str, int]):
        self.model = model
        if model is None:
            return
        if model.kind == "all":
            self.counts = [(number.get(n, -1), low, high) for n, low, high in model.counts]
            return
        moves, final = automaton(model)
        self.final = frozenset(final)
        self.moves: dict[tuple[int, int], int] = {(s, number[n]): to for (s, n), to in moves.items() if n in number}
        self.states = [frozenset([0])]
        self.known = {self.states[0]: 0}
        self.steps: dict[tuple[int, int], int] = {}

    def _step(self, state: int, kind: int, sets: list[frozenset]) -> int:
        if (to := self.steps.get((state, kind))) is None:
            there = frozenset(self.moves[s, t] for s in self.states[state] for t in sets[kind] if (s, t) in self.moves)
            if there not in self.known:
                self.known[there] = len(self.states)
                self.states.append(there)
            to = self.steps[state, kind] = self.known[there]
        return to

    def takes(self, children: Children, rows: np.ndarray, kind: np.ndarray, sets: list[frozenset]) -> np.ndarray:
        """Whether the model takes the children of each of ``rows``; ``kind`` numbers the ``sets`` of all elements' types."""
        if self.model is None:
            return np.ones(len(rows), bool)
        if self.model.kind == "all":
            of = lambda test: np.array([test(s) for s in sets], bool)[kind]
            mine = {t for t, _, _ in self.counts}
            ok = children.all_of(rows, of(lambda s: bool(s & mine)))
            for t, low, high in self.counts:
                n = children.count_of(rows, of(lambda s, t=t: t in s))
                ok &= (n >= low) & (n <= (len(kind) if high is None else high))
            return ok
        state, many = np.zeros(len(rows), np.int64), len(sets)
        order = np.argsort(-children.count[rows], kind="stable")  # those with most children first
        size = -children.count[rows][order]
        k, left = 0, int(np.searchsorted(size, 0))
        while left:
            who = order[:left]
            pairs, which = np.unique(state[who] * many + kind[children.rows[children.first[rows[who]] + k]], return_inverse=True)
            state[who] = np.array([self._step(*divmod(int(p), many), sets) for p in pairs], np.int64)[which]
            k += 1
            left = int(np.searchsorted(size, -k))
        return np.array([bool(s & self.final) for s in self.states], bool)[state]
