"""Content models as deterministic automata, folded over an element's children.

A model is compiled once, on the driver, to a table of transitions; a row's children are an
array, and the fold over it is a built-in higher-order function: no backtracking, no
recursion, one step a child however many there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most states of an automaton.
MOST_STATES = 10_000


@dataclass(frozen=True)
class Model:
    """name, seq, or, rep (low to high times, high None: any), and all (any order, each counted)."""

    kind: str
    parts: tuple[Model, ...] = ()
    name: str = ""
    low: int = 1
    high: int | None = 1
    counts: tuple[tuple[str, int, int | None], ...] = ()


EMPTY = Model("seq")


def el(name: str) -> Model:
    return Model("name", name=name)


def seq(*parts: Model) -> Model:
    return Model("seq", parts)


def one_of(*parts: Model) -> Model:
    return Model("or", parts)


def times(part: Model, low: int = 0, high: int | None = None) -> Model:
    return Model("rep", (part,), low=low, high=high)


def interleave(*parts: tuple[str, int, int | None]) -> Model:
    """(name, least, most) in any order, and no other name; a whole model, not a part of one."""
    return Model("all", counts=parts)


def names_of(m: Model) -> list[str]:
    """The names in a model, as often as they stand there."""
    return [n for n, *_ in m.counts] if m.kind == "all" else [m.name] if m.kind == "name" else [n for p in m.parts for n in names_of(p)]


def parse(text: str) -> Model:
    """A DTD's content model: names, ``,`` ``|`` ``?`` ``*`` ``+`` and parentheses."""
    tokens = re.findall(r"[()|,?*+]|[^\s()|,?*+]+", text)
    stack: list[tuple[list[Model], list[str]]] = [([], [])]
    for k, t in enumerate(tokens):
        parts, signs = stack[-1]
        if t == "(":
            stack.append(([], []))
        elif t == ")":
            if len(stack) == 1 or not parts:
                raise ValueError(f"content model {text!r} isn't well-formed")
            stack.pop()
            stack[-1][0].append(_group(parts, signs, text))
        elif t in "|,":
            signs.append(t)
        elif t in "?*+":
            if not parts or tokens[k - 1] in "(|,?*+":
                raise ValueError(f"content model {text!r} isn't well-formed")
            parts[-1] = times(parts[-1], int(t == "+"), 1 if t == "?" else None)
        else:
            parts.append(el(t))
    if len(stack) > 1:
        raise ValueError(f"content model {text!r} isn't well-formed")
    return _group(*stack[0], text)


def _group(parts: list[Model], signs: list[str], text: str) -> Model:
    if len(set(signs)) > 1 or len(signs) != max(0, len(parts) - 1):
        raise ValueError(f"content model {text!r} isn't well-formed")
    return one_of(*parts) if signs[:1] == ["|"] else seq(*parts)


@dataclass
class _Graph:
    """Positions joined by silent moves and by names."""

    silent: list[list[int]] = field(default_factory=list)
    named: list[list[tuple[str, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.silent.append([])
        self.named.append([])
        return len(self.silent) - 1

    def add(self, m: Model, at: int) -> int:
        """Puts m behind a position; the position behind m."""
        if m.kind == "name":
            end = self.state()
            self.named[at].append((m.name, end))
            return end
        if m.kind == "seq":
            for p in m.parts:
                at = self.add(p, at)
            return at
        if m.kind == "or":
            end = self.state()
            for p in m.parts:
                self.silent[self.add(p, at)].append(end)
            return end
        if m.kind == "rep":
            for _ in range(m.low):
                at = self.add(m.parts[0], self._apart(at))
            if m.high is None:
                loop = self._apart(at)
                self.silent[self.add(m.parts[0], loop)].append(loop)
                return self._apart(loop)
            ends = [at]
            for _ in range(m.high - m.low):
                at = self.add(m.parts[0], self._apart(at))
                ends.append(at)
            end = self.state()
            for e in ends:
                self.silent[e].append(end)
            return end
        raise ValueError("names in any order are a whole model, not a part of one")

    def _apart(self, at: int) -> int:
        new = self.state()
        self.silent[at].append(new)
        return new

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.silent[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def automaton(m: Model) -> tuple[dict[tuple[int, str], int], set[int]]:
    """(state, name) -> state, from state 0, and the states in which the children may end."""
    g = _Graph()
    first = g.state()
    last = g.add(m, first)
    number = {g.closed([first]): 0}
    moves, todo = {}, list(number)
    while todo:
        here = todo.pop()
        by_name: dict[str, set[int]] = {}
        for s in here:
            for name, to in g.named[s]:
                by_name.setdefault(name, set()).add(to)
        for name, to in by_name.items():
            there = g.closed(to)
            if there not in number:
                if len(number) >= MOST_STATES:
                    raise ValueError(f"a content model needs over {MOST_STATES} states")
                number[there] = len(number)
                todo.append(there)
            moves[number[here], name] = number[there]
    return moves, {k for s, k in number.items() if last in s}


def fits(children: Column, m: Model) -> Column:
    """Whether an array of child names is what the model allows."""
    if m.kind == "all":
        known = F.forall(children, lambda x: x.isin([n for n, *_ in m.counts]))
        for name, low, high in m.counts:
            n = F.size(F.filter(children, _named(name)))
            known = known & (n >= low) & (F.lit(True) if high is None else n <= high)
        return known
    moves, final = automaton(m)
    if not moves:
        return F.size(children) == 0
    table = F.create_map(*[F.lit(x) for (s, name), to in moves.items() for x in (f"{s} {name}", to)])
    # From a state without a move there is no way on: -1 stays -1.
    end = F.aggregate(children, F.lit(0), lambda s, x: F.coalesce(F.try_element_at(table, F.concat_ws(" ", s.cast("string"), x)), F.lit(-1)))
    return end.isin(sorted(final)) if final else F.lit(False)


def _named(name: str):
    return lambda x: x == name
