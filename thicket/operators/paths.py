"""Path and selector strings.

A string is read once, on the driver, into the chain of steps and predicates that one would
write by hand; what runs is the same DataFrame plan, and Catalyst plans it.  Paths and other
expressions are read by ``expressions``, selectors become calls of ``css``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from thicket.operators import css
from thicket.operators.expressions import PathError, evaluate

__all__ = ["PathError", "select", "xpath"]

def xpath(nodes: DataFrame, path: str, namespaces: dict[str, str] | None = None, variables: dict[str, float | str | bool] | None = None) -> DataFrame:
    """The nodes that a path selects in every document, each once, or the value of any other expression: see ``expressions.evaluate``."""
    return evaluate(nodes, path, namespaces, variables)


_COMPOUND = re.compile(
    r"""(?P<tag>\*|[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[\w-]+))\s*(?P<flag>i)?\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"""
)


def _compound(text: str) -> tuple[Column, bool]:
    """A compound selector as a Column, and whether :empty is asked for besides."""
    out, at, empty = css.tag(), 0, False
    while at < len(text):
        m = _COMPOUND.match(text, at)
        if not m or (m["tag"] and at):
            raise PathError(f"selector {text!r} can't be read from {text[at:]!r}")
        at = m.end()
        if m["tag"]:
            out = out & css.tag(m["tag"])
        elif m["id"]:
            out = out & css.id_(m["id"])
        elif m["cls"]:
            out = out & css.class_(m["cls"])
        elif m["attr"]:
            out = out & css.has(m["attr"], m["op"], next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), ""), bool(m["flag"]))
        elif m["pseudo"] == "empty" and m["arg"] is None:
            empty = True
        else:
            out = out & _pseudo(m["pseudo"], m["arg"])
    return out, empty


def _pseudo(name: str, arg: str | None) -> Column:
    plain = {"first-child": css.first_child, "last-child": css.last_child, "only-child": css.only_child}
    if name in plain and arg is None:
        return plain[name]()
    if name in ("nth-child", "nth-last-child") and arg:
        flat = {"odd": "2n+1", "even": "2n"}.get(arg.strip(), re.sub(r"\s+", "", arg))
        m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", flat)
        if m and flat:
            a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
            return (css.nth_child if name == "nth-child" else css.nth_last_child)(a, int(m[2] or 0))
    if name == "not" and arg:
        inner, empty = _compound(arg.strip())
        if not empty:
            return css.not_(inner)
    raise PathError(f"no such pseudo-class: :{name}{'' if arg is None else f'({arg})'}")


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The elements that a selector string matches, each once: compounds, ``,`` and the combinators `` `` ``>`` ``+`` ``~``.

    What can't be read and unknown pseudo-classes are a PathError, before anything runs.
    """
    matched = []
    for group in _split(selector, ","):
        parts = [p for p in re.split(r"\s*([>+~])\s*|\s+(?![>+~])", _shielded(group.strip())) if p is not None]
        found, sign = None, " "
        for p in (_unshielded(p) for p in parts):
            if p in (">", "+", "~"):
                sign = p
                continue
            if not p:
                raise PathError(f"selector {selector!r} has an empty part")
            test, empty = _compound(p)
            found = css.select(nodes, test) if found is None else css.combine(found, sign, nodes, test)
            found, sign = css.empty(found, nodes) if empty else found, " "
        if found is None or sign != " ":
            raise PathError(f"selector {selector!r} has an empty part")
        matched.append(found)
    return matched[0] if len(matched) == 1 else css.any_of(*matched)


_INNER = re.compile(r"""\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)""")
_SIGNS = {c: chr(0xE000 + k) for k, c in enumerate(" \t\n>+~,")}


def _shielded(text: str) -> str:
    """Signs within brackets and parentheses stand for themselves until the parts are cut."""
    return _INNER.sub(lambda m: "".join(_SIGNS.get(c, c) for c in m[0]), text)


def _unshielded(text: str) -> str:
    back = {v: k for k, v in _SIGNS.items()}
    return "".join(back.get(c, c) for c in text)


def _split(text: str, sign: str) -> list[str]:
    return [_unshielded(p) for p in _shielded(text).split(sign)]
