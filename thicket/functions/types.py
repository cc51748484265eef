"""XML Schema's built-in types and facets as predicates on text Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"[ \t\r\n]+", " "))


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda v: collapse(v).rlike(f"^(?:{pattern})$")


def _integer(low: int | None = None, high: int | None = None) -> Callable[[Column], Column]:
    def ok(v: Column) -> Column:
        s = collapse(v)
        n = F.when(s.rlike(r"^[+-]?[0-9]{1,38}$"), F.regexp_replace(s, r"^\+", "").try_cast("decimal(38,0)"))
        out = s.rlike(r"^[+-]?[0-9]+$")
        if low is not None:
            out = out & (n >= F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            out = out & (n <= F.lit(str(high)).cast("decimal(38,0)"))
        return F.coalesce(out, F.lit(False))

    return ok


_ZONE = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_DAY = r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"


def _day_exists(v: Column) -> Column:
    return F.regexp_extract(collapse(v), r"^-?([0-9]{4,}-[0-9]{2}-[0-9]{2})", 1).try_cast("date").isNotNull()


_true = lambda v: v.isNotNull()
#: Type name -> predicate.
BUILTIN: dict[str, Callable[[Column], Column]] = {
    "anyType": _true,
    "anySimpleType": _true,
    "string": _true,
    "anyURI": _true,
    "normalizedString": lambda v: ~v.rlike(r"[\t\r\n]"),
    "token": lambda v: ~v.rlike(r"[\t\r\n]|^ | $|  "),
    "boolean": _like("true|false|1|0"),
    "decimal": _like(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"),
    "float": _like(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NaN"),
    "double": _like(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|-?INF|NaN"),
    "date": lambda v: _like(_DAY + _ZONE)(v) & _day_exists(v),
    "dateTime": lambda v: _like(f"{_DAY}T{_TIME}{_ZONE}")(v) & _day_exists(v),
    "time": _like(_TIME + _ZONE),
    "ID": _like(r"[\p{L}_][\p{L}\p{N}._\-]*"),
    "IDREF": _like(r"[\p{L}_][\p{L}\p{N}._\-]*"),
    "NMTOKEN": _like(r"[\p{L}\p{N}._:\-]+"),
    "integer": _integer(),
    "long": _integer(-(2**63), 2**63 - 1),
    "int": _integer(-(2**31), 2**31 - 1),
    "short": _integer(-(2**15), 2**15 - 1),
    "byte": _integer(-128, 127),
    "nonNegativeInteger": _integer(0),
    "positiveInteger": _integer(1),
    "nonPositiveInteger": _integer(None, 0),
    "negativeInteger": _integer(None, -1),
    "unsignedLong": _integer(0, 2**64 - 1),
    "unsignedInt": _integer(0, 2**32 - 1),
    "unsignedShort": _integer(0, 2**16 - 1),
    "unsignedByte": _integer(0, 255),
}
_ORDERED = {"date": "date", "dateTime": "timestamp"}


def list_of(item: str) -> Callable[[Column], Column]:
    """Values of white-space separated items, each of the type."""
    return lambda v: F.forall(F.filter(F.split(collapse(v), " "), lambda x: x != ""), BUILTIN[item])


def union_of(*members: str) -> Callable[[Column], Column]:
    def ok(v: Column) -> Column:
        out = F.lit(False)
        for m in members:
            out = out | F.coalesce(BUILTIN[m](v), F.lit(False))
        return out

    return ok


def facets_ok(v: Column, kind: str, facets: dict[str, object]) -> Column:
    """Whether the value meets all facets; whiteSpace is applied first."""
    space = facets.get("whiteSpace", "preserve" if kind == "string" else "replace" if kind == "normalizedString" else "collapse")
    s = collapse(v) if space == "collapse" else F.translate(v, "\t\r\n", "   ") if space == "replace" else v
    order = _ORDERED.get(kind, "decimal(38,18)" if kind not in ("float", "double") else "double")
    x = lambda t: t.try_cast(order)
    digits = F.regexp_replace(F.regexp_replace(s, r"^[+-]?0*", ""), r"\.", "")
    tests = {
        "length": lambda n: F.length(s) == n,
        "minLength": lambda n: F.length(s) >= n,
        "maxLength": lambda n: F.length(s) <= n,
        "pattern": lambda p: s.rlike(f"^(?:{p})$"),
        "enumeration": lambda e: s.isin(list(e)),
        "minInclusive": lambda n: x(s) >= x(F.lit(str(n))),
        "maxInclusive": lambda n: x(s) <= x(F.lit(str(n))),
        "minExclusive": lambda n: x(s) > x(F.lit(str(n))),
        "maxExclusive": lambda n: x(s) < x(F.lit(str(n))),
        "totalDigits": lambda n: F.length(digits) <= n,
        "fractionDigits": lambda n: F.length(F.regexp_extract(s, r"\.([0-9]*?)0*$", 1)) <= n,
        "whiteSpace": lambda _: F.lit(True),
    }
    out = F.lit(True)
    for name, value in facets.items():
        out = out & tests[name](value)
    return out
