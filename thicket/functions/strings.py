"""String functions with XPath's meaning: total, counting code points, empty where SQL has null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.numbers import round_half_up


def before(s: Column, mark: Column) -> Column:
    """The part before the first mark, empty if there is none."""
    at = F.call_function("instr", s, mark)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise("")


def after(s: Column, mark: Column) -> Column:
    """The part after the first mark, empty if there is none; all of s for an empty mark."""
    at = F.call_function("instr", s, mark)
    rest = F.substring(s, at + F.length(mark), F.length(s) + F.lit(1))
    return F.when(F.length(mark) == 0, s).when(at > 0, rest).otherwise("")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """The characters at positions p with p >= round(start) and p < round(start) + round(length)."""
    big = float(2**30)
    bound = lambda x: F.greatest(F.lit(-big), F.least(F.lit(big), x))
    low = round_half_up(start)
    a = F.greatest(F.lit(1.0), bound(low))
    if length is None:
        bad, z = F.isnan(low), F.lit(big)
    else:
        high = low + round_half_up(length)
        bad, z = F.isnan(low) | F.isnan(high), bound(high)
    n = F.greatest(F.lit(0.0), z - a)
    return F.when(bad, "").otherwise(F.substring(s, a.cast("int"), n.cast("int")))


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def translate(s: Column, these: str, those: str) -> Column:
    return F.translate(s, these, those)


def matches(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(_flagged(pattern, flags))


def replace(s: Column, pattern: str, by: str, flags: str = "") -> Column:
    """Every match by the text ``by``, in which $1 to $9 stand for groups."""
    return F.regexp_replace(s, _flagged(pattern, flags), by)


def tokens(s: Column, pattern: str = r"\s+", flags: str = "") -> Column:
    """The parts between matches, as an array; the default splits at white space and has no empty parts."""
    parts = F.split(s, _flagged(pattern, flags))
    return F.filter(parts, lambda x: F.length(x) > 0) if pattern == r"\s+" else parts


def _flagged(pattern: str, flags: str) -> str:
    if set(flags) - set("smix"):
        raise ValueError(f"unknown flags {flags!r}")
    return f"(?{flags})" * bool(flags) + pattern
