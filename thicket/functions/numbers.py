"""Numbers as XPath has them: IEEE doubles, never an error, and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
_LITERAL = r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"


def to_number(s: Column) -> Column:
    """The double a text stands for, NaN for any other text (signs other than -, exponents and suffixes too)."""
    trimmed = F.regexp_replace(s, r"[ \t\r\n]+", "")
    return F.when(s.rlike(_LITERAL), trimmed.try_cast("double")).otherwise(F.lit(NAN))


def to_text(x: Column) -> Column:
    """NaN, Infinity, -Infinity; integers without a point, -0 as 0; others in decimal notation."""
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < 1e18)
    plain = F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(whole, x.cast("long").cast("string")).when(F.abs(x) < 1e18, F.when(plain.isin("", "-"), "0").otherwise(plain)).otherwise(x.cast("string"))


def divide(a: Column, b: Column) -> Column:
    """a div b: by zero an infinity of the right sign, or NaN."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a > 0) == ~F.startswith(b.cast("string"), F.lit("-")), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """a mod b: the sign of a; NaN for a zero or NaN divisor or an infinite dividend."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")), F.lit(NAN)).when(F.abs(b) == float("inf"), a).otherwise(F.try_mod(a, b))


def _keep(x: Column, f) -> Column:
    """f on finite numbers below 2**52; others are integers or not finite and stay."""
    return F.when(F.isnan(x) | (F.abs(x) >= float(2**52)), x).otherwise(f(x).cast("double"))


def floor(x: Column) -> Column:
    return _keep(x, F.floor)


def ceiling(x: Column) -> Column:
    return _keep(x, F.ceil)


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves toward positive infinity."""
    return _keep(x, lambda y: F.floor(y + 0.5))


def truth_of_number(x: Column) -> Column:
    return ~F.isnan(x) & (x != 0)


def truth_of_text(s: Column) -> Column:
    return F.length(s) > 0
