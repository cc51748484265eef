"""Helpers of the corpus operators: free column names, written tables, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.storage import shared_dir, written

__all__ = ["free_name", "power_of_two", "shared_dir", "text_bytes", "without_results", "written"]


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def without_results(df: DataFrame, results: tuple[str, ...], *keep: str) -> DataFrame:
    """df without the columns that bear a result's name (compared without case), but for those in ``keep``."""
    drop = {c.lower() for c in results} - {c.lower() for c in keep}
    return df.drop(*[c for c in df.columns if c.lower() in drop])


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, summed where they lie."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")), F.lit(0))).first()[0])


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least n, as its exponent."""
    return max(0, int(n - 1).bit_length()) if n > 1 else 0
