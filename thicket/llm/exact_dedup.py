"""Exact duplicates: 128-bit content hash, smallest id stays, bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import free_name, without_results

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: docs' columns, then keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one
    space; a null text counts as empty.  Of equal texts, the row with the smallest id stays;
    a null id sorts after all others, and a group of null ids alone has a null keep_id.  Rows
    that repeat an id with an equal text all count in group_size and are all marked kept, for
    theirs is the id that stays.  An empty table gives an empty result.  Columns of docs that
    bear a result's name, in any case, are replaced; other columns pass through whatever their names.

    Only DataFrame functions run.  The aggregation groups by the 128-bit hash *and* the text:
    the hash places a row, the text's bytes decide within a hash, so a collision makes two
    groups.  It combines on the map side, so a group of copies shuffles one row per task
    however large it is.  The way back to every row joins slim rows, keyed by the 128-bit hash
    and, to tell collided texts apart, the SHA-256 that the result shows anyway; its hot keys
    are plain equi-join keys that AQE splits.
    """
    docs = without_results(docs, RESULT, id_col, text_col)
    norm, h, g_h, g_norm, g_sha = free_name(docs, "norm", "h128", "g_h128", "g_norm", "g_sha256")
    doc_id = F.col(f"`{id_col}`")
    base = docs.withColumn(norm, F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    base = base.withColumn(h, F.unhex(F.md5(F.col(norm))))
    groups = (
        base.groupBy(F.col(h).alias(g_h), F.col(norm).alias(g_norm))
        .agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(g_h, F.sha2(F.col(g_norm), 256).alias(g_sha), "keep_id", "group_size")
    )
    rows = base.withColumn("text_sha256", F.sha2(F.col(norm), 256)).drop(norm)
    out = rows.join(groups, (F.col(h) == F.col(g_h)) & (F.col("text_sha256") == F.col(g_sha)), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "keep_id", "group_size", doc_id.eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
