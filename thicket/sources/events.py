"""Event streams of documents, from the node table: what a push or a pull parser would report, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events(nodes: DataFrame) -> DataFrame:
    """(doc_id, at, turn, close, event, depth, name, prefix, namespace, attrs, value), ordered by (at, turn, close).

    event is one of start_document, end_document, start_element, end_element, characters,
    whitespace, cdata, comment, processing_instruction, doctype.  A narrow transformation:
    an element or document is two rows, others one.
    """
    blank = (F.col("kind") == "text") & F.col("content").rlike(r"^[ \t\r\n]*$")
    first = (
        F.when(F.col("kind") == "document", "start_document").when(F.col("kind") == "element", "start_element").when(blank, "whitespace").when(F.col("kind") == "text", "characters").when(F.col("kind") == "pi", "processing_instruction").otherwise(F.col("kind"))
    )
    last = F.when(F.col("kind") == "document", "end_document").when(F.col("kind") == "element", "end_element")
    part = lambda at, turn, close, event: F.struct(at.alias("at"), F.lit(turn).alias("turn"), close.alias("close"), event.alias("event"))
    both = F.array(part(F.col("pre"), 0, F.lit(0), first), part(F.col("post"), 1, -F.col("depth"), last))
    rows = nodes.withColumn("e", F.explode(both)).filter("e.event is not null")
    return rows.select("doc_id", "e.at", "e.turn", "e.close", "e.event", "depth", "name", "prefix", "namespace", F.when(F.col("e.turn") == 0, F.col("attrs")).alias("attrs"), F.when(F.col("e.turn") == 0, F.col("content")).alias("value"))


def assemble(chunks: DataFrame, id_col: str = "doc_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(doc_id, text) of documents that came in numbered chunks."""
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq_col, chunk_col))), lambda x: x[chunk_col]), "").alias("text"))
