"""Structured Streaming over documents: whole ones, ones in chunks (see ``push``), and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.sources.xml import ParseOptions, parse_xml
from thicket.streaming.push import assemble_stream, push_events

__all__ = ["assemble_stream", "interval_join", "push_events", "sessions", "stream_nodes", "windowed"]


def stream_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: ParseOptions | None = None) -> DataFrame:
    """Nodes of a stream of whole documents: the same narrow parse as in batch."""
    return parse_xml(docs, id_col, text_col, options)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time_col: str = "ts", keys: tuple[str, ...] = (), **aggregates) -> DataFrame:
    """Aggregates by tumbling or sliding windows of event time, for streams and tables alike."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), *keys).agg(*[v.alias(k) for k, v in aggregates.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time_col: str = "ts", keys: tuple[str, ...] = (), **aggregates) -> DataFrame:
    """Aggregates by sessions: runs of events of a key less than ``gap`` apart."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(*[v.alias(k) for k, v in aggregates.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, left_time: str = "l_ts", right_time: str = "r_ts", late: str = "10 minutes") -> DataFrame:
    """Pairs of one key whose right time is at or after the left one, by ``within`` at most; streams or tables."""
    if left.isStreaming:
        left, right = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    on = (left[key] == right[key]) & (right[right_time] >= left[left_time]) & (right[right_time] <= left[left_time] + F.expr(f"interval {within}"))
    return left.join(right, on).drop(right[key])
