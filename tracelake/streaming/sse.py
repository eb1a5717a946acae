"""Streaming assembly of completion chunks by session windows, and call extraction.

``assemble_chunks``: chunks of one completion arrive as rows ``(id, chunk_seq,
ts, content)``; a session window per id (gap 30 s) with a watermark on ``ts``
closes each completion, the chunks are ordered by ``chunk_seq`` and
concatenated.  Append mode: a completion is emitted once the watermark passes
its session end; chunks later than the watermark are dropped (late data).

Sessions that close on an end chunk, drop repeated chunks and give events before they
close are keyed state: ``streaming.sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.extract import extract_tool_calls


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need ``TIMESTAMP``: a naive (``TIMESTAMP_NTZ``) event time is cast."""
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        return df.withColumn(col, F.col(col).cast("timestamp"))
    return df


def assemble_chunks(chunks: DataFrame, gap: str = "30 seconds", watermark: str = "1 minute",
                    key: str = "id") -> DataFrame:
    """``id, text, n_chunks, session_start, session_end`` per completed session."""
    w = event_time(chunks, "ts").withWatermark("ts", watermark)
    g = w.groupBy(key, F.session_window("ts", gap).alias("session")).agg(
        F.array_sort(F.collect_list(F.struct("chunk_seq", "content"))).alias("_c"))
    return g.select(key, F.array_join(F.transform("_c", lambda x: x["content"]), "").alias("text"),
                    F.size("_c").alias("n_chunks"), F.col("session.start").alias("session_start"),
                    F.col("session.end").alias("session_end"))


def stream_extract_calls(outputs: DataFrame, text: str = "text", key: str = "out_id") -> DataFrame:
    """Stateless call extraction on a stream of outputs (append)."""
    return extract_tool_calls(outputs, text, (key,))
