"""Streaming JSON-RPC correlation and dead-letter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.rpc import json_dead_letter
from tracelake.streaming.sse import event_time


def stream_rpc_correlate(requests: DataFrame, responses: DataFrame, timeout_s: int = 10,
                         watermark: str = "1 minute") -> DataFrame:
    """Stream-stream left outer join and the first reply of each request within ``timeout_s``.

    Both sides carry a watermark, so the join state is bounded: a request waits at most ``timeout_s`` (plus
    the watermark delay) for its reply, else it comes out with ``status = 'timeout'``.  A server that
    answers twice gives two joined rows; an aggregate by request and its event time keeps
    the earliest, as in the batch form, and lets a request go when the watermark has passed it.
    Output as in ``operators.rpc.rpc_correlate``.
    """
    q = event_time(requests, "req_ts").withWatermark("req_ts", watermark).alias("q")
    r = event_time(responses, "resp_ts").withWatermark("resp_ts", watermark).alias("r")
    cond = ((F.col("q.conn_id") == F.col("r.conn_id")) & (F.col("q.id") == F.col("r.id"))
            & F.col("r.resp_ts").between(F.col("q.req_ts"),
                                         F.col("q.req_ts") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")))
    j = q.join(r, cond, "leftOuter").select(
        F.col("q.conn_id").alias("conn_id"), F.col("q.id").alias("id"), F.col("q.method").alias("method"), F.col("q.req_ts"),
        F.unix_micros("r.resp_ts").alias("resp"), F.col("r.result").alias("result"), F.unix_micros("q.req_ts").alias("req"))
    first = j.groupBy("conn_id", "id", "req_ts").agg(
        F.first("method").alias("method"), F.min("req").alias("req"), F.min("resp").alias("resp"),
        F.min_by("result", "resp").alias("result"))
    return first.select(
        "conn_id", "id", "method", F.when(F.col("resp").isNull(), "timeout").otherwise("ok").alias("status"),
        F.when(F.col("resp").isNotNull(), F.coalesce("result", F.lit("{}"))).alias("result"),
        F.floor((F.col("resp") - F.col("req")) / 1_000_000).cast("long").alias("latency_s"))


def start_dead_letter(bodies: DataFrame, valid_path: str, rejected_path: str, body: str = "body"):
    """Two append-mode file sinks over one source: valid bodies and rejected ones.

    Each sink is exactly-once through its own checkpoint and file-sink log (a
    re-run of a batch does not duplicate rows); no driver callback is involved.
    Returns the two started queries.
    """
    d = json_dead_letter(bodies, body)
    qa = (d.where("valid").writeStream.format("parquet").option("checkpointLocation", valid_path + "-checkpoint")
          .trigger(availableNow=True).start(valid_path))
    qb = (d.where("NOT valid").writeStream.format("parquet").option("checkpointLocation", rejected_path + "-checkpoint")
          .trigger(availableNow=True).start(rejected_path))
    return qa, qb
