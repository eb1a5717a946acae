"""Streaming queries: each runs its real streaming plan over staged files to completion.

Inputs are derived from the given tables and staged as Parquet in the shared
checkpoint folder; two heartbeat files with a far-future event time follow the
data so the watermark passes every session / join window before the run ends
(a live stream never ends; a finite check has to close its windows).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators.rpc import rpc_replies
from tracelake.plans.duck import OUTPUTS, cte
from tracelake.plans.q_extract import SEGMENTS
from tracelake.plans.registry import ORACLE, query
from tracelake.sources import fixtures as fx
from tracelake.streaming import rpc as SR
from tracelake.streaming import sessions as SE
from tracelake.streaming import sse as SS
from tracelake.streaming.runner import run_to_sink, scratch, stage, stage_by_time

HEARTBEAT_TS = "TIMESTAMP_NTZ '2199-01-01 00:00:00'"


def _staged_stream(spark, df, name, heartbeat=None, ts="ts"):
    """Ranges of event time one after another, every range by many tasks; then the heartbeats."""
    src = scratch(spark, name)
    files = stage_by_time(df, src, ts)
    if heartbeat is not None:
        for _ in range(2):
            stage(heartbeat.repartition(1), src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(src)


def _chunk_stream(spark, sf):
    """Chunks as a server sends them: every third output ends with an end chunk, every fifth chunk comes twice, and the
    late ones (of closed sessions, a minute after) must change nothing."""
    o = fx.outputs(spark, sf).select("out_id", "ts", "text")
    ch = fx.chunks(o).withColumn("finish_reason", F.lit(None).cast("string"))
    ended = o.where("out_id % 3 = 0").selectExpr(
        "out_id AS id", "CAST(ceil(length(text) / 16) AS INT) AS chunk_seq", "ts", "'' AS content", "'stop' AS finish_reason")
    again = ch.where("(id + chunk_seq) % 5 = 0")
    late = ended.selectExpr("id", "chunk_seq + 1 AS chunk_seq", "ts + INTERVAL '60' SECOND AS ts", "'LATE' AS content",
                            "CAST(NULL AS STRING) AS finish_reason")
    all_ = ch.unionByName(ended).unionByName(again).unionByName(late)
    hb = ch.limit(1).selectExpr("CAST(-1 AS BIGINT) AS id", "0 AS chunk_seq", f"{HEARTBEAT_TS} AS ts", "'' AS content",
                                "CAST(NULL AS STRING) AS finish_reason")
    return _staged_stream(spark, all_, "chunks", hb)


CHUNKS_DUCK = ("SELECT out_id AS id, CAST(i AS INT) AS chunk_seq, ts, substr(text, CAST(i * 16 + 1 AS INT), 16) AS content "
               "FROM (SELECT *, unnest(range(0, CAST(floor((length(text) - 1) / 16) AS INT) + 1)) AS i FROM o)")


@query("stream_sse_assemble", cte(o=OUTPUTS, c=CHUNKS_DUCK)
       + "SELECT id, string_agg(content, '' ORDER BY chunk_seq) AS text, CAST(count(*) AS INT) + CAST(id % 3 = 0 AS INT) AS n_chunks "
         "FROM c GROUP BY id")
def q_stream_sse_assemble(spark, sf):
    s = SE.assembled(SE.session_texts(_chunk_stream(spark, sf))).select("id", "text", "n_chunks")
    return run_to_sink(s, scratch(spark, "sse-sink"))


@query("stream_segment_events", SEGMENTS)
def q_stream_segment_events(spark, sf):
    return run_to_sink(SE.segments(SE.session_events(_chunk_stream(spark, sf)), "out_id"), scratch(spark, "seg-sink"))


@query("stream_extract_calls", ORACLE["extract_tool_calls"])
def q_stream_extract_calls(spark, sf):
    o = fx.outputs(spark, sf).select("out_id", "text", "ts")
    return run_to_sink(SS.stream_extract_calls(_staged_stream(spark, o, "outputs")), scratch(spark, "calls-sink"))


@query("stream_rpc_correlate", "SELECT * REPLACE (CASE WHEN result IS NOT NULL THEN CAST(json(result) AS VARCHAR) END AS result) FROM ("
       + ORACLE["rpc_correlate"] + ")")
def q_stream_rpc_correlate(spark, sf):
    """Replies as raw lines: some come twice (the later one differs), some lines are broken or no replies."""
    req = fx.rpc_requests(spark, sf)
    resp = fx.rpc_responses(spark, sf)
    line = "concat('{{\"jsonrpc\": \"2.0\", \"id\": ', id, ', \"result\": ', {0}, '}}')"
    lines = resp.selectExpr("conn_id", "resp_ts", line.format("result") + " AS line")
    twice = resp.where("id % 3 = 0").selectExpr("conn_id", "resp_ts + INTERVAL '1' SECOND AS resp_ts",
                                                line.format("'{\"ok\": false}'") + " AS line")
    broken = resp.where("id % 4 = 0").selectExpr(
        "conn_id", "resp_ts", "CASE id % 3 WHEN 0 THEN concat('{\"id\": ', id, ', ') WHEN 1 THEN '[1]' ELSE "
        "'{\"method\": \"notifications/progress\"}' END AS line")
    hq = req.limit(1).selectExpr("CAST(-1 AS BIGINT) AS conn_id", "CAST(-1 AS BIGINT) AS id", "'heartbeat' AS method",
                                 "'{}' AS params", f"{HEARTBEAT_TS} AS req_ts")
    hr = resp.limit(1).selectExpr("CAST(-2 AS BIGINT) AS conn_id", f"{HEARTBEAT_TS} AS resp_ts", "'{\"id\": -2}' AS line")
    replies = rpc_replies(_staged_stream(spark, lines.unionByName(twice).unionByName(broken), "rpc-resp", hr, "resp_ts"))
    j = SR.stream_rpc_correlate(_staged_stream(spark, req, "rpc-req", hq, "req_ts"), replies)
    return run_to_sink(j, scratch(spark, "rpc-sink")).where("conn_id >= 0")


@query("stream_dead_letter", ORACLE["json_dead_letter"])
def q_stream_dead_letter(spark, sf):
    b = fx.bodies(spark, sf).select("body_id", "body", "ts")
    ok, bad = scratch(spark, "dl-valid"), scratch(spark, "dl-rejected")
    qa, qb = SR.start_dead_letter(_staged_stream(spark, b, "bodies"), ok, bad)
    for q in (qa, qb):
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return spark.read.parquet(ok).unionByName(spark.read.parquet(bad)).drop("ts")

