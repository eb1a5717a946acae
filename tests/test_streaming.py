"""Streaming: a restarted stream (same checkpoint) equals its batch twin; late chunks drop."""

import random
import re

from pyspark.sql import functions as F

from tracelake.functions.markers import SPECIAL_TOKENS
from tracelake.operators.rpc import rpc_correlate, rpc_replies
from tracelake.operators.segment import segment_events
from tracelake.sources import fixtures as fx
from tracelake.streaming.rpc import stream_rpc_correlate
from tracelake.streaming.runner import scratch, stage, stage_by_time
from tracelake.streaming.sessions import assembled, feed, late_chunks, new_session, segments, session_events, session_texts
from tracelake.streaming.sse import assemble_chunks


def _run(stream, sink):
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", sink + "-ckpt")
         .trigger(availableNow=True).start(sink))
    q.awaitTermination(300)
    assert q.exception() is None


def test_restart_equals_batch_twin(spark, sf):
    o = fx.outputs(spark, sf).select("out_id", "ts", "text")
    ch = fx.chunks(o)
    src, sink = scratch(spark, "restart-src"), scratch(spark, "restart-sink")
    cut = "ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"   # a restart splits the stream in event time
    stage(ch.where(cut), src, files=1)
    schema = ch.schema
    stream = lambda: assemble_chunks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    _run(stream().select("id", "text"), sink)
    stage(ch.where(f"NOT ({cut})"), src, files=1)
    hb = ch.limit(1).selectExpr("CAST(-1 AS BIGINT) AS id", "0 AS chunk_seq",
                                "TIMESTAMP_NTZ '2999-01-01 00:00:00' AS ts", "'' AS content")
    stage(hb, src, files=1)
    stage(hb, src, files=1)
    _run(stream().select("id", "text"), sink)
    got = {r.id: r.text for r in spark.read.parquet(sink).collect()}
    want = {r.out_id: r.text for r in o.collect()}
    assert got == want


def test_late_chunk_is_dropped(spark):
    rows = [(1, 0, "2024-01-01 00:00:00", "ab"), (1, 1, "2024-01-01 00:00:01", "cd"),
            (2, 0, "2024-01-01 01:00:00", "x"),
            (1, 2, "2024-01-01 00:00:02", "LATE"),          # arrives after the watermark moved on
            (9, 0, "2999-01-01 00:00:00", "")]
    df = spark.createDataFrame(rows, "id long, chunk_seq int, ts string, content string").withColumn(
        "ts", F.to_timestamp("ts"))
    src, sink = scratch(spark, "late-src"), scratch(spark, "late-sink")

    def run():
        s = assemble_chunks(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src),
                            watermark="10 seconds")
        _run(s.select("id", "text"), sink)
    stage(df.where("id = 1 AND chunk_seq < 2"), src, files=1)
    run()
    stage(df.where("id = 2"), src, files=1)
    run()                                            # watermark moves to 00:59:50 (kept in the checkpoint)
    stage(df.where("id = 1 AND chunk_seq = 2"), src, files=1)
    run()                                            # the late chunk is dropped
    stage(df.where("id = 9"), src, files=1)
    run()
    stage(df.where("id = 9"), src, files=1)
    run()
    got = {r.id: r.text for r in spark.read.parquet(sink).collect()}
    assert got == {1: "abcd", 2: "x"}


def _stream(spark, df, src, sink, plan, steps):
    """Run ``plan`` once after each of the staged steps (row filters), as restarts of one stream."""
    for where in steps:
        stage(df.where(where), src, files=1)
        _run(plan(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)), sink)
    return spark.read.parquet(sink)


CHUNKS = "id long, chunk_seq int, ts string, content string, finish_reason string, step int"


def _chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNKS).withColumn("ts", F.to_timestamp("ts"))


def test_events_of_cut_markers_leave_before_the_session_ends(spark):
    t = "2024-01-01 00:00:0"
    parts = ["Hi<|thou", "ght_start|>plan <", "b><|thought_end|>mid<|tool_", "call_start|>{\"name\": \"t\", \"argu",
             "ments\": {\"a\": 1}}<|tool_call_end|><|im_", "end|>bye"]
    rows = [(1, i, f"{t}{i}", c, None, 0 if i < 5 else 1) for i, c in enumerate(parts)]
    rows.append((1, 6, f"{t}7", "", "stop", 1))
    df = _chunks(spark, rows)
    plan = lambda s: segments(session_events(s))
    src, sink = scratch(spark, "cut-src"), scratch(spark, "cut-sink")
    first = _stream(spark, df, src, sink, plan, ["step = 0"])
    assert [(r.phase, r.seq, r.type, r.content) for r in first.orderBy("phase", "seq").collect()] == [
        (0, 0, "text", "Hi"), (0, 2, "thought", "plan <b>"), (0, 4, "text", "mid"), (1, 0, "tool_call", None)]
    everything = _stream(spark, df, src, sink, plan, ["step = 1"])
    whole = spark.createDataFrame([(1, "".join(parts))], "id long, text string")
    key = ["phase", "seq", "type", "content", "tool_name", "arguments"]
    assert sorted(map(str, everything.select(key).collect())) == sorted(map(str, segment_events(whole, key="id").select(key).collect()))


def test_session_closes_on_its_end_chunk_counts_chunks_once_and_sends_late_ones_aside(spark):
    t = "2024-01-01 00:00:"
    rows = [(1, 1, f"{t}01", "b", None, 0), (1, 1, f"{t}01", "b", None, 0), (1, 3, f"{t}03", "", "stop", 0), (1, 0, f"{t}00", "a", None, 0),
            (2, 0, f"{t}00", "open", None, 0),
            (1, 2, f"{t}02", "c", None, 1), (1, 2, f"{t}02", "c", None, 1),   # the missing chunk comes last: now it closes
            (1, 4, f"{t}09", "late", None, 2), (1, 0, f"{t}00", "a", None, 2),  # a new place is late, an old one only repeated
            (2, 2, f"{t}04", "!", None, 2),                                   # place 1 never comes
            (9, 0, "2024-01-01 00:05:00", "", None, 3), (9, 1, "2024-01-01 00:05:01", "", None, 4)]
    df = _chunks(spark, rows)
    plan = lambda s: session_texts(s, watermark="20 seconds")
    src, sink = scratch(spark, "end-src"), scratch(spark, "end-sink")
    got = _stream(spark, df, src, sink, plan, ["step = 0"])
    assert got.count() == 0
    got = _stream(spark, df, src, sink, plan, ["step = 1"])
    assert [(r.id, r.text, r.n_chunks) for r in assembled(got).collect()] == [(1, "abc", 4)]
    got = _stream(spark, df, src, sink, plan, ["step = 2", "step = 3", "step = 4"])
    assert {(r.id, r.text) for r in assembled(got).collect()} == {(1, "abc"), (2, "open!")}
    assert [tuple(r) for r in late_chunks(got).collect()] == [(1, 4, "late")]


def test_sessions_of_one_group_keep_their_own_deadlines(spark):
    """One Python call takes many sessions: each closes, stays known and is forgotten as if it were alone."""
    t = "2024-01-01 00:0"
    rows = [(i, 0, f"{t}0:0{i}", f"a{i}", None, 0) for i in range(1, 5)]
    rows += [(1, 1, f"{t}0:05", "", "stop", 0), (3, 1, f"{t}0:30", "b3", None, 0),
             (8, 0, f"{t}0:55", "x", None, 1),                                 # watermark 00:35: 2 and 4 fall silent
             (3, 2, f"{t}0:56", "c3", None, 2), (2, 1, f"{t}0:57", "late", None, 2), (1, 2, f"{t}0:58", "late", None, 2),
             (9, 0, f"{t}5:00", "", None, 3), (9, 1, f"{t}5:01", "", None, 4)]
    df = _chunks(spark, rows)
    got = {}
    for groups in (1, 1000):
        src, sink = scratch(spark, "group-src"), scratch(spark, "group-sink")
        plan = lambda s: session_texts(s, watermark="20 seconds", groups=groups)
        out = _stream(spark, df, src, sink, plan, [f"step = {i}" for i in range(5)])
        got[groups] = sorted(map(tuple, out.drop("ts", "session_start").collect()))
        assert {(r.id, r.text, r.n_chunks) for r in assembled(out).where("id < 8").collect()} == {
            (1, "a1", 2), (2, "a2", 1), (3, "a3b3c3", 3), (4, "a4", 1)}
        assert sorted(tuple(r) for r in late_chunks(out).collect()) == [(1, 2, "late"), (2, 1, "late")]
    assert got[1] == got[1000]


def test_any_chunking_gives_the_events_of_the_whole_text():
    rng = random.Random(4)
    bits = [*SPECIAL_TOKENS[4:12], "a", "<", "<|", "|>", "{}", "\n", "<|tool_call_", ""]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        s = new_session()
        whole = list(feed(s, text, final=True))
        s, got, at = new_session(), [], 0
        while at < len(text):
            n = rng.randint(1, 9)
            got += feed(s, text[at:at + n])
            at += n
        got += feed(s, "", final=True)
        assert sorted(got) == sorted(whole)
        spans = re.findall(r"(?s)<\|tool_call_start\|>(.*?)<\|tool_call_end\|>", text)
        assert [c for p, _, _, c in whole if p == 1] == spans


def test_first_reply_wins_and_broken_lines_drop(spark):
    t = "2024-01-01 00:00:"
    req = spark.createDataFrame([(1, 1, "a", f"{t}00"), (1, 2, "b", f"{t}00"), (1, 3, "c", f"{t}01"), (2, 1, "d", f"{t}02")],
                                "conn_id long, id long, method string, req_ts string").withColumn("req_ts", F.to_timestamp("req_ts"))
    lines = [(1, f"{t}03", '{"id": 1, "result": {"n": 3}}'), (1, f"{t}02", ' {"id": 1, "result": {"n": 2}} '), (1, f"{t}12", '{"id": 2}'),
             (1, f"{t}05", '{"id": 3}'), (2, f"{t}05", '{"id": 1, "resu'), (2, f"{t}05", "[1]"), (2, f"{t}05", ""), (2, f"{t}05", '{"id": "1"}'),
             (2, f"{t}05", '{"method": "ping"}'), (2, f"{t}05", '{"id": 77, "result": 1}'), (2, f"{t}05", None)]
    raw = spark.createDataFrame(lines, "conn_id long, resp_ts string, line string").withColumn("resp_ts", F.to_timestamp("resp_ts"))
    batch = sorted(map(tuple, rpc_correlate(req, rpc_replies(raw)).collect()))
    assert batch == [(1, 1, "a", "ok", '{"n":2}', 2), (1, 2, "b", "timeout", None, None), (1, 3, "c", "ok", "{}", 4),
                     (2, 1, "d", "timeout", None, None)]
    far = "2030-01-01 00:00:00"
    rs, qs, sink = scratch(spark, "rpc-r"), scratch(spark, "rpc-q"), scratch(spark, "rpc-s")
    stage(req, qs)
    stage(raw, rs)
    for _ in range(2):
        _run(stream_rpc_correlate(spark.readStream.schema(req.schema).parquet(qs), rpc_replies(spark.readStream.schema(raw.schema).parquet(rs))), sink)
        stage(req.limit(1).selectExpr("-1L AS conn_id", "-1L AS id", "'' AS method", f"TIMESTAMP '{far}' AS req_ts"), qs)
        stage(raw.limit(1).selectExpr("-2L AS conn_id", f"TIMESTAMP '{far}' AS resp_ts", "'{\"id\": -2}' AS line"), rs)
    _run(stream_rpc_correlate(spark.readStream.schema(req.schema).parquet(qs), rpc_replies(spark.readStream.schema(raw.schema).parquet(rs))), sink)
    assert sorted(map(tuple, spark.read.parquet(sink).where("conn_id > 0").collect())) == batch


def test_staging_by_time_uses_many_files_and_loses_no_row(spark, sf):
    o = fx.outputs(spark, sf).select("out_id", "ts").union(spark.createDataFrame([(-7, None)], "out_id long, ts timestamp_ntz"))
    src = scratch(spark, "ranges")
    files = stage_by_time(o, src, "ts", ranges=3)
    back = spark.read.parquet(src)
    assert sorted(r.out_id for r in back.collect()) == sorted(r.out_id for r in o.collect())
    assert len(back.inputFiles()) >= 2 * files


def test_results_follow_their_calls(spark):
    t = '<|tool_call_start|>{"name": "x"}<|tool_call_end|>ok<|tool_call_start|>broken<|tool_call_end|><|tool_call_start|>{"name": "y"}<|tool_call_end|>'
    df = spark.createDataFrame([(1, t), (2, "none")], "out_id long, text string")
    res = spark.createDataFrame([(1, 0, "r0"), (1, 1, "r1"), (1, 2, "r2"), (1, 9, "r9"), (2, 0, "z"), (1, 0, "r0b")], "out_id long, pos int, result string")
    rows = segment_events(df, results=res).orderBy("out_id", "phase", "seq", "type").collect()
    assert [(r.out_id, r.phase, r.seq, r.type, r.content, r.tool_name) for r in rows] == [
        (1, 0, 4, "text", "ok", None), (1, 1, 0, "tool_call", None, "x"), (1, 1, 0, "tool_result", "r0", "x"),
        (1, 1, 2, "tool_call", None, "y"), (1, 1, 2, "tool_result", "r2", "y"), (2, 0, 0, "text", "none", None)]
