"""Event segmentation of a model turn: thoughts, text, tool calls and their results.

The reference runs a mode machine over streamed token chunks.  Over a table the
same contract is computed on the whole text, row by row: a sentinel is put around each of
the reserved markers, the text is split on it, and a fold over the pieces carries the mode of the
last mode marker.  Pieces inside a call are withheld; the calls
themselves are emitted after all text of the turn, in call order, each followed by its result.

Contract (documented deviation): events are marker-aligned pieces rather than
token chunks; text after the call-end marker is kept (the reference drops it
when it arrives in the same chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.markers import ANY_MARKER, CALL_END, CALL_START, IM_END, IM_START, THOUGHT_END, THOUGHT_START
from tracelake.operators.extract import extract_tool_calls, kept_calls

SENTINEL = "\u0001"


def segment_array(text) -> F.Column:
    """``array<struct<seq, type, content>>`` of the text/thought events of a text."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_replace(t, F.lit(ANY_MARKER), F.lit(SENTINEL + "$1" + SENTINEL)), SENTINEL, -1)
    ev_type = "array<struct<seq: int, type: string, content: string>>"
    init = F.struct(F.lit("text").alias("mode"), F.array().cast(ev_type).alias("evs"), F.lit(0).alias("i"))

    def step(acc, p):
        mm = (F.when(p == THOUGHT_START, "thought").when(p == THOUGHT_END, "text")
              .when(p == CALL_START, "call").when(p == CALL_END, "text"))
        mode = acc["mode"]
        skip = (mm.isNotNull() | (p == "") | (mode == "call") | ((mode == "text") & p.isin(IM_START, IM_END)))
        evs = F.when(skip, acc["evs"]).otherwise(F.concat(acc["evs"], F.array(
            F.struct(acc["i"].alias("seq"), mode.alias("type"), p.alias("content")))))
        return F.struct(F.coalesce(mm, mode).alias("mode"), evs.alias("evs"), (acc["i"] + 1).alias("i"))
    return F.aggregate(parts, init, step, lambda acc: acc["evs"])


def event_array(text) -> F.Column:
    """All events of a text as ``array<struct<phase, seq, type, content, tool_name, arguments>>``:
    text/thought pieces (phase 0) then the calls (phase 1) -- one row-local column."""
    evs = F.transform(segment_array(text), lambda e: F.struct(
        F.lit(0).alias("phase"), e["seq"].alias("seq"), e["type"].alias("type"), e["content"].alias("content"),
        F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("arguments")))
    calls = F.transform(kept_calls(text), lambda c: F.struct(
        F.lit(1).alias("phase"), c["pos"].alias("seq"), F.lit("tool_call").alias("type"),
        F.lit(None).cast("string").alias("content"), c["name"].alias("tool_name"), c["arguments"].alias("arguments")))
    return F.concat(evs, calls)


def segment_events(df: DataFrame, text: str = "text", key: str = "out_id", results: DataFrame | None = None) -> DataFrame:
    """``key, phase, seq, type, content, tool_name, arguments``; order by (phase, seq, type).

    Without ``results`` everything is row-local, no shuffle.  ``results(key, pos, result)`` are the tool results of a
    turn by the place of their call: each kept call is followed by a ``tool_result`` event of the same place with the
    call's name (of several results for a call the smallest; results without a call drop out).  Only calls and
    results are shuffled, by (key, pos); the text part stays in its row.
    """
    if results is None:
        return df.select(key, F.inline(event_array(text)))
    texts = df.select(key, F.inline(event_array(text))).where(F.col("phase") == 0)
    one = results.groupBy(key, "pos").agg(F.min("result").alias("result"))
    calls = extract_tool_calls(df, text, (key,)).select(key, "pos", "name", "arguments").join(one, [key, "pos"], "left")
    none = F.lit(None).cast("string")
    call = F.struct(F.lit("tool_call").alias("type"), none.alias("content"), F.col("name").alias("tool_name"), F.col("arguments"))
    result = F.struct(F.lit("tool_result").alias("type"), F.col("result").alias("content"), F.col("name").alias("tool_name"),
                      none.alias("arguments"))
    pair = F.when(F.col("result").isNull(), F.array(call)).otherwise(F.array(call, result))
    calls = calls.select(key, F.lit(1).alias("phase"), F.col("pos").alias("seq"), pair.alias("_e")).select(
        key, "phase", "seq", F.inline("_e"))
    return texts.unionByName(calls)
