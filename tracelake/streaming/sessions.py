"""Completion chunks as keyed state: ordered, once each, closed by the end chunk or by silence.

Chunks are rows ``(id, chunk_seq, ts, content, finish_reason)``; ``finish_reason`` (may be absent) is set on the end
chunk.  Per id the state holds the next place, chunks that came before their turn, and the segmentation of what is
in order so far, bounded by the id's own text; of a closed id only what tells late chunks.  Python is called once for each
of ``groups`` hash groups of ids that a batch touches, since a call costs milliseconds and a session microseconds; a
group's state is one JSON string with a deadline for each id.  ``groups`` must stay the same over restarts of a stream;
it should be a small part of the ids open at a time and a multiple of the shuffle partitions.

* A repeated chunk (same place) counts once.
* The session closes when all chunks up to the end chunk are there, or, without one, when the watermark passes
  ``idle`` seconds after its last chunk (missing places are skipped then).
* A closed id stays known until the watermark passes ``remember`` seconds after its last chunk.  Chunks of
  new places in that time come out as ``late`` rows for a side sink; chunks behind the watermark are dropped by Spark.

Events leave as soon as they are final: a text or thought piece with the marker behind it, a call with its
end marker.  A marker cut between two chunks is put together by the state.  ``applyInPandasWithState``
needs no state server and no callback, so no port is opened.  Event times must be before 2262 (pandas).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tracelake.functions.markers import (ANY_MARKER, CALL_END, CALL_START, IM_END, IM_START, SPECIAL_TOKENS, THOUGHT_END,
                                         THOUGHT_START)
from tracelake.operators.extract import kept_calls

_MARKER = re.compile(ANY_MARKER)
_MODES = {THOUGHT_START: "thought", THOUGHT_END: "text", CALL_START: "call", CALL_END: "text"}
_PREFIXES = {t[:n] for t in SPECIAL_TOKENS for n in range(1, len(t))}
_LONGEST = max(map(len, SPECIAL_TOKENS)) - 1


def new_session() -> dict:
    return {"next": 0, "early": {}, "end": None, "n": 0, "first": None, "last": None, "closed": False,
            "tail": "", "mode": "text", "piece": [], "i": 0, "span": None, "pos": 0}


def _flush(s: dict) -> Iterator[tuple]:
    piece, s["piece"] = "".join(s["piece"]), []
    if piece and s["mode"] != "call":
        yield 0, s["i"], s["mode"], piece
    s["i"] += 1


def feed(s: dict, text: str, final: bool = False) -> Iterator[tuple]:
    """``(phase, seq, type, content)`` of what became final; calls carry their raw body (type ``call``)."""
    data = s["tail"] + text
    s["tail"] = ""
    if not final:  # what may be the beginning of a marker waits
        for n in range(min(_LONGEST, len(data)), 0, -1):
            if data[-n:] in _PREFIXES:
                data, s["tail"] = data[:-n], data[-n:]
                break
    for k, part in enumerate(_MARKER.split(data)):
        if k % 2 == 0:
            if part:
                s["piece"].append(part)
                if s["span"] is not None:
                    s["span"].append(part)
            continue
        yield from _flush(s)
        if part in _MODES:
            s["mode"], place = _MODES[part], None
        else:
            place = s["i"]
            if s["mode"] != "call" and not (s["mode"] == "text" and part in (IM_START, IM_END)):
                yield 0, place, s["mode"], part
        s["i"] += 1
        if s["span"] is None:
            s["span"] = [] if part == CALL_START else None
        elif part == CALL_END:
            yield 1, s["pos"], "call", "".join(s["span"])
            s["span"], s["pos"] = None, s["pos"] + 1
        else:
            s["span"].append(part)
    if final:
        yield from _flush(s)


def collect(s: dict, text: str, final: bool = False) -> Iterator[tuple]:
    """In place of ``feed``: the whole text when the session closes."""
    s.setdefault("text", []).append(text)
    if final:
        yield 3, s["n"], "closed", "".join(s.pop("text"))


def advance(s: dict, chunks: list[tuple[int, str, int, bool]], close: bool = False, take=feed) -> Iterator[tuple]:
    """Take chunks ``(place, content, time, is_end)`` in any order; ``close`` ends the session with what is there."""
    for place, content, at, is_end in chunks:
        if s["closed"]:
            if place >= s["next"]:
                yield 2, place, "late", content
            continue
        s["first"] = at if s["first"] is None else min(s["first"], at)
        s["last"] = at if s["last"] is None else max(s["last"], at)
        if is_end:
            s["end"] = place if s["end"] is None else min(s["end"], place)
        if place >= s["next"]:
            s["early"].setdefault(str(place), content)
    if s["closed"]:
        return
    ready = []  # feeding them at once gives the same events as one by one
    while str(s["next"]) in s["early"] and (s["end"] is None or s["next"] <= s["end"]):
        ready.append(s["early"].pop(str(s["next"])))
        s["next"] += 1
    done = s["end"] is not None and s["next"] > s["end"]
    if close and not done:
        for place in sorted(map(int, s["early"])):
            ready.append(s["early"].pop(str(place)))
            s["next"] = place + 1
    if ready:
        s["n"] += len(ready)
        yield from take(s, "".join(ready))
    if close or done:
        yield from take(s, "", final=True)
        for place in sorted(map(int, s["early"])):  # behind the end chunk
            yield 2, place, "late", s["early"][str(place)]
        s.update(closed=True, early={}, piece=[], span=None)


_OUT = "id long, phase int, seq int, type string, content string, at long, n_chunks int, first long"


_KEPT = ("next", "n", "first", "last", "due")  # of a closed session


def _run(chunks: DataFrame, key: str, idle: int, remember: int, watermark: str, take, groups: int) -> DataFrame:
    def step(_, frames, state):
        import pandas as pd

        opened, closed = json.loads(state.get[0]) if state.exists else ({}, {})
        now = state.getCurrentWatermarkMs()
        out = []

        def move(k: str, chunks: list[tuple], close: bool = False) -> None:
            was_closed = k in closed
            s = {**dict(zip(_KEPT, closed[k])), "closed": True} if was_closed else opened.pop(k, None) or new_session()
            rows = list(advance(s, chunks, close=close, take=take))
            if s["closed"] and not was_closed and take is feed:
                rows.append((3, s["n"], "closed", None))
            s["due"] = max(s["last"] // 1000 + (remember if s["closed"] else idle) * 1000, now + 1)
            if s["closed"]:
                closed[k] = [s[x] for x in _KEPT]
            else:
                opened[k] = s
            out.extend((int(k), *r, s["last"], s["n"], s["first"]) for r in rows)

        over = [[k for k, s in opened.items() if s["due"] < now], [k for k, s in closed.items() if s[-1] < now]]
        arrived = []
        if not state.hasTimedOut:
            for f in frames:
                arrived += zip(f["id"].tolist(), f["chunk_seq"].tolist(), f["content"].fillna("").tolist(), f["at"].tolist(),
                               f["is_end"].tolist())
        arrived.sort()
        here = set()
        for k, own in groupby(arrived, itemgetter(0)):
            here.add(str(k))
            move(str(k), [c[1:] for c in own])
        for k in over[0]:
            if k not in here:
                move(k, [], close=True)
        for k in over[1]:
            if k not in here:
                del closed[k]
        if opened or closed:
            state.update((json.dumps([opened, closed], separators=(",", ":")),))
            due = min([s["due"] for s in opened.values()] + [s[-1] for s in closed.values()])
            state.setTimeoutTimestamp(max(due, now + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["id", "phase", "seq", "type", "content", "at", "n_chunks", "first"])

    is_end = F.col("finish_reason").isNotNull() if "finish_reason" in chunks.columns else F.lit(False)
    c = chunks.where(F.col("chunk_seq").isNotNull() & F.col("ts").isNotNull() & F.col(key).isNotNull())
    c = c.select(F.col(key).cast("long").alias("id"), F.col("chunk_seq").cast("int"), F.col("ts").cast("timestamp"),
                 F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "content", is_end.alias("is_end"))
    g = c.withWatermark("ts", watermark).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("part")
    out = g.applyInPandasWithState(step, _OUT, "session string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("id", "phase", "seq", "type", "content", F.timestamp_micros("at").alias("ts"), "n_chunks",
                      F.timestamp_micros("first").alias("session_start"))


def session_events(chunks: DataFrame, key: str = "id", idle: int = 30, remember: int = 600,
                   watermark: str = "1 minute", groups: int = 1024) -> DataFrame:
    """The stream of ``id, phase, seq, type, content, ...``: text and thought pieces, raw calls, late chunks and one
    ``closed`` row for each session (``seq``: its chunks)."""
    return _run(chunks, key, idle, remember, watermark, feed, groups)


def session_texts(chunks: DataFrame, key: str = "id", idle: int = 30, remember: int = 600,
                  watermark: str = "1 minute", groups: int = 1024) -> DataFrame:
    """Like ``session_events`` with the assembled text in the ``closed`` row and no other events than late chunks."""
    return _run(chunks, key, idle, remember, watermark, collect, groups)


def assembled(texts: DataFrame, key: str = "id") -> DataFrame:
    """``key, text, n_chunks, session_start, session_end`` of the closed sessions of ``session_texts``."""
    return texts.where(F.col("type") == "closed").select(F.col("id").alias(key), F.col("content").alias("text"), "n_chunks",
                                                         "session_start", F.col("ts").alias("session_end"))


def segments(events: DataFrame, key: str = "id") -> DataFrame:
    """``session_events`` in the form of the batch operator ``segment_events``: calls parsed, row by row."""
    body = F.concat(F.lit(CALL_START), F.col("content"), F.lit(CALL_END))
    calls = F.transform(kept_calls(body), lambda c: F.struct(F.lit("tool_call").alias("type"), F.lit(None).cast("string").alias("content"),
                                                             c["name"].alias("tool_name"), c["arguments"].alias("arguments")))
    plain = F.array(F.struct(F.col("type"), F.col("content"), F.lit(None).cast("string").alias("tool_name"),
                             F.lit(None).cast("string").alias("arguments")))
    rows = events.where(F.col("phase") < 2).select(
        F.col("id").alias(key), "phase", "seq", F.when(F.col("type") == "call", calls).otherwise(plain).alias("_e"))
    return rows.select(key, "phase", "seq", F.inline("_e"))


def late_chunks(events: DataFrame) -> DataFrame:
    """The side output: chunks of a closed session (``id, chunk_seq, content``)."""
    return events.where(F.col("type") == "late").select("id", F.col("seq").alias("chunk_seq"), "content")
