"""Shared DuckDB SQL fragments for the oracle queries.

Fixture SELECTs come from ``tracelake.sources.fixtures`` (one definition for
both engines); constants from ``tracelake.functions.markers``.  DuckDB string
literals take backslashes verbatim, so regex patterns are quoted as they are.
"""

from __future__ import annotations

from tracelake.functions.markers import (ANY_MARKER, CALL_SPAN, FLAT_OBJECT, GREEDY_OBJECT, NAME_RECOVERY,
                                         PY_WHITESPACE, sql_str)
from tracelake.sources import fixtures as fx

#: Python whitespace as a DuckDB expression of chr() calls (built by rule)
WS = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def q(s: str) -> str:
    return sql_str(s)


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"


OUTPUTS = fx.duck_select(fx.OUTPUTS)
TURNS = fx.duck_select(fx.TURNS)
TRAIN_LOG = fx.duck_select(fx.TRAIN_LOG)
CANDIDATES = fx.duck_select(fx.CANDIDATES)
RPC_REQ = fx.duck_select(fx.RPC_REQUESTS)
RPC_RESP = fx.duck_select(fx.RPC_RESPONSES, fx.RPC_RESPONSES_WHERE)
CALL_LOG = fx.duck_select(fx.CALL_LOG)
TOOL_RESULTS = fx.duck_select(fx.TOOL_RESULTS, fx.TOOL_RESULTS_WHERE, fx.TOOL_RESULTS_FROM)
BODIES = fx.duck_select(fx.BODIES)
TOOL_LISTS = fx.duck_select(fx.TOOL_LISTS)
ANSWERS = fx.duck_select(fx.ANSWERS + [fx.OUTPUTS[-1]])


def spans_sql(src: str = "o", pattern: str = CALL_SPAN, group: int = 1, key: str = "out_id",
              where: str | None = None) -> str:
    """``key, pos INT, raw`` -- every regex span, trimmed like Python."""
    w = f" WHERE {where}" if where else ""
    return (f"SELECT {key}, CAST(unnest(range(len(m))) AS INT) AS pos, unnest(m) AS span FROM "
            f"(SELECT {key}, regexp_extract_all(text, {q(pattern)}, {group}) AS m FROM {src}{w})")


def calls_sql(spans: str = "s", key: str = "out_id") -> str:
    """Per span: status / name / arguments with the reference's rules.

    ``jr`` is the text only when valid: DuckDB evaluates JSON functions in every
    CASE branch, so they must never see invalid input.
    """
    return f"""
SELECT {key}, pos, raw, ok,
  CASE WHEN ok AND json_type(jr) = 'OBJECT' THEN 'parsed' WHEN ok THEN 'non_object'
       WHEN rec <> '' THEN 'recovered' ELSE 'unparseable' END AS status,
  CASE WHEN ok AND json_type(jr) = 'OBJECT' THEN coalesce(json_extract_string(jr, '$.name'), '')
       WHEN NOT ok AND rec <> '' THEN rec END AS name,
  CASE WHEN ok AND json_type(jr) = 'OBJECT' THEN coalesce(CAST(json_extract(jr, '$.arguments') AS VARCHAR), '{{}}')
       WHEN NOT ok AND rec <> '' THEN '{{}}' END AS arguments
FROM (SELECT *, CASE WHEN ok THEN raw END AS jr FROM
      (SELECT {key}, pos, {strip('span')} AS raw, json_valid({strip('span')}) AS ok,
              regexp_extract({strip('span')}, {q(NAME_RECOVERY)}, 1) AS rec FROM {spans}))"""


MARKER_SPLIT = (f"string_split(regexp_replace(text, {q(ANY_MARKER)}, chr(1) || '\\1' || chr(1), 'g'), chr(1))")

__all__ = ["WS", "q", "strip", "cte", "spans_sql", "calls_sql", "OUTPUTS", "FLAT_OBJECT", "GREEDY_OBJECT",
           "MARKER_SPLIT"]
