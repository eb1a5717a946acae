"""Queries over model outputs: extraction, cleaning, segmentation, shaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelake.functions.markers import ASSISTANT_HEADER, CALL_END, CALL_SPAN, IM_END, IM_START
from tracelake.operators import extract as X
from tracelake.operators.render import render_chatml
from tracelake.operators.segment import segment_events
from tracelake.plans.duck import (ANSWERS, FLAT_OBJECT, GREEDY_OBJECT, MARKER_SPLIT, OUTPUTS, TOOL_RESULTS, calls_sql, cte, q,
                                  spans_sql, strip)
from tracelake.plans.registry import query
from tracelake.sources import fixtures as fx
from tracelake.sources.tables import table

EMPTY = "''"
CALLS_CTE = dict(o=OUTPUTS, s=spans_sql(), c=calls_sql())
KEPT = "c.status IN ('parsed', 'recovered')"


@query("extract_tool_calls", cte(**CALLS_CTE) + f"""
SELECT out_id, pos, name, arguments, raw, status = 'parsed' AS parse_ok FROM c WHERE {KEPT}""")
def q_extract_tool_calls(spark, sf):
    return X.extract_tool_calls(fx.outputs(spark, sf))


@query("recover_malformed_calls", cte(**CALLS_CTE) + """
SELECT out_id, pos, raw, status, CASE WHEN status = 'recovered' THEN name END AS recovered_name,
       status = 'recovered' AS kept FROM c WHERE status <> 'parsed'""")
def q_recover_malformed_calls(spark, sf):
    return X.recover_malformed_calls(fx.outputs(spark, sf))


@query("raw_json_fallback", cte(o=OUTPUTS, s=spans_sql(pattern=FLAT_OBJECT, group=0,
                                                        where=f"len(regexp_extract_all(text, {q(CALL_SPAN)}, 1)) = 0"))
       + f"SELECT out_id, pos, {strip('span')} AS raw, json_valid({strip('span')}) AS parse_ok FROM s")
def q_raw_json_fallback(spark, sf):
    return X.raw_json_fallback(fx.outputs(spark, sf))


_GREEDY = f"CASE WHEN regexp_extract(text, {q(GREEDY_OBJECT)}, 0) <> '' THEN regexp_extract(text, {q(GREEDY_OBJECT)}, 0) ELSE {strip('text')} END"


@query("extract_json_object", cte(o=OUTPUTS, j=f"SELECT out_id, {_GREEDY} AS json_text FROM o")
       + "SELECT out_id, json_text, json_valid(json_text) AS parse_ok FROM j")
def q_extract_json_object(spark, sf):
    return X.extract_json_object(fx.outputs(spark, sf))


STRUCTURED = StructType([StructField("name", StringType()),
                         StructField("arguments", StructType([StructField("k", LongType())]))])


@query("parse_structured", cte(o=OUTPUTS, j=f"SELECT out_id, {_GREEDY} AS j FROM o",
                               u="SELECT out_id, CASE WHEN json_valid(j) THEN j END AS j FROM j",
                               v="SELECT out_id, j, coalesce(json_type(j) = 'OBJECT' "
                                 "AND json_extract(j, '$.name') IS NOT NULL, false) AS valid FROM u")
       + """SELECT out_id, CASE WHEN valid THEN json_extract_string(j, '$.name') END AS name,
  CASE WHEN valid THEN CAST(json_extract(j, '$.arguments.k') AS BIGINT) END AS k, valid FROM v""")
def q_parse_structured(spark, sf):
    out = X.parse_structured(fx.outputs(spark, sf), STRUCTURED, required=["name"])
    return out.select("out_id", "name", F.col("arguments.k").alias("k"), "valid")


_PROMPT = f"'{IM_START}user' || chr(10) || event_type || '{IM_END}' || chr(10) || '{IM_START}assistant' || chr(10)"


def _generations(spark, sf):
    return fx.outputs(spark, sf).selectExpr("out_id", f"{_PROMPT} AS prompt",
                                            f"{_PROMPT} || text || chr(10) || 'tail after the end' AS full_text")


@query("clean_outputs", cte(o=OUTPUTS, g=f"SELECT out_id, substr({_PROMPT} || text || chr(10) || 'tail after the end', "
                                         f"length({_PROMPT}) + 1) AS c FROM o",
                            k=f"SELECT out_id, c, least(CASE WHEN strpos(c, {q(IM_END)}) > 0 THEN strpos(c, {q(IM_END)}) - 1 + {len(IM_END)} END, "
                              f"CASE WHEN strpos(c, {q(CALL_END)}) > 0 THEN strpos(c, {q(CALL_END)}) - 1 + {len(CALL_END)} END) AS k FROM g",
                            r="SELECT out_id, CASE WHEN k IS NOT NULL THEN substr(c, 1, k) ELSE c END AS completion FROM k")
       + f"SELECT out_id, completion, {strip(f'replace(completion, {q(IM_END)}, {EMPTY})')} AS content FROM r")
def q_clean_outputs(spark, sf):
    return X.clean_outputs(_generations(spark, sf), stop_at_call=True).select("out_id", "completion", "content")


CHATML_MSG = (f"{q(IM_START)} || coalesce(role, 'user') || chr(10) || coalesce(text, '') || {q(IM_END)} || chr(10)")


@query("final_answer", cte(t=f"SELECT conv_id, string_agg({CHATML_MSG}, '' ORDER BY turn) AS transcript "
                             "FROM conversations GROUP BY conv_id")
       + f"SELECT conv_id, {strip(f'replace(string_split(transcript, {q(ASSISTANT_HEADER)})[-1], {q(IM_END)}, {EMPTY})')} AS answer FROM t")
def q_final_answer(spark, sf):
    t = render_chatml(table(spark, sf, "conversations"), generation_header=False)
    return X.final_answer(t, "prompt").select("conv_id", "answer")


#: text, thought and call events of every output (also the oracle of the streaming form)
SEGMENTS = (cte(o=OUTPUTS,
                             p=f"SELECT out_id, CAST(unnest(range(len(parts))) AS INT) AS seq, unnest(parts) AS piece "
                               f"FROM (SELECT out_id, {MARKER_SPLIT} AS parts FROM o)",
                             m="SELECT *, CASE piece WHEN '<|thought_start|>' THEN 'thought' WHEN '<|thought_end|>' THEN 'text' "
                               "WHEN '<|tool_call_start|>' THEN 'call' WHEN '<|tool_call_end|>' THEN 'text' END AS mm FROM p",
                             w="SELECT *, coalesce(last_value(mm IGNORE NULLS) OVER (PARTITION BY out_id ORDER BY seq "
                               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'text') AS mode FROM m",
                             s=spans_sql(), c=calls_sql())
       + f"""SELECT out_id, 0 AS phase, seq, mode AS type, piece AS content, CAST(NULL AS VARCHAR) AS tool_name,
  CAST(NULL AS VARCHAR) AS arguments FROM w
WHERE piece <> '' AND mm IS NULL AND mode <> 'call' AND NOT (mode = 'text' AND piece IN ({q(IM_START)}, {q(IM_END)}))
UNION ALL
SELECT out_id, 1 AS phase, pos AS seq, 'tool_call' AS type, CAST(NULL AS VARCHAR) AS content, name AS tool_name, arguments
FROM c WHERE {KEPT}""")


@query("segment_events", cte(g=SEGMENTS, r=TOOL_RESULTS)
       + """SELECT * FROM g UNION ALL
SELECT g.out_id, 1 AS phase, g.seq, 'tool_result' AS type, r.result AS content, g.tool_name, CAST(NULL AS VARCHAR) AS arguments
FROM g JOIN r ON g.out_id = r.out_id AND g.seq = r.pos WHERE g.type = 'tool_call'""")
def q_segment_events(spark, sf):
    return segment_events(fx.outputs(spark, sf), results=fx.tool_results(spark, sf))


@query("shape_completion", cte(**CALLS_CTE,
                               a="SELECT out_id, count(*) AS n, to_json(list({'id': 'call_' || substr(md5(CAST(out_id AS VARCHAR) || ':' "
                                 "|| CAST(pos AS VARCHAR)), 1, 8), 'type': 'function', 'function': {'name': name, "
                                 f"'arguments': arguments}}}} ORDER BY pos)) AS j FROM c WHERE {KEPT} GROUP BY out_id")
       + f"""SELECT o.out_id, CASE WHEN a.n > 0 THEN 'tool_calls' ELSE 'stop' END AS finish_reason,
  {strip(f"replace(o.text, {q(IM_END)}, '')")} AS content, coalesce(a.n, 0) AS n_calls, coalesce(a.j, '[]') AS tool_calls
FROM o LEFT JOIN a ON o.out_id = a.out_id""")
def q_shape_completion(spark, sf):
    out = X.shape_completion(fx.outputs(spark, sf))
    return out.select("out_id", "finish_reason", "content", F.size("tool_calls").alias("n_calls"),
                      F.to_json("tool_calls").alias("tool_calls"))


@query("calls_per_turn", cte(**CALLS_CTE, a=f"SELECT out_id, count(*) AS n FROM c WHERE {KEPT} GROUP BY out_id")
       + """SELECT o.out_id, CAST(coalesce(a.n, 0) AS INT) AS n_calls, coalesce(a.n, 0) > 1 AS parallel
FROM o LEFT JOIN a ON o.out_id = a.out_id""")
def q_calls_per_turn(spark, sf):
    return X.calls_per_turn(fx.outputs(spark, sf))


@query("tool_call_counts", cte(**CALLS_CTE, k=f"SELECT * FROM c WHERE {KEPT}",
                               n="SELECT out_id, count(*) AS n FROM k GROUP BY out_id")
       + """SELECT k.name, count(*) AS n_calls, sum(CASE WHEN k.status = 'recovered' THEN 1 ELSE 0 END) AS n_recovered,
  sum(CASE WHEN n.n > 1 THEN 1 ELSE 0 END) AS n_in_parallel_turns FROM k JOIN n ON k.out_id = n.out_id GROUP BY k.name""")
def q_tool_call_counts(spark, sf):
    return X.tool_call_counts(fx.outputs(spark, sf))


_GRAMMAR_SQL = ", ".join(
    f"CAST((length(text) - length(replace(text, {q(m)}, ''))) // {len(m)} AS INT) AS {c}"
    for m, c in X.GRAMMAR_COLUMNS.items())


@query("grammar_check", cte(o=OUTPUTS, g=f"SELECT out_id, {_GRAMMAR_SQL} FROM o")
       + """SELECT *, n_thought_start = n_thought_end AND n_call_start = n_call_end
  AND n_result_start = n_result_end AS balanced FROM g""")
def q_grammar_check(spark, sf):
    return X.grammar_check(fx.outputs(spark, sf))


@query("usage_counts", """
SELECT conv_id,
  CAST(sum(CASE WHEN role <> 'assistant' THEN len(regexp_extract_all(text, '\\S+', 0)) ELSE 0 END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\\S+', 0)) ELSE 0 END) AS BIGINT) AS completion_tokens,
  CAST(sum(len(regexp_extract_all(text, '\\S+', 0))) AS BIGINT) AS total_tokens
FROM conversations GROUP BY conv_id""")
def q_usage_counts(spark, sf):
    conv = table(spark, sf, "conversations")
    is_a = F.col("role") == "assistant"
    per = conv.select("conv_id", F.when(is_a, F.lit("")).otherwise(F.col("text")).alias("prompt"),
                      F.when(is_a, F.col("text")).otherwise(F.lit("")).alias("completion"))
    per = X.usage_counts(per)
    return per.groupBy("conv_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"),
                                      F.sum("completion_tokens").alias("completion_tokens"),
                                      F.sum("total_tokens").alias("total_tokens"))


@query("render_chatml", f"""SELECT conv_id, string_agg({CHATML_MSG}, '' ORDER BY turn) || {q(ASSISTANT_HEADER)} AS prompt
FROM conversations GROUP BY conv_id""")
def q_render_chatml(spark, sf):
    return render_chatml(table(spark, sf, "conversations"))


__all__ = ["ANSWERS"]
