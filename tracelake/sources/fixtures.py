"""Derived input tables (model outputs, RPC logs, metric logs, ...).

The physical test tables hold no markers and no JSON outside ``events.props``,
so the inputs of the tool-calling operators are derived from ``events`` by
plain SQL projections that Spark and DuckDB evaluate identically.  Each fixture
is one list of select expressions, used by Spark (``selectExpr``) and by the
DuckDB oracle (``SELECT ... FROM events``), so both sides read the same rows.
All of them grow linearly with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.tables import table

_CALL = "'<|tool_call_start|>{\"name\": \"' || event_type || '\", \"arguments\": ' || props || '}<|tool_call_end|>'"

#: model outputs of five shapes: thought + call, two calls, malformed call,
#: no markers (flat + nested object), plain text
OUTPUTS = [
    "event_id AS out_id", "user_id AS conv_id", "ts", "event_type",
    "CAST(event_id % 5 AS INT) AS shape",
    "CASE event_id % 5 "
    "WHEN 0 THEN '<|thought_start|>Use ' || event_type || '.<|thought_end|>' || chr(10) || " + _CALL + " || chr(10) || '<|im_end|>' "
    "WHEN 1 THEN " + _CALL + " || chr(10) || '<|tool_call_start|>{\"name\": \"git_status\", \"arguments\": {}}<|tool_call_end|>' || chr(10) || '<|im_end|>' "
    "WHEN 2 THEN '<|tool_call_start|>{\"name\": \"' || event_type || '\", \"arguments\": {\"k\": <|tool_call_end|><|im_end|>' "
    "WHEN 3 THEN 'Result {\"name\": \"' || event_type || '\"} and {\"name\": \"x\", \"arguments\": ' || props || '}<|im_end|>' "
    "ELSE 'No tool is needed for user ' || CAST(user_id AS STRING) || '.<|im_end|>' END AS text",
]

RPC_REQUESTS = ["user_id AS conn_id", "event_id AS id", "event_type AS method", "props AS params", "ts AS req_ts"]
#: 1 in 11 requests get no reply; delays of 0..14 s
RPC_RESPONSES = ["user_id AS conn_id", "event_id AS id", "'{\"ok\": true}' AS result",
                 "ts + CAST(event_id * 37 % 15 AS INT) * INTERVAL '1' SECOND AS resp_ts"]
RPC_RESPONSES_WHERE = "event_id % 11 <> 0"

TRAIN_LOG = ["user_id AS run_id", "event_id AS step", "ts",
             "CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS loss"]

CANDIDATES = ["user_id AS grp", "event_id AS cand", "round(value, 0) AS score"]

TURNS = ["user_id AS conv_id",
         "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS turn",
         "event_type AS name", "props AS args",
         "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status",
         "event_id % 7 <> 0 AS has_call"]

CALL_LOG = ["event_id AS call_id", "event_type AS tool",
            "CASE event_id % 4 WHEN 0 THEN 'src/file_' || CAST(user_id AS STRING) || '.json' "
            "WHEN 1 THEN '../../outside_' || CAST(user_id AS STRING) || '.txt' "
            "WHEN 2 THEN '../ws2/a.txt' "
            "ELSE 'a/../b/' || CAST(user_id AS STRING) || '.md' END AS path",
            "CASE event_id % 3 WHEN 0 THEN 'git status' WHEN 1 THEN '  docker ps -a' ELSE '' END AS command"]

#: tool results by the place of their call: two places an output, so that some have no call; 1 in 7 is missing
TOOL_RESULTS_FROM = "(SELECT event_id, event_type, 0 AS pos FROM events UNION ALL SELECT event_id, event_type, 1 AS pos FROM events) AS e"
TOOL_RESULTS = ["event_id AS out_id", "pos", "'{\"status\": \"' || event_type || '\", \"n\": ' || CAST(event_id % 13 + pos AS STRING) || '}' AS result"]
TOOL_RESULTS_WHERE = "(event_id + pos) % 7 <> 0"

BODIES = ["event_id AS body_id", "ts",
          "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substr(props, 1, 4) WHEN 2 THEN '' "
          "ELSE '[' || props || ']' END AS body"]

#: ``tools/list`` replies, one per event: a tool named after the event type with
#: an integer ``k`` (required, default = the event's k) and an enum ``mode``.
TOOL_LISTS = ["user_id AS conn_id", "event_id AS msg_id",
              "'{\"jsonrpc\": \"2.0\", \"id\": ' || CAST(event_id AS STRING) || ', \"result\": {\"tools\": ["
              "{\"name\": \"' || event_type || '\", \"description\": \"Handle ' || event_type || ' events.\", "
              "\"inputSchema\": {\"type\": \"object\", \"properties\": {"
              "\"k\": {\"type\": \"integer\", \"description\": \"Key.\"}, "
              "\"mode\": {\"type\": \"string\", \"enum\": [\"fast\", \"safe\"], \"default\": \"safe\"}}, "
              "\"required\": [\"k\"]}}, "
              "{\"name\": \"user_' || CAST(user_id AS STRING) || '\"}]}}' AS body"]

#: scripted model answers against event-derived benchmark cases: the case of an
#: event is single / parallel / abstain by ``event_id % 3``; its answer is the
#: event's ``outputs`` text; two models by user parity.
ANSWERS = ["CASE WHEN user_id % 2 = 0 THEN 'model_even' ELSE 'model_odd' END AS model",
           "event_id AS case_id",
           "CASE event_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'parallel' ELSE 'abstain' END AS category",
           "event_type AS exp_name", "props AS exp_args",
           "event_id % 3 <> 2 AS should_call"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def outputs(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*OUTPUTS)


def rpc_requests(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*RPC_REQUESTS)


def rpc_responses(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).where(RPC_RESPONSES_WHERE).selectExpr(*RPC_RESPONSES)


def train_log(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*TRAIN_LOG)


def candidates(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*CANDIDATES)


def turns(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*TURNS)


def call_log(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*CALL_LOG)


def tool_results(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).selectExpr("event_id", "event_type", "explode(array(0, 1)) AS pos")
    return e.where(TOOL_RESULTS_WHERE).selectExpr(*TOOL_RESULTS)


def bodies(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*BODIES)


def tool_lists(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*TOOL_LISTS)


def answers(spark, sf_dir) -> DataFrame:
    """Answers joined with their outputs text (``case_id`` = ``out_id``)."""
    ev = _events(spark, sf_dir)
    return ev.selectExpr(*ANSWERS, OUTPUTS[-1])


def chunks(o: DataFrame, width: int = 16) -> DataFrame:
    """Completion chunks of ``width`` characters from ``o(out_id, ts, text)``."""
    return o.selectExpr("out_id AS id", "ts",
                        f"explode(sequence(0, CAST(floor((length(text)-1)/{width}) AS INT))) AS i",
                        "text").selectExpr(
        "id", "CAST(i AS INT) AS chunk_seq", "ts", f"substr(text, CAST(i AS INT)*{width}+1, {width}) AS content")


def duck_select(cols: list[str], where: str | None = None, frm: str = "events") -> str:
    """The same fixture as DuckDB SQL."""
    sql = "SELECT " + ", ".join(cols) + " FROM " + frm
    return sql + (" WHERE " + where if where else "")
