"""Queries over tool registries, RPC logs and call audits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracelake.operators import audit as A
from tracelake.operators import extract as X
from tracelake.operators import registry as R
from tracelake.operators import rpc as P
from tracelake.operators.render import tool_json
from tracelake.operators.udf import default_tools
from tracelake.plans.duck import (BODIES, CALL_LOG, OUTPUTS, RPC_REQ, RPC_RESP, TOOL_LISTS, calls_sql, cte, q,
                                  spans_sql, strip)
from tracelake.plans.registry import query
from tracelake.sources import fixtures as fx
from tracelake.sources.catalog import CANONICAL_TOOLS, catalog_rows, tool_catalog

# ---- shared inputs -----------------------------------------------------------


def _ingested(spark, sf):
    return R.ingest_tool_lists(fx.tool_lists(spark, sf)).withColumn(
        "seq", F.col("msg_id") * 100 + F.col("pos"))


def _calls(spark, sf):
    return X.extract_tool_calls(fx.outputs(spark, sf))


def _local(spark):
    return default_tools().table(spark)


def _values(rows, cols):
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


LOCAL_SQL = _values(default_tools().rows(), ["\"group\"", "seq", "name", "description", "input_schema"])
CATALOG_SQL = _values(catalog_rows(), ["registry_id", "seq", "name", "description", "input_schema"])

INGEST_SQL = (
    "SELECT conn_id, msg_id, pos, json_extract_string(t, '$.name') AS name, "
    "coalesce(json_extract_string(t, '$.description'), '') AS description, "
    "coalesce(CAST(json_extract(t, '$.inputSchema') AS VARCHAR), '{}') AS input_schema, msg_id * 100 + pos AS seq "
    "FROM (SELECT conn_id, msg_id, CAST(unnest(range(len(ts))) AS INT) AS pos, unnest(ts) AS t FROM "
    "(SELECT conn_id, msg_id, json_extract(body, '$.result.tools[*]') AS ts FROM b WHERE json_valid(body)))")
CALLS = dict(o=OUTPUTS, s=spans_sql(), c=calls_sql(), k="SELECT * FROM c WHERE status IN ('parsed', 'recovered')")


def params_sql(src: str, keys: str) -> str:
    return (f"SELECT {keys}, CAST(unnest(range(len(ks))) AS INT) AS pos, unnest(ks) AS param, input_schema FROM "
            f"(SELECT {keys}, json_keys(input_schema, '$.properties') AS ks, input_schema FROM {src})")


def params_cols(keys: str) -> str:
    spec = "json_extract(input_schema, '$.properties.\"' || param || '\"')"
    return (f"SELECT {keys}, pos, param, json_extract_string({spec}, '$.type') AS type, "
            f"json_extract_string({spec}, '$.description') AS description, "
            f"CAST(json_extract({spec}, '$.enum') AS VARCHAR) AS enum, "
            f"json_extract_string({spec}, '$.default') AS \"default\", "
            f"coalesce(list_contains(json_extract_string(input_schema, '$.required[*]'), param), false) AS required")


# ---- queries -----------------------------------------------------------------

@query("ingest_tool_lists", cte(b=TOOL_LISTS, i=INGEST_SQL)
       + "SELECT conn_id, msg_id, pos, name, description, input_schema FROM i")
def q_ingest_tool_lists(spark, sf):
    return R.ingest_tool_lists(fx.tool_lists(spark, sf))


@query("tool_params", cte(b=TOOL_LISTS, i=INGEST_SQL, p=params_sql("i", "conn_id, msg_id, name"))
       + params_cols("conn_id, msg_id, name") + " FROM p")
def q_tool_params(spark, sf):
    return R.tool_params(_ingested(spark, sf), keys=("conn_id", "msg_id", "name"))


@query("registry_upsert", cte(b=TOOL_LISTS, i=INGEST_SQL)
       + """SELECT name, min(seq) AS first_seq, arg_max(description, seq) AS description,
  arg_max(input_schema, seq) AS input_schema FROM i GROUP BY name""")
def q_registry_upsert(spark, sf):
    return R.registry_upsert(_ingested(spark, sf))


MERGED_SQL = (f"SELECT 'local' AS provider, CAST(0 AS BIGINT) AS priority, seq, name, description, input_schema "
              f"FROM ({LOCAL_SQL}) WHERE \"group\" IN ('filesystem', 'http', 'sqlite') UNION ALL "
              "SELECT 'conn:' || CAST(conn_id AS VARCHAR), conn_id + 1, seq, name, description, input_schema FROM i")


@query("merge_registries", cte(b=TOOL_LISTS, i=INGEST_SQL, m=MERGED_SQL) + "SELECT * FROM m")
def q_merge_registries(spark, sf):
    conns = _ingested(spark, sf).select("conn_id", "seq", "name", "description", "input_schema")
    return R.merge_registries(_local(spark), conns)


def _merged(spark, sf):
    return q_merge_registries(spark, sf)


@query("resolve_tool", cte(b=TOOL_LISTS, i=INGEST_SQL, m=MERGED_SQL, **CALLS,
                           w="SELECT name AS n, provider FROM (SELECT *, row_number() OVER (PARTITION BY name "
                             "ORDER BY priority, seq) AS rn FROM m) WHERE rn = 1")
       + """SELECT k.out_id, k.pos, k.name, w.provider,
  CASE WHEN w.provider IS NULL THEN 'error' ELSE 'resolved' END AS status,
  CASE WHEN w.provider IS NULL THEN 'Tool ''' || k.name || ''' not found.' END AS message
FROM k LEFT JOIN w ON k.name = w.n""")
def q_resolve_tool(spark, sf):
    calls = _calls(spark, sf).select("out_id", "pos", "name")
    return R.resolve_tool(calls, _merged(spark, sf))


@query("unresolved_calls", cte(b=TOOL_LISTS, i=INGEST_SQL, m=MERGED_SQL, **CALLS)
       + "SELECT out_id, pos, name FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.name = k.name)")
def q_unresolved_calls(spark, sf):
    return R.unresolved_calls(_calls(spark, sf).select("out_id", "pos", "name"), _merged(spark, sf))


OFFERED = ["event_id AS case_id", "event_type AS name"]


@query("offered_tool_calls", cte(**CALLS, f="SELECT event_id AS case_id, event_type AS name FROM events UNION ALL "
                                            "SELECT event_id, 'list_dir' FROM events")
       + "SELECT out_id AS case_id, pos, name FROM k WHERE EXISTS "
         "(SELECT 1 FROM f WHERE f.case_id = k.out_id AND f.name = k.name)")
def q_offered_tool_calls(spark, sf):
    from tracelake.sources.tables import table
    ev = table(spark, sf, "events")
    offered = ev.selectExpr("event_id AS case_id", "event_type AS name").unionByName(
        ev.selectExpr("event_id AS case_id", "'list_dir' AS name"))
    calls = _calls(spark, sf).select(F.col("out_id").alias("case_id"), "pos", "name")
    return R.offered_tool_calls(calls, offered)


UPSERT_SQL = ("SELECT name, min(seq) AS first_seq, arg_max(description, seq) AS description, "
              "arg_max(input_schema, seq) AS input_schema FROM i GROUP BY name")
DUCK_JSON_TYPE = ("CASE json_type(value) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' "
                  "WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' "
                  "WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' END")
ARGS_SQL = ("SELECT out_id, pos, name, param, value, " + DUCK_JSON_TYPE + " AS json_type FROM "
            "(SELECT out_id, pos, name, param, CAST(json_extract(arguments, '$.\"' || param || '\"') AS VARCHAR) AS value "
            "FROM (SELECT out_id, pos, name, arguments, unnest(json_keys(arguments)) AS param FROM k))")


@query("validate_args", cte(b=TOOL_LISTS, i=INGEST_SQL, u=UPSERT_SQL, pp=params_sql("u", "name"),
                            p=params_cols("name") + " FROM pp", **CALLS,
                            kk="SELECT * FROM k WHERE name IN (SELECT name FROM p)",
                            d="SELECT kk.out_id, kk.pos, kk.name, p.param, p.type, p.enum, p.required "
                              "FROM kk JOIN p ON kk.name = p.name",
                            a=ARGS_SQL.replace("FROM k))", "FROM kk))"),
                            j="SELECT coalesce(d.out_id, a.out_id) AS out_id, coalesce(d.pos, a.pos) AS pos, "
                              "coalesce(d.name, a.name) AS name, d.type, d.enum, d.required, a.value, a.json_type "
                              "FROM d FULL OUTER JOIN a ON d.out_id = a.out_id AND d.pos = a.pos AND d.param = a.param")
       + """SELECT out_id, pos, any_value(name) AS name,
  CAST(sum(CASE WHEN required AND value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
  CAST(sum(CASE WHEN required IS NULL AND value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
  CAST(sum(CASE WHEN value IS NOT NULL AND required IS NOT NULL AND NOT (type IS NULL OR type = json_type
       OR (type = 'number' AND json_type = 'integer')) THEN 1 ELSE 0 END) AS BIGINT) AS n_type_errors,
  CAST(sum(CASE WHEN enum IS NOT NULL AND value IS NOT NULL AND NOT list_contains(
       CAST(json_extract_string(enum, '$[*]') AS VARCHAR[]), coalesce(json_extract_string(value, '$'), ''))
       THEN 1 ELSE 0 END) AS BIGINT) AS n_enum_errors
FROM j GROUP BY out_id, pos""")
def q_validate_args(spark, sf):
    params = R.tool_params(R.registry_upsert(_ingested(spark, sf)))
    out = R.validate_args(_calls(spark, sf), params)
    return out.drop("valid")


@query("infer_arg_schema", cte(**CALLS, a=ARGS_SQL,
                               t="SELECT name, count(*) AS tool_calls FROM k GROUP BY name",
                               v="SELECT name, param, value, count(*) AS c FROM a WHERE json_type <> 'null' "
                                 "GROUP BY name, param, value",
                               m="SELECT name, param, value AS \"default\" FROM (SELECT *, row_number() OVER "
                                 "(PARTITION BY name, param ORDER BY c DESC, value) AS rn FROM v) WHERE rn = 1",
                               ty="SELECT name, param, count(*) AS n_calls, list_sort(list_distinct(list(json_type))) AS ts "
                                  "FROM a WHERE json_type <> 'null' GROUP BY name, param")
       + """SELECT ty.name AS tool, ty.param,
  CASE WHEN len(ts) = 1 THEN ts[1] WHEN ts = ['integer', 'number'] THEN 'number' ELSE 'string' END AS type,
  ty.n_calls = t.tool_calls AS required, m."default", ty.n_calls
FROM ty JOIN m ON ty.name = m.name AND ty.param = m.param JOIN t ON ty.name = t.name""")
def q_infer_arg_schema(spark, sf):
    return R.infer_arg_schema(_calls(spark, sf))


def _jstr_sql(e: str) -> str:
    return "'\"' || replace(replace(" + e + ", '\\', '\\\\'), '\"', '\\\"') || '\"'"


@query("compact_schema", cte(b=TOOL_LISTS, i=INGEST_SQL, u=UPSERT_SQL, pp=params_sql("u", "name"),
                             p=params_cols("name") + " FROM pp",
                             a="SELECT name, string_agg(" + _jstr_sql("param") + " || ':{\"type\":' || "
                               + _jstr_sql("coalesce(type, 'string')") + " || ',\"req\":' || "
                               "CASE WHEN required THEN 'true' ELSE 'false' END || '}', ',' ORDER BY pos) AS args "
                               "FROM p GROUP BY name",
                             r="SELECT u.name, u.description, u.input_schema, a.args FROM u LEFT JOIN a ON u.name = a.name",
                             c="SELECT name, '{\"name\":' || " + _jstr_sql("name") + " || ',\"desc\":' || "
                               + _jstr_sql("description") + " || ',\"args\":{' || coalesce(args, '') || '}}' AS compact, "
                               "length(CAST(json_object('name', name, 'description', description) AS VARCHAR)) - 1 "
                               "+ length(',\"inputSchema\":') + length(coalesce(input_schema, '{}')) + 1 AS full_chars FROM r")
       + "SELECT name, compact, full_chars, length(compact) AS compact_chars, "
         "round(full_chars / length(compact), 6) AS ratio FROM c")
def q_compact_schema(spark, sf):
    reg = R.registry_upsert(_ingested(spark, sf))
    return R.compact_schema(reg, R.tool_params(reg))


_TOOLS_FOR_PRESELECT = [(t["name"], t["description"]) for t in CANONICAL_TOOLS] + [
    (r[2], r[3]) for r in default_tools().rows()]


@query("preselect_tools", cte(
    tl=_values(_TOOLS_FOR_PRESELECT, ["name", "description"]),
    pw="SELECT DISTINCT prompt_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS word FROM "
       "(SELECT conv_id * 100 + turn AS prompt_id, text FROM conversations WHERE role = 'user')",
    tw="SELECT DISTINCT name, unnest(regexp_extract_all(lower(replace(name, '_', ' ') || ' ' || description), "
       "'[a-z0-9]+', 0)) AS word FROM tl",
    ov="SELECT prompt_id, name, count(*) AS overlap FROM pw JOIN tw ON pw.word = tw.word GROUP BY prompt_id, name",
    rk="SELECT *, CAST(rank() OVER (PARTITION BY prompt_id ORDER BY overlap DESC) AS INT) AS rank FROM ov")
    + "SELECT * FROM rk WHERE rank <= 3")
def q_preselect_tools(spark, sf):
    from tracelake.sources.tables import table
    prompts = table(spark, sf, "conversations").where("role = 'user'").selectExpr(
        "conv_id * 100 + turn AS prompt_id", "text")
    tools = spark.createDataFrame(_TOOLS_FOR_PRESELECT, "name string, description string")
    return R.preselect_tools(prompts, tools, k=3)


@query("context_budget", cte(b=TOOL_LISTS, i=INGEST_SQL,
                             t="SELECT conn_id, seq, name, CAST(ceil((length(CAST(json_object('name', name, "
                               "'description', description) AS VARCHAR)) - 1 + length(',\"inputSchema\":') "
                               "+ length(input_schema) + 1) / 4.0) AS BIGINT) AS tokens FROM i",
                             r="SELECT *, sum(tokens) OVER (PARTITION BY conn_id ORDER BY seq ROWS BETWEEN UNBOUNDED "
                               "PRECEDING AND CURRENT ROW) AS running_tokens FROM t")
       + "SELECT conn_id, seq, name, tokens, CAST(running_tokens AS BIGINT) AS running_tokens FROM r "
         "WHERE running_tokens <= 2048")
def q_context_budget(spark, sf):
    t = _ingested(spark, sf).select("conn_id", "seq", "name",
                                    F.ceil(F.length(tool_json()) / 4.0).cast("long").alias("tokens"))
    return R.context_budget(t, ctx=2048, keys=("conn_id",), order="seq", tokens="tokens")


@query("rpc_correlate", cte(q=RPC_REQ, r=RPC_RESP,
                            j="SELECT q.conn_id, q.id, q.method, q.req_ts, r.resp_ts, r.result FROM q LEFT JOIN r "
                              "ON q.conn_id = r.conn_id AND q.id = r.id AND r.resp_ts BETWEEN q.req_ts AND "
                              "q.req_ts + INTERVAL 10 SECOND")
       + """SELECT conn_id, id, any_value(method) AS method,
  CASE WHEN min(resp_ts) IS NULL THEN 'timeout' ELSE 'ok' END AS status,
  CASE WHEN min(resp_ts) IS NOT NULL THEN coalesce(arg_min(result, resp_ts), '{}') END AS result,
  date_diff('second', any_value(req_ts), min(resp_ts)) AS latency_s FROM j GROUP BY conn_id, id""")
def q_rpc_correlate(spark, sf):
    return P.rpc_correlate(fx.rpc_requests(spark, sf), fx.rpc_responses(spark, sf), timeout_s=10)


@query("json_dead_letter", cte(b=BODIES)
       + """SELECT body_id, body, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN 200 ELSE 400 END AS status_code,
  CASE WHEN NOT json_valid(body) THEN 'Invalid JSON body' END AS message FROM b""")
def q_json_dead_letter(spark, sf):
    """Bodies arrive in raw requests, some with bytes of the next one behind them."""
    b = fx.bodies(spark, sf).select("body_id", F.expr(
        "concat('POST /v1/chat/completions HTTP/1.1\\r\\nHost: h\\r\\ncontent-length: ', octet_length(body), '\\r\\n\\r\\n', body, "
        "CASE WHEN body_id % 2 = 0 THEN 'GET / HTTP/1.1\\r\\n' ELSE '' END) AS request"))
    return P.json_dead_letter(P.request_bodies(b))


RESOLVE_SQL = ("'/' || array_to_string(list_reduce(string_split(CASE WHEN starts_with(path, '/') THEN path "
               "ELSE '/ws/' || path END, '/'), lambda acc, x: CASE WHEN x = '..' THEN acc[1:len(acc) - 1] "
               "WHEN x = '' OR x = '.' THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]), '/')")


@query("audit_path_escapes", cte(c=CALL_LOG, r=f"SELECT call_id, tool, path, {RESOLVE_SQL} AS resolved FROM c")
       + "SELECT *, NOT (resolved = '/ws' OR starts_with(resolved, '/ws/')) AS escapes, "
         "NOT starts_with(resolved, '/ws') AS prefix_escapes FROM r")
def q_audit_path_escapes(spark, sf):
    return A.audit_path_escapes(fx.call_log(spark, sf).select("call_id", "tool", "path"), root="/ws")


ALLOWED = ["git", "ls"]


@query("audit_commands", cte(c=CALL_LOG, r=f"SELECT call_id, command, CASE WHEN {strip('command')} = '' THEN '' "
                                            f"ELSE string_split_regex({strip('command')}, '\\s+')[1] END AS cmd_root FROM c")
       + "SELECT call_id, command, cmd_root, cmd_root IN ('git', 'ls') AS allowed, CASE WHEN cmd_root NOT IN "
         "('git', 'ls') THEN 'Command ''' || cmd_root || ''' is not in allowed command list.' END AS message FROM r")
def q_audit_commands(spark, sf):
    allowed = spark.createDataFrame([(c,) for c in ALLOWED], "cmd string")
    return A.audit_commands(fx.call_log(spark, sf).select("call_id", "command"), allowed)


__all__ = ["json", "q", "tool_catalog", "R"]
