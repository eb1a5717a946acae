"""Queries: system-prompt rendering, tool registration and execution (Arrow batches)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.markers import ASSISTANT_HEADER, IM_END, IM_START
from tracelake.operators import extract as X
from tracelake.operators.render import DEFAULT_PREAMBLE, render_system_prompt
from tracelake.operators.udf import ToolRegistry, apply_tools
from tracelake.plans.duck import cte, q
from tracelake.plans.q_extract import CALLS_CTE, KEPT
from tracelake.plans.q_registry import CATALOG_SQL, _values
from tracelake.plans.registry import query
from tracelake.sources import fixtures as fx
from tracelake.sources.catalog import tool_catalog
from tracelake.sources.tables import table

LABEL = "Assistant-Base (245M)"


def _first_user_turns(spark, sf):
    conv = table(spark, sf, "conversations").where("role = 'user'")
    return conv.groupBy("conv_id").agg(F.min_by("text", "turn").alias("user_text")).select(
        "conv_id", F.lit("canonical").alias("registry_id"), F.lit(LABEL).alias("label"), "user_text")


_PRE_A, _PRE_B = DEFAULT_PREAMBLE.split("{label}")
TOOLS_JSON_SQL = ("SELECT registry_id, '[' || string_agg(substr(CAST(json_object('name', name, 'description', description) "
                  "AS VARCHAR), 1, length(CAST(json_object('name', name, 'description', description) AS VARCHAR)) - 1) "
                  "|| ',\"inputSchema\":' || input_schema || '}', ',' ORDER BY seq) || ']' AS tools_json FROM c GROUP BY registry_id")


@query("render_system_prompt", cte(c=CATALOG_SQL, t=TOOLS_JSON_SQL,
                                   u="SELECT conv_id, arg_min(text, turn) AS user_text FROM conversations "
                                     "WHERE role = 'user' GROUP BY conv_id",
                                   s=f"SELECT conv_id, user_text, {q(_PRE_A)} || {q(LABEL)} || {q(_PRE_B)} || t.tools_json "
                                     "AS system_prompt FROM u JOIN t ON t.registry_id = 'canonical'")
       + f"SELECT conv_id, system_prompt, {q(IM_START + 'system')} || chr(10) || system_prompt || {q(IM_END)} || chr(10) "
         f"|| {q(IM_START + 'user')} || chr(10) || user_text || {q(IM_END)} || chr(10) || {q(ASSISTANT_HEADER)} AS prompt FROM s")
def q_render_system_prompt(spark, sf):
    out = render_system_prompt(_first_user_turns(spark, sf), tool_catalog(spark))
    return out.select("conv_id", "system_prompt", "prompt")


# --- example local tools (pure functions, run on executors) -------------------------
REGISTRY = ToolRegistry()


@REGISTRY.tool
def click(k: int) -> int:
    """Double the key.

    Second paragraph is not part of the description."""
    return k * 2


@REGISTRY.tool(name="view")
def view_tool(k: int, scale: float = 0.5) -> float:
    """Scale the key."""
    return k * scale


@REGISTRY.tool("purchase", description="Echo the key as text.")
def purchase(k: int) -> str:
    return f"k={k}"


@REGISTRY.tool
def error(k: int) -> None:
    """Always fails."""
    raise ValueError("tool failed")


SPECS_SQL = _values(REGISTRY.rows(), ["\"group\"", "seq", "name", "description", "input_schema"])


@query("register_tool", cte(**CALLS_CTE, r=SPECS_SQL,
                            n=f"SELECT name, count(*) AS n_calls FROM c WHERE {KEPT} GROUP BY name")
       + "SELECT r.name, r.description, r.input_schema, coalesce(n.n_calls, 0) AS n_calls FROM r "
         "LEFT JOIN n ON r.name = n.name")
def q_register_tool(spark, sf):
    specs = REGISTRY.table(spark).select("name", "description", "input_schema")
    n = X.extract_tool_calls(fx.outputs(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("n_calls"))
    return specs.join(n, "name", "left").select(
        "name", "description", "input_schema", F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


MISSING = "() missing 1 required positional argument: ''k'''"


@query("apply_tools", cte(**CALLS_CTE, k=f"SELECT out_id, pos, name, arguments, "
                                         "CAST(json_extract(arguments, '$.k') AS BIGINT) AS kv FROM c WHERE " + KEPT)
       + f"""SELECT out_id, pos, name,
  CASE WHEN name IN ('click', 'view', 'purchase') AND kv IS NOT NULL THEN 'success' ELSE 'error' END AS status,
  CASE WHEN kv IS NULL THEN NULL WHEN name = 'click' THEN CAST(kv * 2 AS VARCHAR)
       WHEN name = 'view' THEN CAST(kv * 0.5 AS DOUBLE)::VARCHAR WHEN name = 'purchase' THEN '"k=' || kv || '"' END AS result,
  CASE WHEN name NOT IN ('click', 'view', 'purchase', 'error') THEN 'Tool ''' || name || ''' not found.'
       WHEN kv IS NULL THEN CASE name WHEN 'view' THEN 'view_tool' ELSE name END || '{MISSING}
       WHEN name = 'error' THEN 'tool failed' END AS message
FROM k""")
def q_apply_tools(spark, sf):
    calls = X.extract_tool_calls(fx.outputs(spark, sf)).select("out_id", "pos", "name", "arguments")
    return apply_tools(calls, REGISTRY).select("out_id", "pos", "name", "status", "result", "message")
