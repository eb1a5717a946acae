"""Prompt rendering: ChatML transcripts, system prompts with tool lists, tool turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.markers import ASSISTANT_HEADER, IM_END, IM_START, RESULT_END, RESULT_START


def ordered_concat(df: DataFrame, keys: list[str], order: str, part: str, out: str,
                   bucket_rows: int | None = 4096) -> DataFrame:
    """``string_agg(part, '' ORDER BY order)`` per ``keys``, skew-safe.

    With ``bucket_rows`` the concatenation runs in two phases: first per
    ``(keys, order div bucket_rows)`` -- so a conversation holding a third of all
    rows is cut into many small groups spread over many tasks -- then the
    bucket strings are concatenated per key in bucket order.  The final phase
    sorts only ``rows / bucket_rows`` pieces.  ``order`` must be integral.
    """
    def agg(d, ks, o, p):
        return d.groupBy(*ks).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(p).alias("p")))),
                                     lambda x: x["p"]), "").alias(out))
    if not bucket_rows:
        return agg(df, keys, order, part)
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket_rows)).cast("long"))
    first = agg(b, [*keys, "_b"], order, part).withColumnRenamed(out, "_p")
    return agg(first, keys, "_b", "_p")


def chatml_message(role: str = "role", text: str = "text"):
    """``<|im_start|>{role}\\n{content}<|im_end|>\\n``; defaults role ``user``, content ``''``."""
    return F.concat(F.lit(IM_START), F.coalesce(F.col(role), F.lit("user")), F.lit("\n"),
                    F.coalesce(F.col(text), F.lit("")), F.lit(IM_END + "\n"))


def render_chatml(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                  text: str = "text", generation_header: bool = True, bucket_rows: int | None = 4096) -> DataFrame:
    """Messages -> one ChatML prompt per conversation (``key, prompt``).

    Ordered by ``order``; the open assistant header is appended when
    ``generation_header``.  Skew-safe via ``ordered_concat``.
    """
    parts = messages.select(key, order, chatml_message(role, text).alias("_m"))
    out = ordered_concat(parts, [key], order, "_m", "prompt", bucket_rows)
    if generation_header:
        out = out.withColumn("prompt", F.concat("prompt", F.lit(ASSISTANT_HEADER)))
    return out


def tool_json(name: str = "name", description: str = "description", input_schema: str = "input_schema"):
    """One tool as compact JSON: ``{"name":..,"description":..,"inputSchema":<schema text>}``.

    Name/description are JSON-escaped by ``to_json``; the schema text is spliced
    in verbatim, so its key order is kept.
    """
    head = F.to_json(F.struct(F.col(name).alias("name"), F.col(description).alias("description")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1),
                    F.lit(',"inputSchema":'), F.coalesce(F.col(input_schema), F.lit("{}")), F.lit("}"))


def tools_json(registry: DataFrame, group: str = "registry_id", order: str = "seq") -> DataFrame:
    """Registry -> ``group, tools_json`` (JSON array of tools in registry order).

    One row per registry; bounded by the number of registries, not by the data.
    """
    return ordered_concat(registry.select(group, order, F.concat(tool_json(), F.lit(",")).alias("_t")),
                          [group], order, "_t", "_j", bucket_rows=None).select(
        group, F.concat(F.lit("["), F.expr("substring(_j, 1, length(_j) - 1)"), F.lit("]")).alias("tools_json"))


DEFAULT_PREAMBLE = ("You are {label}, an autonomous small language model. "
                    "You have access to local software tools via the Model Context Protocol (MCP):\n")


def render_system_prompt(prompts: DataFrame, registry: DataFrame, group: str = "registry_id",
                         label: str = "label", user_text: str = "user_text",
                         preamble: str = DEFAULT_PREAMBLE) -> DataFrame:
    """System prompt (preamble + the registry's tool list) and the opening ChatML.

    Each prompt row names its registry (``group``).  Adaptive execution picks the join.
    Output adds ``system_prompt`` and ``prompt`` (system + user + assistant header).
    """
    tj = tools_json(registry, group)
    pre_a, pre_b = preamble.split("{label}")
    sys_p = F.concat(F.lit(pre_a), F.col(label), F.lit(pre_b), F.col("tools_json"))
    out = prompts.join(tj, group, "left").withColumn("system_prompt", sys_p)
    return out.withColumn("prompt", F.concat(
        F.lit(IM_START + "system\n"), F.col("system_prompt"), F.lit(IM_END + "\n"),
        F.lit(IM_START + "user\n"), F.col(user_text), F.lit(IM_END + "\n"), F.lit(ASSISTANT_HEADER)))


def render_tool_turn(results: DataFrame, keys=("conv_id", "agent_turn"), order: str = "turn",
                     result_json: str = "result_json") -> DataFrame:
    """Results of one assistant turn -> the ``tool`` message that follows it.

    ``\\n<|im_start|>tool\\n`` + each result wrapped in result markers with a
    newline, in call order + ``<|im_end|>\\n<|im_start|>assistant\\n``.
    """
    parts = results.select(*keys, order, F.concat(F.lit(RESULT_START), F.col(result_json),
                                                  F.lit(RESULT_END + "\n")).alias("_r"))
    out = ordered_concat(parts, list(keys), order, "_r", "_rs", bucket_rows=None)
    return out.select(*keys, F.concat(F.lit("\n" + IM_START + "tool\n"), F.col("_rs"),
                                      F.lit(IM_END + "\n" + ASSISTANT_HEADER)).alias("tool_message"))
