"""Extraction over tables of model outputs: tool calls, JSON objects, answers.

All operators here are row-local: the calls of an output live in the same row as
its text, so they are computed with higher-order functions over the span array
(``transform`` / ``filter``) -- no shuffle, whole-stage codegen around them, and
the work grows linearly with the text.  ``explode`` happens only when a call per
row is the wanted output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.functions.columns import col, count_literal, py_strip
from tracelake.functions.jsonx import is_object, strict_valid, wrap, wrapped_ok, wrapped_value
from tracelake.functions.markers import (ASSISTANT_HEADER, CALL_END, CALL_SPAN, CALL_START, FLAT_OBJECT,
                                         GREEDY_OBJECT, IM_END, IM_START, NAME_RECOVERY, NON_WS, SPECIAL_TOKENS)

#: span status values
PARSED, RECOVERED, UNPARSEABLE, NON_OBJECT = "parsed", "recovered", "unparseable", "non_object"


def call_spans(text, fallback: bool = False) -> Column:
    """Bodies between call markers (non-greedy, dot-all), in order.

    ``fallback``: when a text has no marker span, take the non-greedy flat
    objects ``{...}`` instead (it stops at the first ``}``, so nested arguments
    yield broken JSON -- kept on purpose, it is the scorer's rule).
    """
    t = col(text)
    spans = F.regexp_extract_all(t, F.lit(CALL_SPAN), F.lit(1))
    if fallback:
        spans = F.when(F.size(spans) > 0, spans).otherwise(F.regexp_extract_all(t, F.lit(FLAT_OBJECT), F.lit(0)))
    return spans


def call_array(text, fallback: bool = False) -> Column:
    """``array<struct<pos, raw, status, name, arguments>>`` for every span.

    Per span: trimmed like Python ``strip``; parsed strictly once; an object
    gives ``name`` (default ``''``) and canonical ``arguments`` JSON (default
    ``{}``); an unparseable body falls back to the ``"name": "..."`` regex with
    arguments ``{}``; bodies with neither, and parsed non-objects, are marked
    ``unparseable`` / ``non_object`` (callers drop them).
    """
    # each stage materialises its values as struct fields: lambdas share no subexpressions
    parsed = F.transform(call_spans(text, fallback),
                         lambda s, i: F.struct(i.alias("pos"), py_strip(s).alias("raw")))
    parsed = F.transform(parsed, lambda x: F.struct(x["pos"].alias("pos"), x["raw"].alias("raw"),
                                                    *[c.alias(n) for c, n in zip(wrap(x["raw"]), ("w", "h"))]))
    parsed = F.transform(parsed, lambda x: F.struct(x["pos"].alias("pos"), x["raw"].alias("raw"),
                                                    wrapped_value(x["w"], x["h"]).alias("v")))

    def one(x):
        v = x["v"]
        rec = F.regexp_extract(x["raw"], NAME_RECOVERY, 1)
        status = (F.when(v.isNull() & (rec != ""), F.lit(RECOVERED))
                  .when(v.isNull(), F.lit(UNPARSEABLE))
                  .when(is_object(v), F.lit(PARSED))
                  .otherwise(F.lit(NON_OBJECT)))
        name = (F.when(v.isNull(), F.when(rec != "", rec))
                .otherwise(F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit(""))))
        args = F.when(v.isNull() & (rec != ""), F.lit("{}")).when(
            v.isNotNull(), F.coalesce(F.to_json(F.try_variant_get(v, "$.arguments", "variant")), F.lit("{}")))
        return F.struct(x["pos"].alias("pos"), x["raw"].alias("raw"), status.alias("status"),
                        name.alias("name"), args.alias("arguments"))

    return F.transform(parsed, one)


def kept_calls(text, fallback: bool = False) -> Column:
    """The reference's call list: parsed objects and recovered names, in order."""
    return F.filter(call_array(text, fallback), lambda c: c["status"].isin(PARSED, RECOVERED))


def extract_tool_calls(df: DataFrame, text: str = "text", keys=("out_id",), with_dropped: bool = False) -> DataFrame:
    """One row per call: ``keys..., pos, name, arguments, raw, parse_ok``.

    A cheap ``contains`` guard skips the regex for texts without a call marker.
    ``with_dropped`` keeps unrecoverable / non-object spans with their status.
    """
    arr = call_array(text) if with_dropped else kept_calls(text)
    out = (df.where(F.col(text).contains(CALL_START))
           .select(*keys, F.inline(arr))
           .withColumn("parse_ok", F.col("status") == PARSED))
    cols = [*keys, "pos", "name", "arguments", "raw", "parse_ok"]
    return out.select(*cols, "status") if with_dropped else out.select(*cols)


def recover_malformed_calls(df: DataFrame, text: str = "text", keys=("out_id",)) -> DataFrame:
    """Spans whose JSON failed: recovered name, or dropped (``kept = false``).

    Parsed non-objects (``[1]``) raise in the reference; here they are dropped
    and reported with status ``non_object``.
    """
    return (extract_tool_calls(df, text, keys, with_dropped=True)
            .where(F.col("status") != PARSED)
            .select(*keys, "pos", "raw", "status",
                    F.when(F.col("status") == RECOVERED, F.col("name")).alias("recovered_name"),
                    F.col("status").eqNullSafe(RECOVERED).alias("kept")))


def raw_json_fallback(df: DataFrame, text: str = "text", keys=("out_id",)) -> DataFrame:
    """Outputs without any call span: non-greedy ``{...}`` candidates, parsed or not."""
    spans = F.regexp_extract_all(F.col(text), F.lit(FLAT_OBJECT), F.lit(0))
    return (df.where(~F.col(text).contains(CALL_START) | (F.size(call_spans(text)) == 0))
            .select(*keys, F.posexplode(spans).alias("pos", "candidate"))
            .withColumn("raw", py_strip("candidate"))
            .select(*keys, "pos", "raw", strict_valid("raw").alias("parse_ok")))


def json_object_text(text) -> Column:
    """Greedy dot-all ``{...}`` (first ``{`` to last ``}``), else the trimmed text."""
    m = F.regexp_extract(col(text), GREEDY_OBJECT, 0)
    return F.when(m != "", m).otherwise(py_strip(text))


def extract_json_object(df: DataFrame, text: str = "text", keys=("out_id",)) -> DataFrame:
    """``keys, json_text, parse_ok`` -- strict JSON validity (Python rules)."""
    return (df.select(*keys, json_object_text(text).alias("json_text"))
            .withColumn("parse_ok", strict_valid("json_text")))


def parse_structured(df: DataFrame, schema: StructType, required=(), text: str = "text", keys=("out_id",),
                     mode: str = "PERMISSIVE") -> DataFrame:
    """Typed rows from replies: ``keys, <schema fields...>, valid``.

    ``valid`` = strict JSON object, every ``required`` field present and not null, every
    other value of its field's type or null.
    ``mode='FAILFAST'`` reproduces the reference's raise on the first bad row.
    Rejects are ``where(~valid)``.
    """
    w, h = wrap(F.col("_j"))
    base = df.select(*keys, json_object_text(text).alias("_j")).select(*keys, "_j", w.alias("_w"), h.alias("_h"))
    base = base.select(*keys, "_j", wrapped_value("_w", "_h").alias("_v"))
    ok = F.col("_v").isNotNull() & is_object("_v")

    def given(name):  # present and not a JSON null
        v = F.try_variant_get("_v", f"$.{name}", "variant")
        return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))

    for r in required:
        ok = ok & given(r)
    base = base.select(*keys, "_v", F.from_json("_j", schema).alias("_t"))
    for f in schema.fields:  # a value that its type cannot hold
        ok = ok & (~given(f.name) | F.col("_t")[f.name].isNotNull())
    out = base.select(*keys, "_t", ok.alias("valid"))
    out = out.select(*keys, *[F.when(F.col("valid"), F.col("_t")[f.name]).alias(f.name) for f in schema.fields],
                     "valid")
    if mode.upper() == "FAILFAST":
        out = out.withColumn("valid", F.when(F.col("valid"), F.lit(True)).otherwise(
            F.raise_error(F.lit("structured output does not match the schema"))))
    return out


def clean_outputs(df: DataFrame, full: str = "full_text", prompt: str = "prompt", stop_at_call: bool = False,
                  keep_end: bool = True) -> DataFrame:
    """Completion of each generation: drop ``len(prompt)`` characters, cut after the
    first ``im_end`` (or, if asked, the first call-end, whichever comes first),
    then ``content`` = completion with ``im_end`` removed and trimmed.
    ``keep_end=False`` drops the end marker itself (the streaming form never
    yields it).  All codegen string functions."""
    c = F.col("_c")
    ends = []
    for s in [IM_END] + ([CALL_END] if stop_at_call else []):
        i = F.locate(s, c)
        ends.append(F.when(i > 0, i - 1 + (len(s) if keep_end else 0)))
    k = F.least(*ends) if len(ends) > 1 else ends[0]
    return (df.withColumn("_c", F.expr(f"substring({full}, length({prompt}) + 1)"))
            .withColumn("completion", F.when(k.isNotNull(), F.substring(c, F.lit(1), k)).otherwise(c))
            .withColumn("content", py_strip(F.replace(F.col("completion"), F.lit(IM_END), F.lit(""))))
            .drop("_c"))


def final_answer(df: DataFrame, text: str = "text") -> DataFrame:
    """Text after the last assistant header, ``im_end`` removed, trimmed."""
    last = F.substring_index(F.col(text), ASSISTANT_HEADER, -1)
    return df.withColumn("answer", py_strip(F.replace(last, F.lit(IM_END), F.lit(""))))


def shape_completion(df: DataFrame, text: str = "text", key: str = "out_id") -> DataFrame:
    """Chat-completion record per output, row-local (no group-by needed).

    ``finish_reason`` = ``tool_calls`` if any call else ``stop``; each call gets
    ``id = 'call_' || left(md5(key ':' pos), 8)``, ``type = 'function'`` and the
    canonical arguments JSON; ``content`` = text without ``im_end``, trimmed.
    """
    calls = F.transform(kept_calls(text), lambda c: F.struct(
        F.concat(F.lit("call_"), F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":"),
                                                           c["pos"].cast("string"))), 1, 8)).alias("id"),
        F.lit("function").alias("type"),
        F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    return df.select(
        key,
        F.when(F.size(calls) > 0, F.lit("tool_calls")).otherwise(F.lit("stop")).alias("finish_reason"),
        py_strip(F.replace(F.col(text), F.lit(IM_END), F.lit(""))).alias("content"),
        calls.alias("tool_calls"))


def calls_per_turn(df: DataFrame, text: str = "text", key: str = "out_id") -> DataFrame:
    """Calls dispatched in one assistant turn, and whether it is a parallel turn."""
    n = F.size(kept_calls(text))
    return df.select(key, n.alias("n_calls"), (n > 1).alias("parallel"))


def usage_counts(df: DataFrame, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Whitespace-split counts ``len(s.split())`` for prompt, completion, total."""
    p = F.size(F.regexp_extract_all(F.col(prompt), F.lit(NON_WS), F.lit(0)))
    c = F.size(F.regexp_extract_all(F.col(completion), F.lit(NON_WS), F.lit(0)))
    return (df.withColumn("prompt_tokens", p).withColumn("completion_tokens", c)
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))


#: grammar markers counted by ``grammar_check`` -> output column
GRAMMAR_COLUMNS = {
    IM_START: "n_im_start", IM_END: "n_im_end",
    SPECIAL_TOKENS[6]: "n_thought_start", SPECIAL_TOKENS[7]: "n_thought_end",
    CALL_START: "n_call_start", CALL_END: "n_call_end",
    SPECIAL_TOKENS[10]: "n_result_start", SPECIAL_TOKENS[11]: "n_result_end",
}


def grammar_check(df: DataFrame, text: str = "text", key: str = "out_id") -> DataFrame:
    """Per text: count of each paired control token and ``balanced`` (every start
    count equals its end count).  Literal counting, no regex."""
    cols = [count_literal(text, m).alias(c) for m, c in GRAMMAR_COLUMNS.items()]
    out = df.select(key, *cols)
    bal = ((F.col("n_thought_start") == F.col("n_thought_end")) & (F.col("n_call_start") == F.col("n_call_end"))
           & (F.col("n_result_start") == F.col("n_result_end")))
    return out.withColumn("balanced", bal)


def tool_call_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Flagship: calls per tool name (parsed + recovered), recovered and parallel counts.

    Row-local extraction, then one partial + final hash aggregate on ``name``
    (map-side combine, so a hot tool name costs one row per partition).
    """
    calls = df.where(F.col(text).contains(CALL_START)).select(kept_calls(text).alias("calls"))
    exploded = calls.select(F.size("calls").alias("n"), F.explode("calls").alias("c"))
    return (exploded.groupBy(F.col("c.name").alias("name"))
            .agg(F.count(F.lit(1)).alias("n_calls"),
                 F.sum(F.when(F.col("c.status") == RECOVERED, 1).otherwise(0)).alias("n_recovered"),
                 F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("n_in_parallel_turns")))
