"""Tool registries: ingestion, flattening, upsert, merge, resolution, validation.

Registries are small relative to call logs, but never assumed small: joins carry
no broadcast hint (adaptive execution decides on run-time bytes), and
every aggregation on a tool name is a partial + final hash aggregate, so a hot
tool name (a third of all calls) costs one row per partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.jsonx import strict_valid
from tracelake.operators.common import running_sum

LIST_REPLY = ("struct<result: struct<tools: array<struct<name: string, description: string, "
              "inputSchema: string>>>>")
SCHEMA_DOC = "struct<properties: map<string, string>, required: array<string>>"


def ingest_tool_lists(replies: DataFrame, body: str = "body", keys=("conn_id", "msg_id")) -> DataFrame:
    """``tools/list`` replies -> one row per tool: ``keys, pos, name, description, input_schema``.

    Typed parse with a declared schema (nested objects come back as compact JSON
    text in their original key order); ``description`` defaults to ``''`` and
    ``inputSchema`` to ``{}``; unparseable replies contribute no tools.
    """
    r = replies.where(strict_valid(body)).select(*keys, F.from_json(body, LIST_REPLY).alias("_r"))
    t = r.select(*keys, F.posexplode(F.coalesce(F.col("_r.result.tools"), F.array())).alias("pos", "t"))
    return t.select(*keys, "pos", F.col("t.name").alias("name"),
                    F.coalesce("t.description", F.lit("")).alias("description"),
                    F.coalesce("t.inputSchema", F.lit("{}")).alias("input_schema"))


def tool_params(registry: DataFrame, keys=("name",)) -> DataFrame:
    """One row per declared parameter: ``keys, pos, param, type, description, enum, default, required``.

    ``enum`` is the JSON array text, ``default`` the JSON scalar as text.
    """
    d = registry.select(*keys, F.from_json("input_schema", SCHEMA_DOC).alias("_s"))
    p = d.select(*keys, F.posexplode("_s.properties").alias("pos", "param", "spec"),
                 F.coalesce(F.col("_s.required"), F.array().cast("array<string>")).alias("_req"))
    return p.select(*keys, "pos", "param",
                    F.get_json_object("spec", "$.type").alias("type"),
                    F.get_json_object("spec", "$.description").alias("description"),
                    F.get_json_object("spec", "$.enum").alias("enum"),
                    F.get_json_object("spec", "$.default").alias("default"),
                    F.array_contains("_req", F.col("param")).alias("required"))


def registry_upsert(registrations: DataFrame, seq: str = "seq") -> DataFrame:
    """Registering a name again replaces its spec but keeps its first position.

    ``name, first_seq, description, input_schema`` -- ``max_by`` / ``min`` are
    partial aggregates (map-side combine) so repeated hot names stay cheap.
    """
    return registrations.groupBy("name").agg(
        F.min(seq).alias("first_seq"),
        F.max_by("description", seq).alias("description"),
        F.max_by("input_schema", seq).alias("input_schema"))


def merge_registries(local: DataFrame, connections: DataFrame, groups=None) -> DataFrame:
    """All tools: local specs first, then each connection's in attach order, duplicates kept.

    ``local(group, seq, name, description, input_schema)`` is filtered to
    ``groups`` (default filesystem, http, sqlite -- shell off);
    ``connections(conn_id, seq, name, description, input_schema)``.
    Output: ``provider, priority, seq, name, description, input_schema``
    (priority 0 = local, then ``1 + conn_id``).
    """
    groups = ["filesystem", "http", "sqlite"] if groups is None else groups
    loc = local.where(F.col("group").isin(*groups)).select(
        F.lit("local").alias("provider"), F.lit(0).cast("long").alias("priority"), "seq", "name", "description",
        "input_schema")
    con = connections.select(F.concat(F.lit("conn:"), F.col("conn_id").cast("string")).alias("provider"),
                             (F.col("conn_id") + 1).cast("long").alias("priority"), "seq", "name", "description",
                             "input_schema")
    return loc.unionByName(con)


def resolve_tool(calls: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Call -> provider: local registry first, then connections in attach order;
    the first match wins; none -> status ``error``, ``Tool 'x' not found.``.

    The registry is first reduced to one winner per name (``min_by`` on
    (priority, seq), partial aggregation), then joined without a hint: adaptive
    execution decides on its run-time size.
    """
    winners = registry.groupBy(F.col("name").alias("_n")).agg(
        F.min_by("provider", F.struct("priority", "seq")).alias("provider"))
    r = calls.join(winners, F.col(name) == F.col("_n"), "left").drop("_n")
    return (r.withColumn("status", F.when(F.col("provider").isNull(), "error").otherwise("resolved"))
            .withColumn("message", F.when(F.col("provider").isNull(),
                                          F.concat(F.lit("Tool '"), F.col(name), F.lit("' not found.")))))


def unresolved_calls(calls: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Calls to tools nobody offers (left anti join on the distinct names)."""
    names = registry.select(F.col("name").alias("_n")).distinct()
    return calls.join(names, F.col(name) == F.col("_n"), "left_anti")


def offered_tool_calls(calls: DataFrame, offered: DataFrame, case: str = "case_id", name: str = "name") -> DataFrame:
    """Calls restricted to the tools offered in their case (left semi join on (case, name))."""
    return calls.join(offered.select(case, name), [case, name], "left_semi")


def _json_type():
    """Variant type name (``_vt``) -> JSON Schema type."""
    return (F.when(F.col("_vt").startswith("BIGINT") | F.col("_vt").startswith("INT"), "integer")
              .when(F.col("_vt").startswith("DECIMAL") | F.col("_vt").startswith("DOUBLE")
                    | F.col("_vt").startswith("FLOAT"), "number")
              .when(F.col("_vt").startswith("STRING"), "string")
              .when(F.col("_vt").startswith("BOOLEAN"), "boolean")
              .when(F.col("_vt").startswith("ARRAY"), "array")
              .when(F.col("_vt").startswith("OBJECT"), "object")
              .when(F.col("_vt").startswith("VOID"), "null"))



def call_arguments(calls: DataFrame, keys=("out_id", "pos"), name: str = "name",
                   arguments: str = "arguments") -> DataFrame:
    """Arguments of each call: ``keys, name, param, value (JSON), json_type``."""
    a = calls.select(*keys, name, F.explode(F.from_json(arguments, "map<string,variant>")).alias("param", "_v"))
    return a.select(*keys, name, "param", F.to_json("_v").alias("value"),
                    F.schema_of_variant("_v").alias("_vt")).withColumn("json_type", _json_type()).drop("_vt")


def type_ok(declared, observed):
    """JSON Schema type check; an integer is also a number; undeclared type passes."""
    return (declared.isNull() | (declared == observed)
            | ((declared == "number") & (observed == "integer")))


def _json_type_of(vt) -> F.Column:
    """Variant type name -> JSON Schema type (column expression)."""
    return (F.when(vt.startswith("BIGINT") | vt.startswith("INT"), "integer")
            .when(vt.startswith("DECIMAL") | vt.startswith("DOUBLE") | vt.startswith("FLOAT"), "number")
            .when(vt.startswith("STRING"), "string").when(vt.startswith("BOOLEAN"), "boolean")
            .when(vt.startswith("ARRAY"), "array").when(vt.startswith("OBJECT"), "object")
            .when(vt.startswith("VOID"), "null"))


def validate_args(calls: DataFrame, params: DataFrame, keys=("out_id", "pos"), name: str = "name",
                  arguments: str = "arguments") -> DataFrame:
    """Per call against its tool's declared parameters (calls to unknown tools skipped):
    ``keys, name, n_missing, n_unknown, n_type_errors, n_enum_errors, valid``.

    Row-local: each call gets its tool's declared-parameter array through one
    equi join on the tool name (one row per tool; no hint, adaptive execution picks the join),
    and the four checks are array functions over the declared array and the
    call's argument map -- no explode, no outer join, no shuffle of the calls.
    """
    decl = params.groupBy(F.col("name").alias("_tool")).agg(F.collect_list(F.struct(
        "param", "type", F.from_json("enum", "array<string>").alias("enum"), "required")).alias("_decl"))
    c = calls.join(decl, F.col(name) == F.col("_tool"), "inner")
    c = c.withColumn("_args", F.coalesce(F.from_json(arguments, "map<string,variant>"),
                                         F.create_map().cast("map<string,variant>")))
    present = lambda d: F.map_contains_key("_args", d["param"])
    val = lambda d: F.element_at("_args", d["param"])
    missing = F.size(F.filter("_decl", lambda d: d["required"] & ~present(d)))
    unknown = F.size(F.filter(F.map_keys("_args"), lambda k: ~F.exists("_decl", lambda d: d["param"] == k)))
    bad_type = F.size(F.filter("_decl", lambda d: present(d) & ~type_ok(
        d["type"], _json_type_of(F.schema_of_variant(val(d))))))
    bad_enum = F.size(F.filter("_decl", lambda d: present(d) & d["enum"].isNotNull() & ~F.array_contains(
        d["enum"], F.coalesce(F.get_json_object(F.concat(F.lit("["), F.to_json(val(d)), F.lit("]")), "$[0]"),
                              F.lit("")))))
    out = c.select(*keys, name, missing.cast("long").alias("n_missing"), unknown.cast("long").alias("n_unknown"),
                   bad_type.cast("long").alias("n_type_errors"), bad_enum.cast("long").alias("n_enum_errors"))
    return out.withColumn("valid", (F.col("n_missing") + F.col("n_unknown") + F.col("n_type_errors")
                                    + F.col("n_enum_errors")) == 0)


def infer_arg_schema(calls: DataFrame, keys=("out_id", "pos"), name: str = "name") -> DataFrame:
    """Observed calls -> per (tool, param): JSON type (one observed type, integer
    widened to number, any other conflict -> ``string``), ``required`` (present
    in every call of the tool), ``default`` (most common value; ties -> the
    smallest JSON text), ``n_calls`` with the parameter.
    """
    obs = call_arguments(calls, keys, name).where(F.col("json_type") != "null")
    per_tool = calls.groupBy(F.col(name).alias("_t")).agg(F.count(F.lit(1)).alias("_tool_calls"))
    vals = obs.groupBy(name, "param", "value").agg(F.count(F.lit(1)).alias("_c"))
    mode = vals.groupBy(name, "param").agg(F.min_by("value", F.struct(-F.col("_c"), F.col("value"))).alias("default"))
    types = obs.groupBy(name, "param").agg(F.count(F.lit(1)).alias("n_calls"),
                                           F.collect_set("json_type").alias("_ts"))
    ty = (F.when(F.size("_ts") == 1, F.col("_ts")[0])
          .when((F.size("_ts") == 2) & F.array_contains("_ts", "integer") & F.array_contains("_ts", "number"),
                "number").otherwise("string"))
    out = types.join(mode, [name, "param"]).join(per_tool, F.col(name) == F.col("_t"))
    return out.select(F.col(name).alias("tool"), "param", ty.alias("type"),
                      (F.col("n_calls") == F.col("_tool_calls")).alias("required"), "default", "n_calls")


def _jstr(c):
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                    F.lit('"'))


def compact_schema(registry: DataFrame, params: DataFrame) -> DataFrame:
    """Tool spec -> ``{"name":..,"desc":..,"args":{p:{"type":..,"req":..}}}`` and its
    size against the full spec JSON: ``name, compact, full_chars, compact_chars, ratio``."""
    from tracelake.operators.render import ordered_concat, tool_json
    arg = F.concat(_jstr(F.col("param")), F.lit(':{"type":'), _jstr(F.coalesce("type", F.lit("string"))),
                   F.lit(',"req":'), F.when(F.col("required"), "true").otherwise("false"), F.lit("},"))
    args = ordered_concat(params.select("name", "pos", arg.alias("_a")), ["name"], "pos", "_a", "_args",
                          bucket_rows=None)
    r = registry.select("name", "description", "input_schema").join(args, "name", "left")
    compact = F.concat(F.lit('{"name":'), _jstr(F.col("name")), F.lit(',"desc":'), _jstr(F.col("description")),
                       F.lit(',"args":{'), F.coalesce(F.expr("substring(_args, 1, length(_args) - 1)"), F.lit("")),
                       F.lit("}}"))
    full = tool_json()
    return r.select("name", compact.alias("compact"), F.length(full).alias("full_chars")).withColumn(
        "compact_chars", F.length("compact")).withColumn(
        "ratio", F.round(F.col("full_chars") / F.col("compact_chars"), 6))


WORD = r"[a-z0-9]+"


def preselect_tools(prompts: DataFrame, tools: DataFrame, k: int = 3, key: str = "prompt_id",
                    text: str = "text") -> DataFrame:
    """Keep, per prompt, the tools sharing the most distinct lower-case words with it
    (``rank() <= k``: ties at the k-th stay; tools with no shared word never).

    Tool words (name split on ``_`` + description) are the small side, joined
    without a hint; prompt words are de-duplicated per prompt before the join so a
    hot word costs one row per prompt.  Output ``key, name, overlap, rank``.
    """
    pw = prompts.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
                        .alias("word")).distinct()
    tw = tools.select("name", F.explode(F.regexp_extract_all(
        F.lower(F.concat_ws(" ", F.replace(F.col("name"), F.lit("_"), F.lit(" ")), F.col("description"))),
        F.lit(WORD), F.lit(0))).alias("word")).distinct()
    ov = pw.join(tw, "word").groupBy(key, "name").agg(F.count(F.lit(1)).alias("overlap"))
    w = Window.partitionBy(key).orderBy(F.desc("overlap"))
    return ov.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)


def context_budget(tools: DataFrame, ctx: int = 2048, keys=("conn_id",), order: str = "seq",
                   tokens: str = "tokens", bucket_rows: int | None = 65536) -> DataFrame:
    """Keep tools, in order, while their running token count fits ``ctx``.

    Token counts are non-negative, so the running sum is monotone and "while it
    fits" is a filter on the prefix sum (skew-safe, see ``running_sum``).
    """
    r = running_sum(tools, list(keys), order, tokens, "running_tokens", bucket_rows)
    return r.where(F.col("running_tokens") <= ctx)
