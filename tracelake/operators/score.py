"""Benchmark cases, scoring, per-category scores, averages, leaderboard, results sink.

Cases are generated from an id column (the reference loops ``i`` over 0..49 per
category; any id table generalises it).  Scoring is row-local on
``answers JOIN cases`` (one equi join on the case id, without a hint: adaptive execution
picks it from run-time sizes): calls are parsed inside the row with higher-order functions, the
expected calls are an ``array<struct<name, arguments>>``.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.functions.columns import py_strip
from tracelake.functions.jsonx import wrap, wrapped_value
from tracelake.operators.extract import call_spans, kept_calls

# --- fixed values: benchmark suites (categories, tool cycle, prompts) --------
MCP_CATEGORIES = ["Single Tool Invocation", "Parameter & Type Adherence", "Parallel Multi-Tool Dispatch",
                  "Error Recovery & Self-Correction"]
MCP_TOOL_CYCLE = ["read_file", "write_file", "list_dir", "git_status", "execute_sql", "http_fetch",
                  "search_files", "get_system_info", "delete_file", "create_dir"]
BFCL_CATEGORIES = ["Simple Function Calling", "Multiple Function Selection", "Parallel Tool Calling",
                   "Relevance Detection and Abstention", "Error Self-Correction"]
BFCL_TOOL_POOL = ["calculate_mortgage", "search_flights", "get_stock_quote", "book_hotel", "convert_currency"]
BFCL_ABSTAIN_PROMPTS = [
    "What is the historical origin of the word algorithm?",
    "Explain the difference between supervised and unsupervised learning.",
    "Write a concise explanation of local inference engines.",
    "What are the primary colors in additive color theory?",
    "Summarize the key differences between TCP and UDP.",
]
# prompts and argument values of the generated cases; %d is the case number, %s a value of the case
MCP_READ_PROMPT = "Read the contents of 'src/config_%d.json'."
MCP_READ_PATH = "src/config_%d.json"
MCP_LIST_PROMPT = "List all files in the directory 'data/split_%d'."
MCP_LIST_PATH = "data/split_%d"
MCP_GIT_PROMPT = "Check current git repository status and branch."
MCP_SQL_PROMPT = "Execute SQL query 'SELECT id, name FROM users WHERE role_id = %d'."
MCP_SQL_QUERY = "SELECT id, name FROM users WHERE role_id = %d"
MCP_FETCH_PROMPT = "Fetch the URL 'https://api.internal/metrics/%d'."
MCP_FETCH_URL = "https://api.internal/metrics/%d"
MCP_PARAMS_PROMPT = "Search files with pattern '*.py' in 'src/' with recursive=%s and max_depth=%d."
MCP_PARALLEL_PROMPT = "Simultaneously check the git branch status and list files in 'checkpoints/run_%d'."
MCP_PARALLEL_PATH = "checkpoints/run_%d"
MCP_RECOVERY_PROMPT = ("Tool 'read_file' failed with 'FileNotFoundError: %s'. The file is actually located at '%s'. "
                       "Recover and read the file.")
MCP_RECOVERY_BAD_PATH = "/invalid/absolute/path_%d.txt"
MCP_RECOVERY_PATH = "data/path_%d.txt"
BFCL_SIMPLE_PROMPT = "Fetch weather conditions for San Francisco with unit celsius for day %d."
BFCL_MULTIPLE_PROMPT = "Convert 500 USD to EUR at current market rates."
BFCL_PARALLEL_PROMPT = "Check system memory and fetch current CPU temperature concurrently."
BFCL_RECOVERY_PROMPT = "Fix query: execute_sql failed with Table users_%d does not exist. Available: users."
# -----------------------------------------------------------------------------


def _case_id(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%03d", i + 1))


def _call_json(name: Column, args_json: Column) -> Column:
    return F.concat(F.lit('{"name":"'), name, F.lit('","arguments":'), args_json, F.lit("}"))


def _obj(*kv) -> Column:
    """Compact JSON object in the given key order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in zip(kv[::2], kv[1::2])]))


def gen_mcp_cases(ids: DataFrame, i: str = "i") -> DataFrame:
    """Four cases per id: ``id, category, prompt, expected (JSON array text), error_input``.

    Single-tool cases cycle through 10 tool names, but only four have their own
    branch; every other position becomes an ``http_fetch`` case (kept quirk).
    """
    x = F.col(i)
    tool = F.element_at(F.array(*[F.lit(t) for t in MCP_TOOL_CYCLE]), (x % len(MCP_TOOL_CYCLE) + 1).cast("int"))
    empty = F.lit("{}")
    single_prompt = (F.when(tool == "read_file", F.format_string(MCP_READ_PROMPT, x))
                     .when(tool == "list_dir", F.format_string(MCP_LIST_PROMPT, x))
                     .when(tool == "git_status", F.lit(MCP_GIT_PROMPT))
                     .when(tool == "execute_sql", F.format_string(MCP_SQL_PROMPT, x))
                     .otherwise(F.format_string(MCP_FETCH_PROMPT, x)))
    single_name = F.when(tool.isin("read_file", "list_dir", "git_status", "execute_sql"), tool).otherwise("http_fetch")
    single_args = (F.when(tool == "read_file", _obj("path", F.format_string(MCP_READ_PATH, x)))
                   .when(tool == "list_dir", _obj("path", F.format_string(MCP_LIST_PATH, x)))
                   .when(tool == "git_status", empty)
                   .when(tool == "execute_sql", _obj("query", F.format_string(MCP_SQL_QUERY, x)))
                   .otherwise(_obj("url", F.format_string(MCP_FETCH_URL, x))))
    single = ids.select(_case_id("single_tool_", x).alias("id"), F.lit(MCP_CATEGORIES[0]).alias("category"),
                        single_prompt.alias("prompt"),
                        F.concat(F.lit("["), _call_json(single_name, single_args), F.lit("]")).alias("expected"),
                        F.lit(None).cast("string").alias("error_input"))
    limit = (x * 5) % 100 + 10
    rec = (x % 2 == 0)
    rec_s = F.when(rec, "True").otherwise("False")
    params = ids.select(
        _case_id("param_adherence_", x).alias("id"), F.lit(MCP_CATEGORIES[1]).alias("category"),
        F.format_string(MCP_PARAMS_PROMPT, rec_s, limit).alias("prompt"),
        F.concat(F.lit("["), _call_json(F.lit("search_files"), _obj("pattern", F.lit("*.py"), "path", F.lit("src/"),
                                                                    "recursive", rec, "max_depth", limit)),
                 F.lit("]")).alias("expected"),
        F.lit(None).cast("string").alias("error_input"))
    par = ids.select(
        _case_id("parallel_dispatch_", x).alias("id"), F.lit(MCP_CATEGORIES[2]).alias("category"),
        F.format_string(MCP_PARALLEL_PROMPT, x).alias("prompt"),
        F.concat(F.lit("["), _call_json(F.lit("git_status"), empty), F.lit(","),
                 _call_json(F.lit("list_dir"), _obj("path", F.format_string(MCP_PARALLEL_PATH, x))),
                 F.lit("]")).alias("expected"),
        F.lit(None).cast("string").alias("error_input"))
    bad = F.format_string(MCP_RECOVERY_BAD_PATH, x)
    fixed = F.format_string(MCP_RECOVERY_PATH, x)
    recv = ids.select(
        _case_id("error_recovery_", x).alias("id"), F.lit(MCP_CATEGORIES[3]).alias("category"),
        F.format_string(MCP_RECOVERY_PROMPT, bad, fixed).alias("prompt"),
        F.concat(F.lit("["), _call_json(F.lit("read_file"), _obj("path", fixed)), F.lit("]")).alias("expected"),
        F.concat(F.lit("FileNotFoundError: "), bad).alias("error_input"))
    return single.unionByName(params).unionByName(par).unionByName(recv)


def _tools_json(*names: str, params: str | None = None) -> Column:
    items = []
    for n in names:
        items.append('{"name":"' + n + '"' + ((',"parameters":' + params) if params else "") + "}")
    return F.lit("[" + ",".join(items) + "]")


def gen_bfcl_cases(ids: DataFrame, i: str = "i") -> DataFrame:
    """Five cases per id: ``id, category, query, tools (JSON), expected (JSON or NULL), should_call``."""
    x = F.col(i)
    cols = ["id", "category", "query", "tools", "expected", "should_call"]
    simple = ids.select(
        _case_id("bfcl_simple_", x), F.lit(BFCL_CATEGORIES[0]),
        F.format_string(BFCL_SIMPLE_PROMPT, x % 7),
        _tools_json("get_weather", params='{"city":"str","unit":"str","day":"int"}'),
        F.concat(F.lit("["), _call_json(F.lit("get_weather"), _obj("city", F.lit("San Francisco"), "unit",
                                                                   F.lit("celsius"), "day", x % 7)), F.lit("]")),
        F.lit(True)).toDF(*cols)
    multiple = ids.select(
        _case_id("bfcl_multiple_", x), F.lit(BFCL_CATEGORIES[1]), F.lit(BFCL_MULTIPLE_PROMPT),
        _tools_json(*BFCL_TOOL_POOL),
        F.concat(F.lit("["), _call_json(F.lit("convert_currency"), _obj("amount", F.lit(500), "from", F.lit("USD"),
                                                                        "to", F.lit("EUR"))), F.lit("]")),
        F.lit(True)).toDF(*cols)
    parallel = ids.select(
        _case_id("bfcl_parallel_", x), F.lit(BFCL_CATEGORIES[2]),
        F.lit(BFCL_PARALLEL_PROMPT),
        _tools_json("get_memory_usage", "get_cpu_temp"),
        F.lit('[{"name":"get_memory_usage","arguments":{}},{"name":"get_cpu_temp","arguments":{}}]'),
        F.lit(True)).toDF(*cols)
    abstain = ids.select(
        _case_id("bfcl_abstain_", x), F.lit(BFCL_CATEGORIES[3]),
        F.element_at(F.array(*[F.lit(p) for p in BFCL_ABSTAIN_PROMPTS]), (x % 5 + 1).cast("int")),
        _tools_json("database_execute", "reboot_server"), F.lit(None).cast("string"), F.lit(False)).toDF(*cols)
    recovery = ids.select(
        _case_id("bfcl_error_recovery_", x), F.lit(BFCL_CATEGORIES[4]),
        F.format_string(BFCL_RECOVERY_PROMPT, x),
        _tools_json("execute_sql"),
        F.lit('[{"name":"execute_sql","arguments":{"query":"SELECT * FROM users"}}]'), F.lit(True)).toDF(*cols)
    return simple.unionByName(multiple).unionByName(parallel).unionByName(abstain).unionByName(recovery)


EXPECTED_TYPE = "array<struct<name: string, arguments: string>>"


def expected_array(expected_json) -> Column:
    """Expected calls JSON text -> ``array<struct<name, arguments (canonical JSON)>>``."""
    arr = F.from_json(expected_json, "array<struct<name: string, arguments: variant>>")
    return F.transform(arr, lambda e: F.struct(e["name"].alias("name"), F.to_json(e["arguments"]).alias("arguments")))


def score_outputs(answers: DataFrame, cases: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """Per answer: ``json_valid, name_match, args_match`` with the benchmark's rules.

    Spans between call markers, else the non-greedy flat-object fallback; bad
    JSON skipped; none parsed -> F,F,F.  Single expected: the **first** parsed
    call is compared.  List expected: fewer parsed than expected -> T,F,F; else
    every expected name, and separately every expected arguments, must occur
    among the parsed (order and pairing ignored).  Arguments compare as
    canonical JSON (keys sorted; ``1.0`` equals ``1``).  A parsed non-object
    counts as valid JSON with no match (the reference raises).
    ``cases(key, expected array<struct<name, arguments>>, is_list boolean)``.
    """
    c = cases.select(key, "expected", "is_list")
    j = answers.join(c, key)
    spans = call_spans(text, fallback=True)
    raws = F.transform(spans, lambda s: py_strip(s))
    wrapped = F.transform(raws, lambda r: F.struct(*[c.alias(n) for c, n in zip(wrap(r), ("w", "h"))]))
    parsed = F.filter(F.transform(wrapped, lambda x: wrapped_value(x["w"], x["h"])), lambda v: v.isNotNull())
    j = j.withColumn("_p", parsed)
    names = F.transform("_p", lambda v: F.try_variant_get(v, "$.name", "string"))
    args = F.transform("_p", lambda v: F.to_json(F.try_variant_get(v, "$.arguments", "variant")))
    j = j.withColumn("_n", names).withColumn("_a", args)
    n_p, n_e = F.size("_p"), F.size("expected")
    valid = n_p > 0
    list_names = F.forall("expected", lambda e: F.exists("_n", lambda n: n.eqNullSafe(e["name"])))
    list_args = F.forall("expected", lambda e: F.exists("_a", lambda a: a.eqNullSafe(e["arguments"])))
    first = F.element_at("expected", 1)
    s_name = F.element_at("_n", 1).eqNullSafe(first["name"])
    s_args = F.element_at("_a", 1).eqNullSafe(first["arguments"])
    name_m = F.when(~valid, False).when(F.col("is_list"), (n_p >= n_e) & list_names).otherwise(s_name)
    args_m = F.when(~valid, False).when(F.col("is_list"), (n_p >= n_e) & list_args).otherwise(s_args)
    return j.withColumn("json_valid", valid).withColumn("name_match", F.coalesce(name_m, F.lit(False))).withColumn(
        "args_match", F.coalesce(args_m, F.lit(False))).drop("_p", "_n", "_a")


def score_abstention(answers: DataFrame, text: str = "text") -> DataFrame:
    """A case that should not call is right iff no call is extracted."""
    n = F.size(kept_calls(text))
    return answers.withColumn("n_calls", n).withColumn("correct", n == 0)


def category_scores(scored: DataFrame, keys=("model", "category")) -> DataFrame:
    """Percent valid / name / args by model and category (rounded to 6 digits).

    Partial + final aggregation: a hot (model, category) costs one row per partition.
    """
    def pct(c):
        return F.round(100.0 * F.avg(F.col(c).cast("double")), 6)
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cases"), pct("json_valid").alias("json_valid"),
                                     pct("name_match").alias("name_match"), pct("args_match").alias("args_match"))


def macro_average(cat: DataFrame, model: str = "model") -> DataFrame:
    """Unweighted mean of the category percentages, beside the case-weighted micro average."""
    def macro(c):
        return F.round(F.avg(c), 6)

    def micro(c):
        return F.round(F.sum(F.col(c) * F.col("n_cases")) / F.sum("n_cases"), 6)
    return cat.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_categories"),
        macro("json_valid").alias("macro_json_valid"), macro("name_match").alias("macro_name_match"),
        macro("args_match").alias("macro_args_match"), micro("json_valid").alias("micro_json_valid"),
        micro("name_match").alias("micro_name_match"), micro("args_match").alias("micro_args_match"))


def leaderboard(avg: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """One row per model: params label (``M`` under 1e9 with no decimals, else ``B``
    with one), grammar label (Native / Prompt-wrap), overall scores and its rank
    by exact-args score (``dense_rank``; rows sorted by it).
    ``models(model, parameters long, native_tool_grammar boolean)``."""
    m = avg.join(models, model)
    p = F.col("parameters")
    label = F.when(p < 1e9, F.format_string("%.0fM", p / 1e6)).otherwise(F.format_string("%.1fB", p / 1e9))
    out = m.select(model, label.alias("params"),
                   F.when(F.col("native_tool_grammar"), "Native").otherwise("Prompt-wrap").alias("tool_grammar"),
                   F.col("macro_json_valid").alias("ast_valid"), F.col("macro_name_match").alias("tool_match"),
                   F.col("macro_args_match").alias("args_match"))
    # dense rank without a global window: the position of the distinct score tuple in
    # a range-partitioned sort (descending via negated keys), joined back on the scores
    from tracelake.operators.batches import global_positions
    keys = ["args_match", "tool_match", "ast_valid"]
    out = out.persist(StorageLevel.MEMORY_AND_DISK)  # one row per model, read twice below
    tuples = out.select(*keys).distinct().select(*keys, *[(-F.col(k)).alias(f"_n{k}") for k in keys])
    pos = global_positions(tuples, [f"_n{k}" for k in keys], keys=keys)
    ranked = out.join(pos, keys).withColumn("rank", (F.col("pos") + 1).cast("int")).drop("pos")
    return ranked.orderBy("rank", model)


def results_document(cat: DataFrame, avg: DataFrame, models: DataFrame, benchmark: str, model: str = "model",
                     test_case_count: int | None = None) -> DataFrame:
    """The nested results document, one row: ``benchmark, test_case_count, categories, models`` -- a map from the model's
    name to its ``parameters``, ``native_tool_grammar``, ``scores`` (category -> ``ast_valid, tool_match,
    args_match``) and ``overall_*``.  Its size follows the evaluated models and categories, not the cases."""
    sc = cat.groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "category", F.struct(F.col("json_valid").alias("ast_valid"), F.col("name_match").alias("tool_match"),
                             F.col("args_match").alias("args_match")))))).alias("scores"))
    entry = F.struct("parameters", "native_tool_grammar", "scores", F.col("macro_json_valid").alias("overall_ast_accuracy"),
                     F.col("macro_name_match").alias("overall_tool_selection"),
                     F.col("macro_args_match").alias("overall_args_exact_match"))

    def by_name(a, b):
        return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)

    per_model = sc.join(avg, model).join(models, model, "left").select(model, entry.alias("_e"), F.map_keys("scores").alias("_c"))
    doc = per_model.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_c")))).alias("categories"),
                        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(model).alias("k"), "_e")), by_name)).alias("models"))
    return doc.select(F.lit(benchmark).alias("benchmark"), F.lit(test_case_count).cast("long").alias("test_case_count"),
                      "categories", "models")


def sink_results_json(doc: DataFrame, path: str) -> None:
    """Publish a results document as JSON below ``path``, all or nothing.

    Spark writes the files into a folder of a new name; then the manifest -- that folder, its files with their
    bytes, the schema -- is written beside it under a temporary name and renamed over ``path/CURRENT`` in one
    step of the file system.  Readers follow the manifest, so they see the old document or the new one,
    never a half; a writer that dies leaves only a folder no manifest names."""
    spark = doc.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    doc.write.json(f"{path}/{version}")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{version}")
    files = sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in listed.select("path", "length").collect())
    manifest = json.dumps({"version": version, "files": files, "schema": json.loads(doc.schema.json())})
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop.fs
    temp, current = hadoop.Path(f"{path}/CURRENT-{version}"), hadoop.Path(f"{path}/CURRENT")
    out = current.getFileSystem(conf).create(temp, True)
    out.write(bytearray(manifest.encode("utf-8")))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(current.toUri(), conf).rename(temp, current, over)


def read_results_json(spark, path: str) -> DataFrame:
    """The published document of ``sink_results_json``; an error if files of its manifest are gone or changed."""
    m = json.loads(spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0])
    folder = f"{path}/{m['version']}"
    there = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length").collect()
    if sorted([r["path"].rsplit("/", 1)[1], r["length"]] for r in there) != m["files"]:
        raise ValueError(f"{folder}: files are not those of the manifest")
    return spark.read.schema(StructType.fromJson(m["schema"])).json([f"{folder}/{name}" for name, _ in m["files"]])
