"""Queries: benchmark cases and scoring, metric-log windows, top-k, turns, batching, corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.markers import CALL_SPAN, FLAT_OBJECT, IM_END, IM_START, RESULT_END, RESULT_START
from tracelake.operators import batches as B
from tracelake.operators import corpus as C
from tracelake.operators import score as S
from tracelake.operators import windows as W
from tracelake.operators.render import render_tool_turn
from tracelake.plans.duck import (ANSWERS, CANDIDATES, TRAIN_LOG, TURNS, calls_sql, cte, q, spans_sql, strip)
from tracelake.plans.registry import query
from tracelake.sources import fixtures as fx
from tracelake.sources.tables import table
from tracelake.streaming.runner import scratch

# ---- benchmark scoring ------------------------------------------------------------

EXPECTED_SPARK = ("CASE category WHEN 'single' THEN '[{\"name\":\"' || exp_name || '\",\"arguments\":' || exp_args || '}]' "
                  "WHEN 'parallel' THEN '[{\"name\":\"' || exp_name || '\",\"arguments\":' || exp_args || '},"
                  "{\"name\":\"git_status\",\"arguments\":{}}]' ELSE '[]' END")


def _answers(spark, sf):
    return fx.answers(spark, sf)


def _cases(ans):
    return ans.select("case_id", S.expected_array(F.expr(EXPECTED_SPARK)).alias("expected"),
                      (F.col("category") == "parallel").alias("is_list"))


def _scored(spark, sf):
    ans = _answers(spark, sf)
    called = ans.where("should_call")
    return S.score_outputs(called.select("model", "case_id", "category", "text"), _cases(called))


def _abstained(spark, sf):
    ans = _answers(spark, sf).where("NOT should_call")
    return S.score_abstention(ans.select("model", "case_id", "category", "text"))


def _all_scores(spark, sf):
    s = _scored(spark, sf).select("model", "case_id", "category", "json_valid", "name_match", "args_match")
    a = _abstained(spark, sf).select("model", "case_id", "category", F.col("correct").alias("json_valid"),
                                     F.col("correct").alias("name_match"), F.col("correct").alias("args_match"))
    return s.unionByName(a)


SPANS_FB = ("SELECT case_id, CAST(unnest(range(len(m))) AS INT) AS pos, unnest(m) AS span FROM "
            f"(SELECT case_id, CASE WHEN len(regexp_extract_all(text, {q(CALL_SPAN)}, 1)) > 0 "
            f"THEN regexp_extract_all(text, {q(CALL_SPAN)}, 1) ELSE regexp_extract_all(text, {q(FLAT_OBJECT)}, 0) END AS m "
            "FROM a WHERE should_call)")
SCORE_CTE = dict(
    a=ANSWERS, s=SPANS_FB,
    p=f"SELECT case_id, pos, {strip('span')} AS raw FROM s WHERE json_valid({strip('span')})",
    pp="SELECT case_id, pos, json_extract_string(raw, '$.name') AS name, "
       "CAST(json_extract(raw, '$.arguments') AS VARCHAR) AS args, "
       "row_number() OVER (PARTITION BY case_id ORDER BY pos) AS rn FROM p",
    g="SELECT pp.case_id, count(*) AS n, max(CASE WHEN rn = 1 THEN name END) AS fname, "
      "max(CASE WHEN rn = 1 THEN args END) AS fargs, "
      "coalesce(bool_or(name = a.exp_name), false) AS has_name, "
      "coalesce(bool_or(name = 'git_status'), false) AS has_git, "
      "coalesce(bool_or(args = CAST(json(a.exp_args) AS VARCHAR)), false) AS has_args, "
      "coalesce(bool_or(args = '{}'), false) AS has_empty "
      "FROM pp JOIN a ON pp.case_id = a.case_id GROUP BY pp.case_id, a.exp_name, a.exp_args",
    r="""SELECT a.model, a.case_id, a.category, coalesce(g.n, 0) > 0 AS json_valid,
  CASE WHEN coalesce(g.n, 0) = 0 THEN false WHEN a.category = 'parallel' THEN g.n >= 2 AND g.has_name AND g.has_git
       ELSE coalesce(g.fname = a.exp_name, false) END AS name_match,
  CASE WHEN coalesce(g.n, 0) = 0 THEN false WHEN a.category = 'parallel' THEN g.n >= 2 AND g.has_args AND g.has_empty
       ELSE coalesce(g.fargs = CAST(json(a.exp_args) AS VARCHAR), false) END AS args_match
FROM a LEFT JOIN g ON a.case_id = g.case_id WHERE a.should_call""")

ABSTAIN_CTE = dict(
    a=ANSWERS,
    ax="SELECT case_id AS out_id, CAST(unnest(range(len(m))) AS INT) AS pos, unnest(m) AS span FROM "
       f"(SELECT case_id, regexp_extract_all(text, {q(CALL_SPAN)}, 1) AS m FROM a WHERE NOT should_call)",
    ac=calls_sql("ax"),
    ak="SELECT out_id, count(*) AS n FROM ac WHERE status IN ('parsed', 'recovered') GROUP BY out_id",
    ab="SELECT a.model, a.case_id, a.category, CAST(coalesce(ak.n, 0) AS INT) AS n_calls, coalesce(ak.n, 0) = 0 AS correct "
       "FROM a LEFT JOIN ak ON a.case_id = ak.out_id WHERE NOT a.should_call")

ALL_SCORES = ("SELECT model, case_id, category, json_valid, name_match, args_match FROM r UNION ALL "
              "SELECT model, case_id, category, correct, correct, correct FROM ab")
CAT_SQL = ("SELECT model, category, count(*) AS n_cases, "
           "round(100.0 * avg(CAST(json_valid AS DOUBLE)), 6) AS json_valid, "
           "round(100.0 * avg(CAST(name_match AS DOUBLE)), 6) AS name_match, "
           "round(100.0 * avg(CAST(args_match AS DOUBLE)), 6) AS args_match FROM sc GROUP BY model, category")
AVG_SQL = ("SELECT model, count(*) AS n_categories, round(avg(json_valid), 6) AS macro_json_valid, "
           "round(avg(name_match), 6) AS macro_name_match, round(avg(args_match), 6) AS macro_args_match, "
           "round(sum(json_valid * n_cases) / sum(n_cases), 6) AS micro_json_valid, "
           "round(sum(name_match * n_cases) / sum(n_cases), 6) AS micro_name_match, "
           "round(sum(args_match * n_cases) / sum(n_cases), 6) AS micro_args_match FROM cat GROUP BY model")
SCORES_ALL_CTE = {**SCORE_CTE, **{k: v for k, v in ABSTAIN_CTE.items() if k != "a"}, "sc": ALL_SCORES}

#: model metadata of the two scripted answer sets (a broadcast side of two rows)
MODELS = [("model_even", 245924864, True), ("model_odd", 1230000000, False)]
MODELS_SQL = ("SELECT * FROM (VALUES ('model_even', 245924864, true), ('model_odd', 1230000000, false)) "
              "AS m(model, parameters, native_tool_grammar)")


def _models(spark):
    return spark.createDataFrame(MODELS, "model string, parameters long, native_tool_grammar boolean")


@query("score_outputs", cte(**SCORE_CTE) + "SELECT * FROM r")
def q_score_outputs(spark, sf):
    return _scored(spark, sf).select("model", "case_id", "category", "json_valid", "name_match", "args_match")


@query("score_abstention", cte(**ABSTAIN_CTE) + "SELECT * FROM ab")
def q_score_abstention(spark, sf):
    return _abstained(spark, sf).select("model", "case_id", "category", "n_calls", "correct")


@query("category_scores", cte(**SCORES_ALL_CTE) + CAT_SQL)
def q_category_scores(spark, sf):
    return S.category_scores(_all_scores(spark, sf))


@query("macro_average", cte(**SCORES_ALL_CTE, cat=CAT_SQL) + AVG_SQL)
def q_macro_average(spark, sf):
    return S.macro_average(S.category_scores(_all_scores(spark, sf)))


@query("leaderboard", cte(**SCORES_ALL_CTE, cat=CAT_SQL, av=AVG_SQL, m=MODELS_SQL)
       + """SELECT av.model, CASE WHEN parameters < 1e9 THEN printf('%.0fM', parameters / 1e6)
  ELSE printf('%.1fB', parameters / 1e9) END AS params,
  CASE WHEN native_tool_grammar THEN 'Native' ELSE 'Prompt-wrap' END AS tool_grammar,
  macro_json_valid AS ast_valid, macro_name_match AS tool_match, macro_args_match AS args_match,
  CAST(dense_rank() OVER (ORDER BY macro_args_match DESC, macro_name_match DESC, macro_json_valid DESC) AS INT) AS rank
FROM av JOIN m ON av.model = m.model""")
def q_leaderboard(spark, sf):
    avg = S.macro_average(S.category_scores(_all_scores(spark, sf)))
    return S.leaderboard(avg, _models(spark))


BENCHMARK = "scripted answers over events"


@query("sink_results_json", cte(**SCORES_ALL_CTE, cat=CAT_SQL, av=AVG_SQL, m=MODELS_SQL)
       + f"""SELECT '{BENCHMARK}' AS benchmark, (SELECT count(DISTINCT case_id) FROM sc) AS test_case_count, av.model, m.parameters,
  m.native_tool_grammar, cat.category, cat.json_valid AS ast_valid, cat.name_match AS tool_match, cat.args_match,
  av.macro_json_valid AS overall_ast_accuracy, av.macro_name_match AS overall_tool_selection,
  av.macro_args_match AS overall_args_exact_match
FROM av JOIN m ON av.model = m.model JOIN cat ON cat.model = av.model""")
def q_sink_results_json(spark, sf):
    """The nested document, published and read back, one row for each model and category."""
    scores = _all_scores(spark, sf)
    cat = S.category_scores(scores)
    doc = S.results_document(cat, S.macro_average(cat), _models(spark), BENCHMARK,
                             test_case_count=scores.select("case_id").distinct().count())
    path = scratch(spark, "results")
    S.sink_results_json(doc, path)
    back = S.read_results_json(spark, path)
    rows = back.select("benchmark", "test_case_count", F.explode("models").alias("model", "x"))
    rows = rows.select("benchmark", "test_case_count", "model", "x.*").withColumnRenamed("scores", "_s")
    return rows.select("benchmark", "test_case_count", "model", "parameters", "native_tool_grammar", F.explode("_s").alias("category", "c"),
                       "overall_ast_accuracy", "overall_tool_selection", "overall_args_exact_match").select("*", "c.*").drop("c")


def _ids(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("i"))


MCP_CASES_SQL = """
WITH e AS (SELECT event_id AS i, ['read_file', 'write_file', 'list_dir', 'git_status', 'execute_sql', 'http_fetch',
  'search_files', 'get_system_info', 'delete_file', 'create_dir'][event_id % 10 + 1] AS tool FROM events)
SELECT 'single_tool_' || printf('%03d', i + 1) AS id, 'Single Tool Invocation' AS category,
  CASE tool WHEN 'read_file' THEN 'Read the contents of ''src/config_' || i || '.json''.'
            WHEN 'list_dir' THEN 'List all files in the directory ''data/split_' || i || '''.'
            WHEN 'git_status' THEN 'Check current git repository status and branch.'
            WHEN 'execute_sql' THEN 'Execute SQL query ''SELECT id, name FROM users WHERE role_id = ' || i || '''.'
            ELSE 'Fetch the URL ''https://api.internal/metrics/' || i || '''.' END AS prompt,
  '[{"name":"' || CASE WHEN tool IN ('read_file', 'list_dir', 'git_status', 'execute_sql') THEN tool ELSE 'http_fetch' END
  || '","arguments":' || CASE tool WHEN 'read_file' THEN CAST(json_object('path', 'src/config_' || i || '.json') AS VARCHAR)
            WHEN 'list_dir' THEN CAST(json_object('path', 'data/split_' || i) AS VARCHAR)
            WHEN 'git_status' THEN '{}'
            WHEN 'execute_sql' THEN CAST(json_object('query', 'SELECT id, name FROM users WHERE role_id = ' || i) AS VARCHAR)
            ELSE CAST(json_object('url', 'https://api.internal/metrics/' || i) AS VARCHAR) END || '}]' AS expected,
  CAST(NULL AS VARCHAR) AS error_input FROM e
UNION ALL
SELECT 'param_adherence_' || printf('%03d', i + 1), 'Parameter & Type Adherence',
  'Search files with pattern ''*.py'' in ''src/'' with recursive=' || CASE WHEN i % 2 = 0 THEN 'True' ELSE 'False' END
  || ' and max_depth=' || ((i * 5) % 100 + 10) || '.',
  '[{"name":"search_files","arguments":' || CAST(json_object('pattern', '*.py', 'path', 'src/', 'recursive', i % 2 = 0,
  'max_depth', (i * 5) % 100 + 10) AS VARCHAR) || '}]', NULL FROM e
UNION ALL
SELECT 'parallel_dispatch_' || printf('%03d', i + 1), 'Parallel Multi-Tool Dispatch',
  'Simultaneously check the git branch status and list files in ''checkpoints/run_' || i || '''.',
  '[{"name":"git_status","arguments":{}},{"name":"list_dir","arguments":' ||
  CAST(json_object('path', 'checkpoints/run_' || i) AS VARCHAR) || '}]', NULL FROM e
UNION ALL
SELECT 'error_recovery_' || printf('%03d', i + 1), 'Error Recovery & Self-Correction',
  'Tool ''read_file'' failed with ''FileNotFoundError: /invalid/absolute/path_' || i || '.txt''. The file is actually located at ''data/path_'
  || i || '.txt''. Recover and read the file.',
  '[{"name":"read_file","arguments":' || CAST(json_object('path', 'data/path_' || i || '.txt') AS VARCHAR) || '}]',
  'FileNotFoundError: /invalid/absolute/path_' || i || '.txt' FROM e"""


@query("gen_mcp_cases", MCP_CASES_SQL)
def q_gen_mcp_cases(spark, sf):
    return S.gen_mcp_cases(_ids(spark, sf))


BFCL_CASES_SQL = """
WITH e AS (SELECT event_id AS i FROM events)
SELECT 'bfcl_simple_' || printf('%03d', i + 1) AS id, 'Simple Function Calling' AS category,
  'Fetch weather conditions for San Francisco with unit celsius for day ' || (i % 7) || '.' AS query,
  '[{"name":"get_weather","parameters":{"city":"str","unit":"str","day":"int"}}]' AS tools,
  '[{"name":"get_weather","arguments":' || CAST(json_object('city', 'San Francisco', 'unit', 'celsius', 'day', i % 7) AS VARCHAR)
  || '}]' AS expected, true AS should_call FROM e
UNION ALL
SELECT 'bfcl_multiple_' || printf('%03d', i + 1), 'Multiple Function Selection', 'Convert 500 USD to EUR at current market rates.',
  '[{"name":"calculate_mortgage"},{"name":"search_flights"},{"name":"get_stock_quote"},{"name":"book_hotel"},{"name":"convert_currency"}]',
  '[{"name":"convert_currency","arguments":{"amount":500,"from":"USD","to":"EUR"}}]', true FROM e
UNION ALL
SELECT 'bfcl_parallel_' || printf('%03d', i + 1), 'Parallel Tool Calling',
  'Check system memory and fetch current CPU temperature concurrently.',
  '[{"name":"get_memory_usage"},{"name":"get_cpu_temp"}]',
  '[{"name":"get_memory_usage","arguments":{}},{"name":"get_cpu_temp","arguments":{}}]', true FROM e
UNION ALL
SELECT 'bfcl_abstain_' || printf('%03d', i + 1), 'Relevance Detection and Abstention',
  ['What is the historical origin of the word algorithm?',
   'Explain the difference between supervised and unsupervised learning.',
   'Write a concise explanation of local inference engines.',
   'What are the primary colors in additive color theory?',
   'Summarize the key differences between TCP and UDP.'][i % 5 + 1],
  '[{"name":"database_execute"},{"name":"reboot_server"}]', NULL, false FROM e
UNION ALL
SELECT 'bfcl_error_recovery_' || printf('%03d', i + 1), 'Error Self-Correction',
  'Fix query: execute_sql failed with Table users_' || i || ' does not exist. Available: users.',
  '[{"name":"execute_sql"}]', '[{"name":"execute_sql","arguments":{"query":"SELECT * FROM users"}}]', true FROM e"""


@query("gen_bfcl_cases", BFCL_CASES_SQL)
def q_gen_bfcl_cases(spark, sf):
    return S.gen_bfcl_cases(_ids(spark, sf))


# ---- metric logs -------------------------------------------------------------------

@query("eval_mean_loss", cte(t=TRAIN_LOG, v="SELECT * FROM t WHERE NOT isnan(loss)",
                             f="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM v",
                             m="SELECT run_id, avg(loss) AS m FROM f WHERE rn <= 50 GROUP BY run_id")
       + "SELECT r.run_id, round(coalesce(m.m, 0.0), 6) AS mean_loss FROM (SELECT DISTINCT run_id FROM t) r "
         "LEFT JOIN m ON r.run_id = m.run_id")
def q_eval_mean_loss(spark, sf):
    return W.eval_mean_loss(fx.train_log(spark, sf))


@query("best_so_far", cte(t=TRAIN_LOG, p="SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN "
                                        "UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t")
       + "SELECT run_id, step, loss, coalesce(loss < prev, NOT isnan(loss)) AND NOT isnan(loss) AS is_best FROM p")
def q_best_so_far(spark, sf):
    return W.best_so_far(fx.train_log(spark, sf)).select("run_id", "step", "loss", "is_best")


@query("checkpoint_best", cte(t=TRAIN_LOG, v="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loss, step) AS rn "
                                           "FROM t WHERE NOT isnan(loss)")
       + "SELECT run_id, step AS best_step, loss AS best_loss FROM v WHERE rn = 1")
def q_checkpoint_best(spark, sf):
    return W.checkpoint_best(fx.train_log(spark, sf))


@query("budget_cutoff", cte(t=TRAIN_LOG, s="SELECT run_id, arg_min(ts, step) AS t0 FROM t GROUP BY run_id",
                            e="SELECT t.run_id, t.step, date_diff('microsecond', s.t0, t.ts) AS elapsed_us FROM t "
                              "JOIN s ON t.run_id = s.run_id",
                            b=f"SELECT run_id, min(step) AS cut FROM e WHERE elapsed_us >= {W.BUDGET_US} GROUP BY run_id")
       + "SELECT e.run_id, e.step, e.elapsed_us FROM e LEFT JOIN b ON e.run_id = b.run_id "
         "WHERE b.cut IS NULL OR e.step < b.cut")
def q_budget_cutoff(spark, sf):
    return W.budget_cutoff(fx.train_log(spark, sf)).select("run_id", "step", "elapsed_us")


@query("clean_metric_log", cte(t=TRAIN_LOG) + "SELECT run_id, step, loss FROM t WHERE isfinite(loss) AND step % 20 = 0")
def q_clean_metric_log(spark, sf):
    kept, _ = W.clean_metric_log(fx.train_log(spark, sf))
    return kept.select("run_id", "step", "loss")


# ---- top-k sampling ----------------------------------------------------------------

TOPK = ("SELECT grp, cand, score, CAST(rank() OVER (PARTITION BY grp ORDER BY score DESC) AS INT) AS rank FROM c")
SOFTMAX = ("SELECT grp, cand, score, rank, round(exp((score - max(score) OVER (PARTITION BY grp)) / 0.6) / "
           "sum(exp((score - max(score) OVER (PARTITION BY grp)) / 0.6)) OVER (PARTITION BY grp), 6) AS prob "
           "FROM (SELECT * FROM k WHERE rank <= 3)")


@query("topk_ties", cte(c=CANDIDATES, k=TOPK) + "SELECT * FROM k WHERE rank <= 3")
def q_topk_ties(spark, sf):
    return W.topk_ties(fx.candidates(spark, sf), k=3)


@query("topk_softmax", cte(c=CANDIDATES, k=TOPK, s0="SELECT grp, cand, score, rank, exp((score - max(score) OVER "
                                                      "(PARTITION BY grp)) / 0.6) AS z FROM k WHERE rank <= 3")
       + "SELECT grp, cand, score, rank, round(z / sum(z) OVER (PARTITION BY grp), 6) AS prob FROM s0")
def q_topk_softmax(spark, sf):
    return W.topk_softmax(fx.candidates(spark, sf), k=3, temperature=0.6)


@query("topk_softmax_all", cte(c=CANDIDATES, s0="SELECT grp, cand, score, exp((score - max(score) OVER (PARTITION BY grp)) / 0.6) AS z FROM c")
       + "SELECT grp, cand, score, 1 AS rank, round(z / sum(z) OVER (PARTITION BY grp), 6) AS prob FROM s0")
def q_topk_softmax_all(spark, sf):
    """``k <= 0``: every candidate of a group, however large, takes part."""
    return W.topk_softmax(fx.candidates(spark, sf), k=0, temperature=0.6)


@query("weighted_draw", cte(c=CANDIDATES, k=TOPK, s0="SELECT grp, cand, score, rank, exp((score - max(score) OVER "
                                                       "(PARTITION BY grp)) / 0.6) AS z FROM k WHERE rank <= 3",
                            s="SELECT grp, cand, round(z / sum(z) OVER (PARTITION BY grp), 6) AS prob FROM s0",
                            u="SELECT grp, cand, prob, -ln((CAST(('0x' || substr(md5('42:' || CAST(grp AS VARCHAR) || ':' "
                              "|| CAST(cand AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0) / prob AS r "
                              "FROM s WHERE prob > 0")
       + "SELECT grp, arg_min(cand, r) AS drawn FROM u GROUP BY grp")
def q_weighted_draw(spark, sf):
    return W.weighted_draw(W.topk_softmax(fx.candidates(spark, sf), k=3, temperature=0.6))


# ---- multi-turn logs ------------------------------------------------------------------

@query("cap_turns", cte(t=TURNS, c="SELECT *, coalesce(max(CASE WHEN NOT has_call THEN 1 ELSE 0 END) OVER "
                                   "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
                                   "AS s FROM t WHERE turn <= 5")
       + "SELECT conv_id, turn, name, has_call FROM c WHERE s = 0")
def q_cap_turns(spark, sf):
    return W.cap_turns(fx.turns(spark, sf)).select("conv_id", "turn", "name", "has_call")


@query("detect_recovery", cte(t=TURNS)
       + """SELECT a.conv_id, a.turn, b.name AS next_name,
  coalesce(a.name <> b.name OR a.args <> b.args, false) AS changed,
  coalesce(a.name <> b.name OR a.args <> b.args, false) AND b.status <> 'error' AS recovered
FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.status = 'error'""")
def q_detect_recovery(spark, sf):
    return W.detect_recovery(fx.turns(spark, sf))


@query("render_tool_turn", cte(t=TURNS)
       + f"""SELECT conv_id, CAST((turn - 1) // 3 AS INT) AS agent_turn,
  chr(10) || '{IM_START}tool' || chr(10) || string_agg('{RESULT_START}' || '{{"status": "' || status || '", "result": ' || args
  || '}}' || '{RESULT_END}' || chr(10), '' ORDER BY turn) || '{IM_END}' || chr(10) || '{IM_START}assistant' || chr(10) AS tool_message
FROM t GROUP BY conv_id, CAST((turn - 1) // 3 AS INT)""")
def q_render_tool_turn(spark, sf):
    t = fx.turns(spark, sf).selectExpr("conv_id", "turn", "CAST((turn - 1) div 3 AS INT) AS agent_turn",
                                       "'{\"status\": \"' || status || '\", \"result\": ' || args || '}' AS result_json")
    return render_tool_turn(t, keys=("conv_id", "agent_turn"), order="turn")


# ---- batching ------------------------------------------------------------------------

SHUFFLE = ("SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS shuffle_key, "
           "row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos FROM documents")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id")


@query("seeded_shuffle", SHUFFLE)
def q_seeded_shuffle(spark, sf):
    return B.seeded_shuffle(_docs(spark, sf))


@query("train_val_split", cte(s=SHUFFLE)
       + "SELECT doc_id, pos, CASE WHEN pos < (SELECT floor(count(*) * 0.95) FROM s) THEN 'train' ELSE 'val' END AS split FROM s")
def q_train_val_split(spark, sf):
    return B.train_val_split(_docs(spark, sf))


@query("fixed_batches", cte(s=SHUFFLE) + "SELECT doc_id, pos, CAST(floor(pos / 1000) AS BIGINT) AS batch_id FROM s")
def q_fixed_batches(spark, sf):
    return B.fixed_batches(_docs(spark, sf), batch_size=1000)


EPOCHS = ("SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || CAST(epoch AS VARCHAR) || ':' "
          "|| CAST(doc_id AS VARCHAR)), doc_id) - 1 AS epos, count(*) OVER (PARTITION BY epoch) AS n "
          "FROM documents, (SELECT unnest([1, 2]) AS epoch)")
EPOCH_BATCHES = ("SELECT epoch, doc_id, epos, CAST(floor(epos / 4) AS BIGINT) AS batch FROM e "
                 "WHERE floor(epos / 4) < floor(n / 4)")


@query("epoch_batches", cte(e=EPOCHS) + EPOCH_BATCHES)
def q_epoch_batches(spark, sf):
    return B.epoch_batches(_docs(spark, sf), epochs=2, batch_size=4)


@query("accumulation_steps", cte(e=EPOCHS, b=EPOCH_BATCHES,
                                 nb="SELECT epoch, count(DISTINCT batch) AS nb FROM b GROUP BY epoch",
                                 tot="SELECT sum(floor(nb / 8)) AS total FROM nb")
       + """SELECT DISTINCT b.epoch, b.batch,
  CASE WHEN b.batch < floor(nb.nb / 8) * 8 THEN CAST((b.epoch - 1) * floor(nb.nb / 8) + floor(b.batch / 8) AS BIGINT) END AS opt_step,
  CAST((SELECT total FROM tot) AS BIGINT) AS total_steps, CAST(floor((SELECT total FROM tot) * 0.05) AS BIGINT) AS warmup_steps
FROM b JOIN nb ON b.epoch = nb.epoch""")
def q_accumulation_steps(spark, sf):
    return B.accumulation_steps(B.epoch_batches(_docs(spark, sf), epochs=2, batch_size=4))


# ---- corpus generation -----------------------------------------------------------------

def _duck_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hash_pick_sql(name: str, n_expr: str, seed: int = 42) -> str:
    return (f"(CAST(('0x' || substr(md5('{seed}:{name}:' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % ({n_expr}))")


_TPL = C.standard_templates()
_TPL_SQL = "[" + ", ".join("[" + ", ".join(_duck_str(t) for t in row) + "]" for row in _TPL) + "]"
_SIZES_SQL = "[" + ", ".join(str(len(r)) for r in _TPL) + "]"
STANDARD_SQL = (f"SELECT event_id AS trace_id, 'standard' AS kind, {_TPL_SQL}[tool + 1][({_hash_pick_sql('choice', 'sz')}) + 1] "
                f"AS text FROM (SELECT event_id, tool, {_SIZES_SQL}[tool + 1] AS sz FROM "
                f"(SELECT event_id, {_hash_pick_sql('tool', str(len(_TPL)))} AS tool FROM events))")


@query("gen_standard_traces", STANDARD_SQL)
def q_gen_standard_traces(spark, sf):
    return C.gen_standard_traces(table(spark, sf, "events"), id_col="event_id")


@query("gen_parallel_traces", f"SELECT event_id AS trace_id, 'parallel' AS kind, {_duck_str(C.parallel_template())} AS text FROM events")
def q_gen_parallel_traces(spark, sf):
    return C.gen_parallel_traces(table(spark, sf, "events"), id_col="event_id")


@query("gen_recovery_traces", f"SELECT event_id AS trace_id, 'recovery' AS kind, {_duck_str(C.recovery_template())} AS text FROM events")
def q_gen_recovery_traces(spark, sf):
    return C.gen_recovery_traces(table(spark, sf, "events"), id_col="event_id")


@query("union_traces", f"SELECT trace_id * 3 AS trace_id, kind, text FROM ({STANDARD_SQL}) UNION ALL "
                       f"SELECT event_id * 3 + 1, 'parallel', {_duck_str(C.parallel_template())} FROM events WHERE event_id % 2 = 0 "
                       f"UNION ALL SELECT event_id * 3 + 2, 'recovery', {_duck_str(C.recovery_template())} FROM events "
                       "WHERE event_id % 2 = 1")
def q_union_traces(spark, sf):
    ev = table(spark, sf, "events")
    std = C.gen_standard_traces(ev, id_col="event_id").withColumn("trace_id", F.col("trace_id") * 3)
    par = C.gen_parallel_traces(ev.where("event_id % 2 = 0"), id_col="event_id").withColumn(
        "trace_id", F.col("trace_id") * 3 + 1)
    rec = C.gen_recovery_traces(ev.where("event_id % 2 = 1"), id_col="event_id").withColumn(
        "trace_id", F.col("trace_id") * 3 + 2)
    return C.union_traces(std, par, rec)


_STRUCT_SQL = "[" + ", ".join("[" + ", ".join(map(str, t)) + "]" for t in C.structured_templates()) + "]"


@query("gen_structured_token_rows",
       f"SELECT idx, list_transform(range(512), lambda p: CAST(least(CASE WHEN tpl[(p % len(tpl)) + 1] < 30000 "
       f"THEN tpl[(p % len(tpl)) + 1] + (idx * 7) % 500 ELSE tpl[(p % len(tpl)) + 1] END, 31999) AS INT)) AS input_ids "
       f"FROM (SELECT event_id AS idx, {_STRUCT_SQL}[event_id % 4 + 1] AS tpl FROM events)")
def q_gen_structured_token_rows(spark, sf):
    return C.gen_structured_token_rows(table(spark, sf, "events"), id_col="event_id")


_PLANT = " ".join(f"WHEN {p} THEN {t}" for p, t in C.RANDOM_PLANTED.items())


@query("gen_random_token_rows",
       f"SELECT event_id AS idx, list_transform(range(512), lambda p: CAST(CASE p {_PLANT} ELSE 4 + "
       f"(((event_id % {C.MOD}) * 40503 + p * 2654435761 + 12345) % {C.MOD}) % 31996 END AS INT)) AS input_ids FROM events")
def q_gen_random_token_rows(spark, sf):
    return C.gen_random_token_rows(table(spark, sf, "events"), id_col="event_id")
