"""Plan shape: native operators stay JVM-side, never funnel through one partition,
and prune / push down into the Parquet scan."""

import pytest

import __spark_entry__ as E

NATIVE = ["leaderboard", "extract_tool_calls", "segment_events", "shape_completion", "tool_call_counts", "resolve_tool",
          "validate_args", "rpc_correlate", "score_outputs", "category_scores", "topk_ties", "best_so_far",
          "cap_turns", "detect_recovery", "context_budget", "bpe_word_counts", "pack_sequences", "dir_inventory",
          "render_chatml", "infer_arg_schema", "budget_cutoff"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_single_partition_and_no_python(spark, sf, name):
    p = plan(E.queries()[name](spark, sf))
    assert "SinglePartition" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonMapInArrow" not in p


def test_column_pruning_reaches_scan(spark, sf):
    p = plan(E.queries()["extract_tool_calls"](spark, sf))
    schema = p[p.index("ReadSchema"):].split("\n")[0]
    assert "value" not in schema and "event_type" in schema


def test_filter_pushdown_reaches_scan(spark, sf):
    p = plan(E.queries()["rpc_correlate"](spark, sf))
    assert "PushedFilters" in p


def test_softmax_over_whole_groups_holds_no_group_in_a_window(spark, sf):
    from tracelake.plans import QUERIES
    plan = QUERIES["topk_softmax_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "partial_max" in plan and "partial_sum" in plan
