"""Behaviour of the reference kept (or deliberately changed) -- golden unit tests."""

import json
import re

from pyspark.sql import functions as F

from tracelake.functions.jsonx import strict_valid
from tracelake.operators import audit as A
from tracelake.operators import extract as X
from tracelake.operators import score as S
from tracelake.operators import windows as W
from tracelake.operators.segment import segment_events
from tracelake.operators.sql import sql_select
from tracelake.operators.udf import ToolRegistry, apply_tools, infer_schema


CS, CE = "<|tool_call_start|>", "<|tool_call_end|>"


def _outs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "out_id long, text string")


def test_extract_non_greedy_trim_and_order(spark):
    t = f'x{CS}  {{"name": "a", "arguments": {{"p": 1}}}}\n{CE} y {CS}{{"name": "b"}}{CE}'
    rows = X.extract_tool_calls(_outs(spark, t)).orderBy("pos").collect()
    assert [(r.name, r.arguments, r.parse_ok) for r in rows] == [("a", '{"p":1}', True), ("b", "{}", True)]
    assert rows[0].raw == '{"name": "a", "arguments": {"p": 1}}'


def test_malformed_call_recovers_name_or_is_dropped(spark):
    t = f'{CS}{{"name": "fix_me", "arguments": {{{CE}{CS}garbage{CE}{CS}[1]{CE}'
    rows = X.recover_malformed_calls(_outs(spark, t)).orderBy("pos").collect()
    assert [(r.status, r.recovered_name, r.kept) for r in rows] == [
        ("recovered", "fix_me", True), ("unparseable", None, False), ("non_object", None, False)]
    calls = X.extract_tool_calls(_outs(spark, t)).collect()
    assert [(c.name, c.arguments, c.parse_ok) for c in calls] == [("fix_me", "{}", False)]


def test_strict_json_rejects_what_python_rejects(spark):
    cases = ['{"a": 1}', '{"a": 1} x', '{"a": 1}, {"b": 2}', '1]', '[1]', '', '  {"a": [1, 2]}  ', '{"a": 1,}']
    df = spark.createDataFrame([(c,) for c in cases], "s string").select("s", strict_valid("s").alias("ok"))
    got = {r.s: r.ok for r in df.collect()}

    def py_ok(s):
        try:
            json.loads(s)
            return True
        except ValueError:
            return False
    assert got == {c: py_ok(c) for c in cases}


def test_raw_fallback_stops_at_first_brace(spark):
    t = 'Result {"name": "a"} and {"name": "x", "arguments": {"k": 1}}'
    rows = X.raw_json_fallback(_outs(spark, t)).orderBy("pos").collect()
    assert [r.raw for r in rows] == ['{"name": "a"}', '{"name": "x", "arguments": {"k": 1}']
    assert [r.parse_ok for r in rows] == [True, False]


def test_final_answer_and_clean(spark):
    t = "<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>assistant\n  the answer <|im_end|>"
    assert X.final_answer(_outs(spark, t)).first().answer == "the answer"
    g = spark.createDataFrame([("P:", f"P:done{CE} tail<|im_end|> more")], "prompt string, full_text string")
    r = X.clean_outputs(g, stop_at_call=True).first()
    assert r.completion == f"done{CE}" and r.content == f"done{CE}"


def test_segment_events_text_joined_marker_removed(spark):
    t = ("Hi<|thought_start|>plan<|thought_end|>there"
         f'{CS}{{"name": "t", "arguments": {{}}}}{CE}bye<|im_end|>')
    for fn in (segment_events,):
        rows = fn(_outs(spark, t)).orderBy("phase", "seq").collect()
        assert [(r.type, r.content, r.tool_name) for r in rows] == [
            ("text", "Hi", None), ("thought", "plan", None), ("text", "there", None), ("text", "bye", None),
            ("tool_call", None, "t")]


def test_topk_keeps_ties(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])],
                               "grp long, cand long, score double")
    assert W.topk_ties(df, k=2).count() == 4
    assert W.topk_ties(df, k=0).count() == 5
    assert W.topk_ties(df, k=99).count() == 5
    probs = W.topk_softmax(df, k=1, temperature=0).where("prob > 0").collect()
    assert [r.cand for r in probs] == [0]


def test_score_rules(spark):
    cases = spark.createDataFrame([
        (1, [("a", "{}")], False), (2, [("a", '{"x":1}'), ("b", "{}")], True), (3, [("a", "{}"), ("b", "{}")], True)],
        "case_id long, expected array<struct<name: string, arguments: string>>, is_list boolean")
    ans = spark.createDataFrame([
        (1, f'{CS}{{"name": "b"}}{CE}{CS}{{"name": "a", "arguments": {{}}}}{CE}'),    # first call decides
        (2, f'{CS}{{"name": "b", "arguments": {{}}}}{CE}{CS}{{"name": "a", "arguments": {{"x": 1.0}}}}{CE}'),
        (3, f'{CS}{{"name": "a", "arguments": {{}}}}{CE}')],                            # fewer than expected
        "case_id long, text string")
    got = {r.case_id: (r.json_valid, r.name_match, r.args_match)
           for r in S.score_outputs(ans, cases).collect()}
    assert got == {1: (True, False, False), 2: (True, True, True), 3: (True, False, False)}


def test_macro_average_recomputes_published_literals(spark):
    # category literals of the published tables: the macro averages come back
    cat = spark.createDataFrame([("base", c, 50, j, n, a) for c, j, n, a in [
        ("simple", 98.0, 94.0, 92.0), ("multiple", 96.0, 90.0, 86.0), ("parallel", 86.0, 78.0, 74.0),
        ("abstain", 100.0, 92.0, 92.0), ("recovery", 92.0, 84.0, 80.0)]],
        "model string, category string, n_cases long, json_valid double, name_match double, args_match double")
    r = S.macro_average(cat).first()
    assert (r.macro_json_valid, r.macro_name_match, r.macro_args_match) == (94.4, 87.6, 84.8)
    lb = S.leaderboard(S.macro_average(cat), spark.createDataFrame(
        [("base", 245924864, True)], "model string, parameters long, native_tool_grammar boolean")).first()
    assert (lb.params, lb.tool_grammar) == ("246M", "Native")


def test_empty_allow_list_allows_everything(spark):
    calls = spark.createDataFrame([(1, "rm -rf x"), (2, "  git status"), (3, "")], "call_id long, command string")
    none = spark.createDataFrame([], "cmd string")
    assert all(r.allowed for r in A.audit_commands(calls, none).collect())
    got = {r.call_id: (r.cmd_root, r.allowed) for r in
           A.audit_commands(calls, spark.createDataFrame([("git",)], "cmd string")).collect()}
    assert got == {1: ("rm", False), 2: ("git", True), 3: ("", False)}


def test_path_sandbox(spark):
    df = spark.createDataFrame([(1, "sub/a.txt"), (2, "../../etc/passwd"), (3, "../ws2/x"), (4, "a/../b")],
                               "call_id long, path string")
    got = {r.call_id: (r.resolved, r.escapes, r.prefix_escapes) for r in A.audit_path_escapes(df, "/ws").collect()}
    assert got == {1: ("/ws/sub/a.txt", False, False), 2: ("/etc/passwd", True, True),
                   3: ("/ws2/x", True, False), 4: ("/ws/b", False, False)}


def test_best_so_far_is_strict_and_skips_nan(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (1, 3, float("nan")), (1, 4, 2.0)],
                               "run_id long, step long, loss double")
    assert [r.is_best for r in W.best_so_far(df).orderBy("step").collect()] == [True, False, False, True]
    assert W.checkpoint_best(df).first().best_step == 4
    assert W.eval_mean_loss(df).first().mean_loss == round((3 + 3 + 2) / 3, 6)


def test_schema_inference_and_tool_execution(spark):
    def weather(city: str, days: int = 5) -> str:
        """Forecast.

        More text."""
        return f"{city}:{days}"
    s = infer_schema(weather)
    assert s["description"] == "Forecast."
    assert s["inputSchema"] == {"type": "object", "required": ["city"], "properties": {
        "city": {"type": "string"}, "days": {"type": "integer", "default": 5}}}
    reg = ToolRegistry()
    reg.tool(weather)

    @reg.tool(name="add", description="Add.")
    def add_numbers(a: float, b: int) -> float:
        return a + b
    calls = spark.createDataFrame([(1, "weather", '{"city": "Pune"}'), (2, "add", '{"a": 1.5, "b": 2}'),
                                   (3, "add", '{"a": 1}'), (4, "nope", "{}")], "out_id long, name string, arguments string")
    got = {r.out_id: (r.status, r.result) for r in apply_tools(calls, reg).collect()}
    assert got[1] == ("success", '"Pune:5"') and got[2] == ("success", "3.5")
    assert got[3][0] == "error" and got[4][0] == "error"


def test_sql_select_envelope(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    r = sql_select(spark, " select * from users order by id", {"users": df})
    assert r.status == "success" and r.row_count == 2 and [x.name for x in r.rows.collect()] == ["a", "b"]
    assert sql_select(spark, "DELETE FROM users", {"users": df}).status == "error"
    assert sql_select(spark, "WITH x AS (SELECT 1 AS id) INSERT INTO users SELECT id FROM x", {"users": df}).status == "error"
    assert sql_select(spark, "SELECT raise_error('boom') AS x", {"users": df}).status == "error"
    assert sql_select(spark, "SELECT nope FROM users", {"users": df}).status == "error"


def test_extraction_differential_against_python(spark):
    """extract_tool_calls equals a few-line Python re/json model on seeded random strings."""
    import random
    rng = random.Random(7)
    atoms = ["a", " ", "\n", "{", "}", '"', ":", ",", "1", '"name"', '"x"', CS, CE, "[", "]", "<|im_end|>"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [f'{CS}{{"name": "n{i}", "arguments": {{"k": {i}}}}}{CE}' for i in range(20)]

    def model(t):
        out = []
        for raw in re.findall(r"<\|tool_call_start\|>(.*?)<\|tool_call_end\|>", t, re.DOTALL):
            raw = raw.strip()
            try:
                d = json.loads(raw)
            except ValueError:
                m = re.search(r'"name":\s*"([^"]+)"', raw)
                if m:
                    out.append(m.group(1))
                continue
            if isinstance(d, dict):
                out.append(str(d.get("name", "")) if d.get("name", "") is not None else None)
        return out
    rows = X.extract_tool_calls(_outs(spark, *texts)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.out_id, r.pos)):
        got.setdefault(r.out_id, []).append(r.name)
    for i, t in enumerate(texts):
        assert got.get(i, []) == model(t), t


def test_unicode_white_space_and_typed_rejection(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from tracelake.operators.extract import parse_structured, usage_counts
    text = "a\u00a0b\u2003c\u3000d"
    r = usage_counts(spark.createDataFrame([(text, "x y")], "prompt string, completion string")).first()
    assert (r.prompt_tokens, r.completion_tokens, r.total_tokens) == (len(text.split()), 2, 6)
    schema = StructType([StructField("name", StringType()), StructField("n", LongType())])
    rows = [(1, '{"name":"a","n":5}'), (2, '{"name":"a","n":"xx"}'), (3, '{"name":null,"n":5}'), (4, '{"name":"a","n":null}'), (5, '{"n":5}')]
    df = spark.createDataFrame(rows, "out_id long, text string")
    assert {r.out_id: r.valid for r in parse_structured(df, schema, ["name"]).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_request_bodies_follow_content_length(spark):
    from tracelake.operators.rpc import json_dead_letter, request_bodies
    post = "POST /v1/chat/completions HTTP/1.1\r\n"
    rows = [(1, post + 'Content-Length: 8\r\n\r\n{"a": 1}GET / HTTP/1.1'), (2, post + 'X-Content-Length: 3\r\nCONTENT-LENGTH:\t2 \r\nHost: h\r\n\r\n{}'),
            (3, post + "Host: h\r\n\r\n{}"), (4, post + 'Content-Length: 20\r\n\r\n{"a": 1'), (5, post + "Content-Length: x\r\n\r\n{}"),
            (6, post + 'Content-Length: 4\r\n\r\n"é"'), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "id long, request string")
    got = {r.id: (r.body, r.valid) for r in json_dead_letter(request_bodies(df)).collect()}
    assert got[1] == ('{"a": 1}', True) and got[2] == ("{}", True) and got[3] == ("", False) and got[4] == ('{"a": 1', False)
    assert got[5] == ("", False) and got[6] == ('"é"', True) and got[7][0] is None and got[8] == ("", False)
