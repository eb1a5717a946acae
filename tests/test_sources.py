"""Rows-only sources and sinks: file text scan, nested results JSON, JSONL failure modes."""

import json
import os
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import score as S
from tracelake.sources.files import find_files, glob_to_regex, scan_files_text, search_files
from tracelake.sources.jsonl import scan_jsonl_text
from tracelake.streaming.runner import scratch


def test_scan_files_text_replaces_bad_utf8_and_caps(spark):
    root = scratch(spark, "files-test")
    root = root[len("file:"):] if root.startswith("file:") else root  # local files for this test
    os.makedirs(os.path.join(root, "sub"))
    with open(os.path.join(root, "a.txt"), "wb") as f:
        f.write(b"ok \xff\xfe end")
    with open(os.path.join(root, "sub", "big.txt"), "w") as f:
        f.write("x" * 70000)
    with open(os.path.join(root, "skip.bin"), "wb") as f:
        f.write(b"zz")
    got = {os.path.basename(r.path): r for r in scan_files_text(spark, root, glob="*.txt").collect()}
    assert set(got) == {"a.txt", "big.txt"}
    assert got["a.txt"].text == "ok \ufffd\ufffd end"
    assert len(got["big.txt"].text) == 70000 and got["big.txt"].length == 70000
    cut = {os.path.basename(r.path): r for r in scan_files_text(spark, root, glob="*.txt", max_chars=65536).collect()}
    assert len(cut["big.txt"].text) == 65536 and cut["big.txt"].truncated and not cut["a.txt"].truncated


def local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_one_file_read_by_many_tasks_equals_pythons_reading(spark):
    root = local(scratch(spark, "ranges-test"))
    os.makedirs(root)
    rng = random.Random(7)
    bits = [b"\n", b"\r\n", b"\r", "\u00e9".encode(), "\U0001f600".encode(), b"\xff", b"\xe2\x82", b"word ", b"", b"\x00"]
    bodies = [b"", b"\n", b"\r", b"a", b"a\r\n", b"a\r", b"\r\n\r\n", b"x" * 5000, b"tail\xe2"]
    bodies += [b"".join(rng.choice(bits) for _ in range(rng.randint(0, 3000))) for _ in range(8)]
    for i, body in enumerate(bodies):
        with open(f"{root}/f{i}.txt", "wb") as f:
            f.write(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = scan_files_text(spark, root, piece_bytes=200).collect()
        cuts = {n: scan_files_text(spark, root, max_chars=n, piece_bytes=200).collect() for n in (1, 1000)}
        assert spark.read.option("lineSep", "\n").text(root).rdd.getNumPartitions() > len(bodies)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for i, body in enumerate(bodies):
        with open(f"{root}/f{i}.txt", encoding="utf-8", errors="replace") as f:
            want = f.read()
        own = sorted((r.block, r.piece, r.start, r.text) for r in rows if r.path.endswith(f"/f{i}.txt"))
        assert "".join(x[3] for x in own) == want, body
        assert [x[2] for x in own] == [sum(len(y[3]) for y in own[:k]) for k in range(len(own))]
        for n, cut in cuts.items():
            r, = [r for r in cut if r.path.endswith(f"/f{i}.txt")]
            assert r.text == want[:n] and r.truncated == (len(want) > n) and r.length == len(body)
    assert len({r.block for r in rows if r.length > 4000}) > 2


NAMES = ["a", "b", "ab", "a.b", "A", "[", "]", "!", "^", "-", "a-b", "[a]", "x{1}", "\u00e9", "a b", ".hid", "\\"]


def test_globs_equal_pathlib_on_random_patterns(spark):
    root = local(scratch(spark, "glob-test"))
    rng = random.Random(11)
    for _ in range(60):
        folder = os.path.join(root, *rng.choices(NAMES, k=rng.randint(0, 3)))
        try:
            os.makedirs(folder, exist_ok=True)
            open(os.path.join(folder, rng.choice(NAMES)), "x").close()
        except OSError:  # a file of that name is there
            pass
    base = pathlib.Path(root)
    files = [str(p.relative_to(base)) for p in base.rglob("*") if p.is_file()]
    bits = ["*", "?", "a", "b", "[ab]", "[!a]", "[a-c]", "[c-a]", "[]a]", "[!]]", "[", "]", "[^a]", "-", "[a-]", "[-a]", "**", ".", "{", "\\", "A", "[!"]
    patterns = {"/".join("".join(rng.choices(bits, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(400)}
    patterns |= {"**", "**/*", "a/**", "**/a/**/b", "./a", "a/", "*/", "[a", "x{1}", "a b", "\u00e9"}
    for p in sorted(patterns):
        try:
            found = base.glob(p) if p.startswith("**") else base.rglob(p)
            want = sorted({str(x.relative_to(base)) for x in found if x.is_file()})
        except (ValueError, NotImplementedError):
            continue
        assert sorted(f for f in files if re.search(java(glob_to_regex(p)), f)) == want, p
    df = spark.createDataFrame([(f,) for f in files], "path string")
    for p in ["*", "[!a]*", "**/a*", "a/*", "[[]", "?", "[a-c]", "**", "x{1}", "[^a]", "*.b"]:
        found = base.glob(p) if p.startswith("**") else base.rglob(p)
        want = sorted(str(x.relative_to(base)) for x in found if x.is_file())
        assert sorted(r.path for r in search_files(df, p).collect()) == want, p
        assert sorted(r.path for r in find_files(spark, root, p).collect()) == sorted(
            x for x in want if not any(y.startswith((".", "_")) for y in x.split("/"))), p


def java(regex: str) -> str:
    """The same pattern for Python's ``re``."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", regex)


def test_results_document_round_trips_as_json(spark):
    cat = spark.createDataFrame([("m", "simple", 50, 98.0, 94.0, 92.0), ("m", "parallel", 50, 86.0, 78.0, 74.0)],
                                "model string, category string, n_cases long, json_valid double, "
                                "name_match double, args_match double")
    models = spark.createDataFrame([("m", 245924864, True)], "model string, parameters long, native_tool_grammar boolean")
    doc = S.results_document(cat, S.macro_average(cat), models, "bench", test_case_count=100)
    out = scratch(spark, "results")
    S.sink_results_json(doc, out)
    r = S.read_results_json(spark, out).first()
    m = r.models["m"]
    assert (r.benchmark, r.test_case_count, r.categories) == ("bench", 100, ["parallel", "simple"])
    assert m.parameters == 245924864 and m.native_tool_grammar and m.overall_args_exact_match == 83.0
    assert m.scores["simple"].tool_match == 94.0
    # a second publication replaces the first in one step; files no manifest names are not read
    S.sink_results_json(doc.withColumn("benchmark", F.lit("again")), out)
    doc.withColumn("benchmark", F.lit("dead writer")).write.json(out + "/v-lost")
    assert [x.benchmark for x in S.read_results_json(spark, out).collect()] == ["again"]
    out = local(out)
    assert not [f for f in os.listdir(out) if f.startswith("CURRENT-")]
    # a lost file is noticed
    version = json.load(open(out + "/CURRENT"))
    os.remove(os.path.join(out, version["version"], version["files"][0][0]))
    with pytest.raises(ValueError):
        S.read_results_json(spark, "file:" + out)


def test_jsonl_failfast_and_permissive(spark):
    path = scratch(spark, "jsonl-bad")
    spark.createDataFrame([('{"text": "a"}',), ("",), ("{not json",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        scan_jsonl_text(spark, path).collect()
    rows = scan_jsonl_text(spark, path, mode="PERMISSIVE").collect()
    assert [r.text for r in rows if r._corrupt_record is None] == ["a"]


def test_glob_regex():
    import re
    rx = re.compile(glob_to_regex("*.py"))
    assert rx.match("src/a.py") and rx.match("a.py") and not rx.match("a.pyc")
    assert re.compile(glob_to_regex("**/x/*.md")).match("a/b/x/r.md")
