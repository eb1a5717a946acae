"""Cases at the edge of the operators: small ranges, several blocks, null ids, clashing names, empty tables."""

import re

import numpy as np

from tests.llm.test_operators import corpus, docs, frame  # noqa: F401  (fixtures)


def test_mixing_over_many_ranges(spark, monkeypatch):
    """Running sums and the cut cross ranges of a few rows; rows without an id lie all over the positions."""
    from tracelake.llm import mixing
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rng = np.random.default_rng(1)
    rows = [(int(i) if i % 3 else None, " ".join(["w"] * int(rng.integers(1, 30))), "abcd"[int(rng.integers(0, 4))], i % 7) for i in range(400)]
    df = frame(spark, rows, "doc_id long, text string, source string, _h int")
    got = mixing.mix(df).collect()
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    taken = {s: sum(r.taken for r in got if r.source == s) for s in size}
    target = {r.source: r.target for r in got}
    assert sum(target.values()) <= 1.5 * sum(size.values()) + 1e-6
    assert all(r.source_size == size[r.source] and r.copies in (0, 1, 2) for r in got) and len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_shares_the_copies_of_equal_rows(spark):
    from tracelake.llm import mixing
    rows = [(1, "a b c", "x", str(i)) for i in range(9)] + [(2, "d e", "y", "z"), (3, None, "y", "z"), (4, "", None, "z")]
    df = frame(spark, rows, "doc_id long, text string, source string, tag string")
    want = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mixing.mix_documents(df).collect():
        got.setdefault(r.doc_id, []).append(r.tag)
    assert {i: len(t) for i, t in got.items()} == {i: n for i, n in want.items() if n}
    assert max(got[1].count(str(i)) for i in range(9)) <= 2
    # a table too large for a broadcast gives the same
    assert mixing.mix_documents(df).count() == sum(want.values())


def test_embedding_dedup_with_null_ids(spark):
    from tracelake.llm.embeddup import near_duplicates
    rows = [(None, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (7, [0.99, 0.01, 0.0, 0.0]), (None, [0.0, 1.0, 0.0, 0.0]), (None, None)]
    got = sorted(map(str, (tuple(r) for r in near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>")).collect())))
    assert got == sorted(map(str, [(None, 2, 5, False), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, False), (None, 0, None, False)]))


def test_learned_ann_over_several_blocks_and_odd_rows(spark):
    from tracelake.llm.learnedann import search
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.3 * rng.normal(size=12)).tolist()) for i in range(600)]
    rows += [(20, rows[20][1]), (None, rows[40][1]), (601, [float("inf")] * 12), (602, [None] * 12), (603, [0.0] * 12), (640, [1.0, 2.0])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), k=10, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert not {601, 602, 603, 640} & set(got)
    hit = asked = 0
    good = [(i, np.array(v)) for i, v in rows if i is None or i <= 600]
    for q in range(40, 600, 20):
        mine = np.array(rows[q][1])
        true = sorted(((-float(mine @ v), i is None, i) for i, v in good if i != q), key=lambda x: (x[0], x[1], x[2] or 0))[:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        hit += len({i for _, _, i in true} & {i for _, i, _ in found})
        asked += 10
    assert hit >= 0.9 * asked


def test_packing_with_clashing_columns(spark):
    from tracelake.llm.packing import pack
    df = frame(spark, [(1, "a b c", 5, 6, "x"), (None, None, 1, 2, "y"), (2, "", 0, 0, "z")],
               "doc_id long, text string, length int, start int, ids string")
    rows = pack(df, max_len=4).collect()
    assert {r.doc_id for r in rows} == {1, 2, None} and all(r.length & (r.length - 1) == 0 for r in rows)


def test_pipeline_stages_on_empty_tables_and_without_n_chars(spark, docs, tmp_path):  # noqa: F811
    import corpus_pipeline as P
    frame(spark, [(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = docs.select("doc_id", "text", "source")
    for table in (d.limit(0), d):
        now = table
        for name, one in P.STAGES:
            out = one(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{'full' if table is d else 'empty'}")
            out = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}-{'full' if table is d else 'empty'}")
            if name != "packing":
                assert out.columns == d.columns
            assert (out.count() > 0) == (table is d)
            now = out


def test_a_stage_deletes_only_tables_that_nothing_reads(spark, tmp_path):
    from tracelake.llm.common import drop_tables, materialise, scratch
    paths: list[str] = []
    with scratch(paths):
        a, b = materialise(spark.range(3).toDF("a"), "one"), materialise(spark.range(4).toDF("a"), "two")
    assert len(paths) == 2
    used = b.where("a > 0").withColumn("c", b["a"] + 1)
    drop_tables(spark, paths, used)
    assert len(paths) == 1 and re.search("two-", paths[0]) and used.count() == 3
    drop_tables(spark, paths)
    assert paths == []


def test_line_dedup_rows_without_an_id(spark):
    from tracelake.llm.linededup import drop_lines
    same = "shared notice of the site goes here"
    rows = [(None, f"{same}\nown words number {w} stand alone {w}") for w in ("apple", "berry", "cedar", "delta")]
    rows += [(-(1 << 62), "nothing shared in this one at all"), (None, None), (None, "")]
    got = sorted(str(r.text) for r in drop_lines(frame(spark, rows, "doc_id long, text string")).collect())
    assert sum(same in t for t in got) == 0 and len(got) == len(rows)
    assert "nothing shared in this one at all" in got


def test_lines_of_many_documents_at_once_equal_those_of_each():
    import random

    import numpy as np
    import pyarrow as pa

    from tracelake.llm.bytewords import text_chunks
    from tracelake.llm.linededup import chunk_lines, line_table

    rng = random.Random(1)
    texts = [None, "", "\n", "a b c", "a b c\n", "\na b 1c d", " x\n\n", None]
    texts += ["".join(rng.choice("ab1 \n\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    want = []
    for k, t in enumerate(texts):
        _, leaf, whole, _, n = line_table(t or "", 3, 3)
        want += [(k, *x) for x in zip(leaf.tolist(), whole.tolist(), n.tolist())]
    for size in (500_000, 90):
        got, content = [], {}
        for lo, data, bounds in text_chunks(pa.array(texts, pa.string()), size):
            doc, leaf, whole, n, c = chunk_lines(data, bounds, 3, 3)
            got += zip((lo + doc).tolist(), leaf.tolist(), whole.tolist(), n.tolist())
            content |= dict(zip((lo + doc).tolist(), c.tolist()))
        assert got == want and want
        words = {k: tuple(texts[k].split()) for k in content}
        assert len(set(content.values())) == len(set(words.values()))
    assert not len(chunk_lines(np.zeros(0, np.uint8), np.zeros(3, np.int64), 3, 3)[0])


def python_steps(plan):
    """Python steps that one task of a physical plan's last stage runs at once, and the most that any of its stages runs."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.initialPlan()
    below = [python_steps(plan.children().apply(i)) for i in range(plan.children().size())]
    here = [now for now, _ in below]
    now = 0 if "Exchange" in plan.nodeName() else max(here, default=0) if plan.nodeName() == "Union" else sum(here)
    now += plan.nodeName() == "MapInArrow"
    return now, max([now, *(most for _, most in below)])


def test_no_task_of_the_pipeline_holds_two_python_workers(spark, docs, tmp_path, monkeypatch):  # noqa: F811
    from pyspark.sql.readwriter import DataFrameWriter

    import corpus_pipeline as P
    frame(spark, [(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    steps, write = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        steps[path.rsplit("/", 1)[-1]] = python_steps(self._df._jdf.queryExecution().executedPlan())[1]
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    P.run(spark, str(tmp_path))
    assert {name: n for name, n in steps.items() if n > 1} == {}
    assert sum(steps.values()) > len(P.STAGES)  # the plans were read


def test_shuffle_files_go_with_the_query_that_wrote_them(spark):
    import os
    import time

    from pyspark.sql import functions as F

    from tracelake.llm.common import materialise
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    conf, before = spark.conf.get(key), files()
    df = spark.range(5000).repartition(3, "id").withColumn("k", F.col("id") % 7).groupBy("k").count()
    out = materialise(df.join(df.toDF("k", "n"), "k"), "sums")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert files() - before == set() and spark.conf.get(key) == conf
    assert sorted(tuple(r) for r in out.collect()) == [(k, n, n) for k, n in enumerate([715, 715, 714, 714, 714, 714, 714])]
    assert df.count() == 7 and df.collect() and df.collect()  # outside of it shuffles stay


def test_near_duplicates_deletes_tables_that_nothing_reads_again(spark, docs):  # noqa: F811
    from tracelake.llm.common import drop_tables, scratch
    from tracelake.llm.jaccard import jaccard_links
    paths: list[str] = []
    with scratch(paths):
        documents, links, classes = jaccard_links(docs, 3, 80, 100)
    left = {p.rsplit("/", 1)[-1].split("-")[0] for p in paths}
    assert left & {"signatures", "wanted", "sets", "near"} == set() and {"members", "classes", "links"} <= left
    assert documents.count() and classes.count() and links.count()
    drop_tables(spark, paths)
