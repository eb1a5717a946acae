"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, n string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, "en", r.choice(["a", "b", None, "c"]), len(t), "x", "y"))
        if i % 4 == 0:  # near and exact copies
            w = t.split()
            if len(w) > 30:
                w[7] = "changed"
            rows.append((100 + i, " ".join(w).upper() if i % 8 else t, "en", "a", None, "x", "y"))
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "b", 0, "x", "y"), (902, " \n\t ", "en", "b", 0, "x", "y"),
             (903, "one two", "en", "c", 0, "x", "y"), (904, "one  two", "en", "c", 0, "x", "y"), (None, "w1 w2 w3 w4", "en", "c", 0, "x", "y"),
             (905, "big " * 30_000, "en", "a", 0, "x", "y"), (905, "big " * 30_000, "en", "a", 0, "x", "y"),
             (906, "it's ÀÉ ₤ 12 <|endoftext|> don't x", "en", "b", 0, "x", "y")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus, DOCS)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    from tracelake.llm.wordids import default_path
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, corpus, encode):
    from tracelake.llm.packing import binary_lengths, pack
    rows = pack(docs, max_len=256).collect()
    assert sum(binary_lengths(1000, 256)) == 1000 and binary_lengths(0, 8) == []
    want = sorted((str(r[0]), len(encode(r[1])) + 1) for r in corpus)
    starts = sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0)
    assert starts == want
    text = {r[0]: r[1] for r in corpus}
    for r in rows:
        ids = (encode(text[r.doc_id]) + [1])[r.start:r.start + r.length]
        assert r.ids_crc32 == crc(ids) and r.length & (r.length - 1) == 0 and r.offset == 0 and r.length <= 256
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert pack(docs.limit(0)).count() == 0


def test_word_ids_of_a_full_table(encode):
    """One chunk of more pieces than the table's limit, some of them known, keeps every id."""
    from tracelake.llm.wordids import WordIds, default_path
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    known = WordIds(default_path(), limit=50)
    for text in (" ".join(words[:30]), " ".join(words), " ".join(words[150:] + ["x1 it's"]), "", " ".join(words[::-1])):
        assert known.encode(text).tolist() == encode(text)


def test_token_files(spark, docs, corpus, encode):
    from tracelake.llm.tokenfile import Block, read_tokens, token_files
    path, manifest = token_files(docs, block_ids=500)
    got = read_tokens(spark, path).orderBy("start").collect()
    order = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at = 0
    for r, row in zip(got, order):
        ids = encode(row[1]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert manifest.agg({"ids": "sum"}).first()[0] == at
    path, _ = token_files(docs.limit(0))
    assert read_tokens(spark, path).count() == 0

    ids = np.array([1, 2, 3, 1, 2, 3, 9, 9, 9, 9, 9] * 40, np.uint32)
    b = Block.unpack(Block.build([5, None], np.concatenate([ids, ids[:3]]), np.array([0, len(ids), len(ids) + 3])).pack())
    assert len(b.left) and len(b.symbols) < len(ids) / 4
    assert b.document(0).tolist() == ids.tolist() and b.slice(0, 17, 61).tolist() == ids[17:61].tolist()


def test_token_files_of_many_shards_are_decoded_by_many_tasks(spark, docs, corpus, encode):
    from pyspark.sql import functions as F

    from tracelake.llm.tokenfile import read_tokens, token_files
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path, manifest = token_files(docs, block_ids=500)
        shards = manifest.count()
        got = read_tokens(spark, path)
        parts = got.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards >= 3 and parts >= 2
    rows = got.orderBy("start").collect()
    assert len(rows) == len(corpus)
    at = 0
    for r in rows:  # gapless over the borders of files, ids ascending, null last
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    want = sorted((str(r[0]), len(encode(r[1])) + 1, crc([*encode(r[1]), 2])) for r in corpus)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want



def test_warc(spark):
    from tracelake.llm.warc import archive, read_warc
    big = "é" * 80
    pages = [(5, "http://a\r\nb", big, 1), (3, None, big, 1), (9, "u", big, 1), (9, "u", big, 1), (1, "u", "small", 1), (2, "u", "small", 1),
             (4, "u", None, 1), (None, "u", big, 1), (6, "u", "x" * 100_000, 1)]
    df = frame(spark, pages, "page_id long, url string, html string, digest int")
    path, manifest = archive(df, roll_bytes=400)
    rows = read_warc(spark, path).collect()
    assert manifest.count() > 2 and len(rows) == len(pages)
    want = []
    for i, _, h, _ in pages:
        p = (h or "").encode()
        revisit = len(p) >= 100 and h == big and i != 3
        want.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {big, "small", "", "x" * 100_000}
    assert read_warc(spark, archive(df.limit(0))[0]).count() == 0


def test_mixing(docs, corpus):
    from tracelake.llm.mixing import mix, mix_documents
    rows = mix(docs).collect()
    size = {}
    for r in corpus:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * size[s] <= level * weight[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= full
    taken = {}
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    longest = max(r.size for r in rows)
    assert len(rows) == len(corpus) and all(abs(taken[s] - target[s]) <= 2 * longest for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))
    assert mix_documents(docs).count() == sum(r.copies for r in rows)
    assert mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard(docs, corpus, n, num):
    from tracelake.llm.jaccard import jaccard_components
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs, n, num, 100).collect())
    sets = []
    for r in corpus:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = {r[0]: r[0] for r in corpus}
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                x, y = corpus[i][0], corpus[j][0]
                if a and x is not None and y is not None and 100 * len(a & b) >= num * len(a | b):
                    comp[x] = comp[y] = min(comp[x], comp[y])
    want = sorted((str(r[0]), len(s), str(comp[r[0]])) for r, s in zip(corpus, sets))
    assert got == want
    assert jaccard_components(docs.limit(0), n, num, 100).count() == 0


@pytest.mark.parametrize("spread,leaf", [(4, 16), (30, 16), (200, 8)])
def test_voronoi_pairs_lose_no_pair_and_read_few(spread, leaf):
    from tracelake.llm.jaccard import _possible, bits_apart, sketch, voronoi_pairs
    rng = np.random.default_rng(spread)
    sets = []
    for _ in range(12):  # groups of near copies of a base, of many sizes
        base = rng.integers(0, 1 << 63, int(rng.integers(30, 400))).astype(np.uint64) * np.uint64(2)
        for _ in range(int(rng.integers(1, 60))):
            x = base.copy()
            k = int(rng.integers(0, min(spread, len(x))))
            x[rng.integers(0, len(x), k)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
            sets.append(np.unique(x))
    vec = np.frombuffer(b"".join(map(sketch, sets)), np.uint64).reshape(len(sets), -1)
    n = np.array([len(x) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    low = bits_apart(vec[i], vec[j])
    for num, den in ((90, 100), (80, 100)):
        ok = _possible(n[i], n[j], low, num, den)
        want = set(zip(i[ok].tolist(), j[ok].tolist()))
        asked = [0]

        def wanted(a, b):
            asked[0] += len(a)
            return np.ones(len(a), bool)

        got = [(min(p), max(p)) for a, b in voronoi_pairs(vec, n, wanted, num, den, leaf) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
        linked = [(a, b) for a, b in zip(i.tolist(), j.tolist())
                  if den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))]
        assert set(linked) <= want and all(low[k] <= len(np.setxor1d(sets[i[k]], sets[j[k]])) for k in range(0, len(i), 97))
        assert asked[0] < 0.5 * len(i)


def test_jaccard_of_a_large_group_of_near_copies_in_blocks(spark):
    """Copies that link with their base alone, which has neither the smallest id nor the smallest class; blocks of a region meet."""
    from tracelake.llm.jaccard import jaccard_components, jaccard_links
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choice(base) for _ in range(60))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = t.split()
        return {tuple(w[k:k + 3]) for k in range(len(w) - 2)}

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])]
    for _ in range(5):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    for how in ({}, {"block": 20, "leaf": 8}):
        got = {r.doc_id: r.component_id for r in jaccard_components(df, 3, 90, 100, **how).collect()}
        assert got == comp and len({got[i] for i in range(150)}) == 1
    _, links, _ = jaccard_links(df, 3, 90, 100)
    assert links.count() <= 3 * len(rows)


def test_line_dedup(spark):
    from tracelake.llm.linededup import drop_lines
    r = random.Random(1)
    own = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12))
    rows = [(i, "\n".join([own(), "posted by user%d on day %d at noon sharp" % (i * 7, i), own(), "all rights are reserved here", "", "ok"]), "k")
            for i in range(8)]
    copy = "\n".join(own() for _ in range(6))
    rows += [(20 + i, copy, "k") for i in range(5)] + [(30, None, "k"), (31, "", "k"), (None, "a b c d e", "k"), (40, "z " * 50_000, "k")]
    got = {x.doc_id: x for x in drop_lines(frame(spark, rows, "doc_id long, text string, leaf string")).collect()}
    for i in range(8):
        assert got[i].dropped == [1, 3] and got[i].text.split("\n") == [p for k, p in enumerate(rows[i][1].split("\n")) if k not in (1, 3)]
    assert all(got[20 + i].text == copy for i in range(5)) and got[30].text is None and got[31].text == ""
    assert got[40].text == "z " * 50_000 and got[0].leaf == "k"
    assert drop_lines(frame(spark, rows, "doc_id long, text string, leaf string").limit(0)).count() == 0


def test_line_dedup_word_fields(spark):
    """Fields of words that many documents hold are fields on a large table as on a small one."""
    from tracelake.llm.linededup import drop_lines
    r = random.Random(5)
    own = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12))
    names, cities, days = (["".join(r.choice("klmnop") for _ in range(6)) for _ in range(n)] for n in (4, 40, 7))
    combos = [(a, b, c) for a in names for b in cities for c in days]
    for size in (60, 600):
        rows = [(i, "\n".join([own(), "posted by %s in %s on %s" % x, own()])) for i, x in enumerate(r.sample(combos, size))]
        # one document's many lines are one vote
        rows.append((5000, "\n".join([own()] + ["posted by %s in %s on %s" % (names[0], cities[0], own()[:7]) for _ in range(300)])))
        got = {x.doc_id: x.dropped for x in drop_lines(frame(spark, rows, "doc_id long, text string")).collect()}
        assert all(got[i] == [1] for i in range(size)) and got[5000] == list(range(1, 301))


def test_line_dedup_short_pages(spark):
    """Every different document counts, however much of it recurs; equal texts count once."""
    from tracelake.llm.linededup import drop_lines
    r = random.Random(6)
    own = lambda n=12: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    notice, passage, copied = "\n".join([own(20), own(20)]), own(40), own(40)
    rows = [(i, own(6) + "\n" + notice) for i in range(50)]
    rows += [(100 + i, "\n".join([own(90), passage])) for i in range(2)] + [(102, own(4) + "\n" + passage)]
    rows += [(200 + i, own(4) + "\n" + copied) for i in range(2)] + [(210 + i, "x y z\n" + copied + "\n" * i) for i in range(1)] * 4
    rows += [(300 + i, "\n".join(["one whole copy here", notice.split("\n")[0]])) for i in range(4)]
    held = own(30)
    rows += [(400 + i, "text of copies\n" + held + " " * i) for i in range(5)] + [(410, own(9) + "\n" + held)]
    got = {x.doc_id: x.dropped for x in drop_lines(frame(spark, rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [1, 2] for i in range(50)) and all(got[100 + i] == [1] for i in range(3))
    assert got[200] == got[201] == got[210] == [1]
    assert all(got[300 + i] == [1] for i in range(4))
    assert all(got[400 + i] == [] for i in range(5)) and got[410] == []


def test_embedding_dedup(spark):
    from tracelake.llm.embeddup import near_duplicates
    r = np.random.RandomState(0)
    x = r.standard_normal((60, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(100 + i, (v + 0.18 * r.standard_normal(16)).tolist(), 1) for i, v in enumerate(x[:30])]
    rows += [(200, (x[3] * 5).tolist(), 1), (201, x[3].tolist(), 1), (201, x[3].tolist(), 1), (300, None, 1), (301, [0.0] * 16, 1),
             (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, c int")
    got = sorted((q.vec_id, q.n_links, q.component_id, q.kept) for q in near_duplicates(df, 0.95, block_dims=4, block=7).collect())
    good = [(i, np.array(v)) for i, v, _ in rows[:93]]
    links = {(a, b) for a, (_, u) in enumerate(good) for b, (_, v) in enumerate(good)
             if a != b and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95}
    comp = list(range(len(rows)))
    comp = [rows[i][0] for i in comp]
    for _ in range(20):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = sorted((rows[i][0], sum(a == i for a, _ in links), comp[i], comp[i] == rows[i][0]) for i in range(len(rows)))
    assert got == want and len(links) > 20
    in_rounds = near_duplicates(df, 0.95, block_dims=4, block=7, share=4.0, least_bytes=1)
    assert sorted((q.vec_id, q.n_links, q.component_id, q.kept) for q in in_rounds.collect()) == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_writes_vectors_once(spark):
    """What stays on disk does not grow with the cells a vector goes to; a round's shuffle has a bound."""
    import os

    from tracelake.llm.common import scratch
    from tracelake.llm.embeddup import near_duplicates, rounds_of
    x = np.random.RandomState(1).standard_normal((2000, 64)).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    with scratch(written := []):
        assert near_duplicates(df).where("n_links = 0 and kept").count() == 2000
    size = sum(os.path.getsize(os.path.join(d, f)) for t in written for d, _, names in os.walk(t.removeprefix("file:")) for f in names)
    assert x.nbytes < size < 4 * x.nbytes
    cells = frame(spark, [(0, 30_000, 3), (1, 5, 1)], "p long, n long, m int")
    assert rounds_of(cells, 100, 1 << 30) == 1 and rounds_of(cells, 100, 900_000) == 11


def test_learned_ann(spark, sf):
    from tracelake.llm.learnedann import search
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for q in search(e, e.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    data = {q.vec_id: np.array(q.embedding, float) for q in e.collect()}
    hit = 0
    for i, found in got.items():
        true = sorted((-float(data[i] @ v), j) for j, v in data.items() if j != i)[:20]
        hit += len({j for _, j in true} & {j for j, _ in found})
        assert len(found) == 20 and all(abs(s - data[i] @ data[j]) < 1e-9 for j, s in found) and i not in dict(found)
    assert hit >= 0.9 * 20 * len(got) and len(got) == sum(i % 20 == 0 for i in data)
    few = frame(spark, [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (40, None, 1), (3, [0.0, 0.0], 1)],
                "vec_id long, embedding array<double>, rank int")
    rows = sorted((q.query_id, q.rank, q.vec_id, q.score) for q in search(few, few.where("vec_id % 20 = 0")).collect())
    assert rows == [(0, 1, 20, 1.0), (0, 2, 2, 0.0), (20, 1, 0, 1.0), (20, 2, 2, 0.0)]
    assert search(few.limit(0), few).count() == 0


def test_toxicity(spark):
    from tracelake.llm import toxicity as X
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        t = [r.choice(words) for _ in range(40)]
        if toxic:
            for k in (3, 9, 20):
                t[k] = "zork" + r.choice(words)
        rows.append((i, " ".join(t), 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, 1), (1001, "", 1), (None, "abc", 1), (1002, "abc " * 40_000, 1), (7, rows[7][1], 1)]
    labels += [(3000, 1, 1), (1001, None, None), (None, 1, 1)]
    docs, lab = frame(spark, rows, "doc_id long, text string, score int"), frame(spark, labels, "doc_id long, quality int, toxic int")
    model = X.train(docs, lab)
    got = X.score(docs, model).collect()
    held = [q for q in got if q.held_out and q.doc_id is not None and q.doc_id < 500]
    assert len(got) == len(rows) and all(0 <= q.score <= 1 and q.predicted == int(q.score >= 0.7) for q in got)
    assert all(q.held_out == (q.doc_id is not None and zlib.crc32(str(q.doc_id).encode()) % 3 == 1) for q in got)
    assert sum(q.predicted == int(q.doc_id % 5 == 0) for q in held) >= 0.95 * len(held)
    kept = X.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - q.predicted for q in got)
    none = X.train(docs, lab.limit(0))
    assert {q.score for q in X.score(docs, none).collect()} == {0.5}


def test_toxicity_curve_sample_after_the_cut(spark, monkeypatch):
    """The curve's sample is a share of the labelled rows that are kept."""
    from tracelake.llm import toxicity as X
    seen, fit = [], X.logistic
    monkeypatch.setattr(X, "logistic", lambda x, y: seen.append(len(y)) or fit(x, y))
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('w', id % 50, if(id % 2 = 0, ' bad', ' good')) as text")
    X.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2 = 0) as toxic"), max_labelled=500, max_curve=100)
    assert 70 <= seen[0] <= 140


def test_toxicity_keeps_all_grams(spark):
    """Word scores equal Kneser-Ney by hand over every gram, those counted once included."""
    import math
    from tracelake.llm import toxicity as X
    r = random.Random(3)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(200)]
    rows = [(i, " ".join(r.choice(words) + ("zq" if i % 3 == 0 and k == 0 else "") for k in range(9))) for i in range(200)]
    docs, lab = frame(spark, rows, "doc_id long, text string"), frame(spark, [(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    train = docs.where(~X.held_out()).selectExpr("text", "cast(doc_id % 3 = 0 as int) as toxic", "pmod(xxhash64(doc_id, 11), 5) = 0 as curve")
    raw, kn, total, prob = {}, {}, {}, {}
    for text, toxic in train.where("not curve").select("text", "toxic").collect():
        for w in text.split():
            for i in range(1, len(w) + 2):
                for j in range(max(0, i - 5), i + 1):
                    raw.setdefault(f"^{w}$"[j:i + 1], [0, 0])[toxic] += 1
    for g, ab in raw.items():
        kn[g] = ab if len(g) == 6 or g[0] == "^" else [sum(x[1:] == g and raw[x][k] > 0 for x in raw) for k in (0, 1)]
        kn[g] = [sum(kn[g])] * 2 if len(g) <= 2 else kn[g]
        t = total.setdefault(g[:-1], [0, 0, 0, 0])
        for k in (0, 1):
            t[k] += kn[g][k]
            t[2 + k] += kn[g][k] > 0
    back = {h: [0.75 * t[2 + k] / t[k] if t[k] else 1.0 for k in (0, 1)] for h, t in total.items()}
    for g in sorted(raw, key=len):
        t, low = total[g[:-1]], prob.get(g[1:], [1 / (sum(len(x) == 1 for x in raw) + 1)] * 2)
        prob[g] = [(max(kn[g][k] - 0.75, 0) / t[k] if t[k] else 0) + back[g[:-1]][k] * low[k] for k in (0, 1)]

    def score(w):
        s, out = f"^{w}$", 0.0
        for i in range(1, len(s)):
            for j in range(max(0, i - 5), i + 1):
                if s[j:i + 1] in prob:
                    out += math.log(prob[s[j:i + 1]][1] / prob[s[j:i + 1]][0])
                    break
                b = back.get(s[j:i], [1, 1])
                out += math.log(b[1] / b[0])
        return out

    model = X.train(docs, lab)
    probe = words + [w + "zq" for w in words[:50]] + ["xyz", "éa", "a" * 70]
    assert len(model.ratio[0]) == len(raw) and 1 in [sum(x) for x in raw.values()]
    for window in (1 << 17, 40):
        assert np.allclose(model.words(probe, window), [score(w) for w in probe], atol=1e-4)


def test_licenses(spark):
    from tracelake.llm.licenses import RULES, SENTENCES, scan
    rows = [(1, "Text. All rights reserved. More", 1), (2, None, 1), (3, "", 1), (4, "a\nReleased under  the MIT License.\nLICENSED under CC BY-NC 4.0.", 1),
            (5, "\n".join(SENTENCES[i] for i in ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names")), 1),
            (6, "\n".join(SENTENCES[i] for i in ("bsd-binary", "bsd-source", "bsd-redistribute")), 1), (6, "x " * 60_000, 1)]
    got = [(q.doc_id, q.licenses, q.first_sentence) for q in scan(frame(spark, rows, "doc_id long, text string, licenses int")).collect()]
    assert got == [(1, ["proprietary"], 1), (2, [], None), (3, [], None), (4, ["MIT", "CC-BY-NC-4.0"], 1), (5, ["BSD-3-Clause", "BSD-2-Clause"], 0),
                   (6, [], 0), (6, [], None)]
    assert {i for _, ids in RULES for i in ids} <= set(SENTENCES)


def test_a_dense_cell_of_vectors_is_joined_in_bounded_memory():
    """6,000 vectors of one direction: 18 million links counted without a list of pairs."""
    import tracemalloc

    from tracelake.llm.embeddup import _budgets, join_cell, rotation, split, unite
    rng = np.random.default_rng(1)
    n, width, threshold = 6000, 64, 0.95
    x = np.ones((n, width)) + 0.01 * rng.normal(size=(n, width))
    y = ((x / np.linalg.norm(x, axis=1)[:, None]) @ rotation(width)).astype(np.float32)
    parts = split(width, 16)
    budgets = _budgets(width, parts, threshold)
    wide = 2 * float(np.sqrt(budgets[0]))
    home = np.floor(y[:, :2].astype(np.float64) / wide).astype(np.int64)
    cell = home.max(0)
    count, label = np.zeros(n, np.int64), np.arange(n)
    tracemalloc.start()
    for i, j in join_cell(x, y, np.zeros(n, np.int64), False, 0, parts, budgets, threshold, cell, wide):
        assert len(i) <= 50_000
        np.add.at(count, i, 1)
        np.add.at(count, j, 1)
        label = unite(label, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    mine = (home == cell).all(1)  # pairs of points at home in smaller cells meet there
    assert count[mine].min() == n - 1 and label[mine].max() == 0 and peak < 150 << 20


def test_unite_keeps_the_smallest_root():
    from tracelake.llm.embeddup import unite
    rng = np.random.default_rng(2)
    label, comp = np.arange(300), list(range(300))
    for _ in range(8):
        i, j = rng.integers(0, 300, 30), rng.integers(0, 300, 30)
        label = unite(label, i, j)
        for a, b in zip(i.tolist(), j.tolist()):
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
        assert label.tolist() == comp


def test_licence_rules_against_brute_force(spark):
    """Random identifier sequences: a rule holds if its identifiers occur in order."""
    from tracelake.llm.licenses import PHRASES, RULES, SENTENCES, scan
    rng = random.Random(5)
    names = sorted(SENTENCES)
    seqs = [[rng.choice(names) for _ in range(rng.randint(0, 12))] for _ in range(150)]
    seqs += [list(ids) for _, ids in RULES] + [list(reversed(ids)) for _, ids in RULES]

    def text(seq):
        return "\n".join((SENTENCES[i] if i not in PHRASES else f"x {SENTENCES[i]} x.") + "\nfiller." for i in seq)

    def holds(ids, seq):
        at = iter(seq)
        return all(i in at for i in ids)

    rows = [(k, text(s)) for k, s in enumerate(seqs)]
    got = {r.doc_id: r for r in scan(frame(spark, rows, "doc_id long, text string")).collect()}
    for k, seq in enumerate(seqs):
        assert got[k].sentence_ids == seq
        assert got[k].licenses == list(dict.fromkeys(name for name, ids in RULES if holds(ids, seq)))


def test_licence_rules_are_linear_in_repeated_phrases(spark):
    import time

    from tracelake.llm.licenses import SENTENCES, scan
    one = " ".join(SENTENCES[i] for i in ("bsd-redistribute", "bsd-source", "bsd-redistribute"))
    rows = [(1, f"{one}\n" * 4000), (2, one)]
    df = frame(spark, rows, "doc_id long, text string")
    scan(df.where("doc_id = 2")).collect()
    t = time.time()
    got = {r.doc_id: r for r in scan(df).collect()}
    assert got[1].licenses == [] and len(got[1].sentence_ids) == 12_000 and time.time() - t < 20


def test_licenses_at_any_wrap(spark):
    """Licence texts unwrapped, wrapped at any column, and decorated."""
    import textwrap
    from tracelake.llm.licenses import scan
    texts = {
        "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
               'files (the "Software"), to deal in the Software without restriction, subject to the following conditions: The above copyright '
               'notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS '
               'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.',
        "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                      'License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                   "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                        "this list of conditions.",
        "CC-BY-4.0": "Some text. Licensed under CC BY 4.0. More text.",
    }
    rows, want = [], {}
    for name, t in texts.items():
        for form in (t, *(textwrap.fill(t, k) for k in (20, 61, 79)), textwrap.indent(textwrap.fill(t, 50), " * "), t.replace(" ", "\r\n")):
            want[len(rows)] = [name]
            rows.append((len(rows), form))
    more = {"#" * 200 + " MIT License\n" + texts["MIT"][:90] + "\nAll rights reserved of course": ["MIT"], "Not under the MIT License at all": [],
            "\n" * 100_000 + "Released under the MIT\n" + "\n" * 100_000 + "License.": ["MIT"], "not all rights reserved.": []}
    for t, names in more.items():
        want[len(rows)] = names
        rows.append((len(rows), t))
    got = {q.doc_id: q for q in scan(frame(spark, rows, "doc_id long, text string")).collect()}
    assert {i: q.licenses for i, q in got.items()} == want
    assert got[len(texts) * 6 + 2].first_sentence == 100_000 and got[0].first_sentence == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as P
    frame(spark, [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:4]:
        out = stage(spark, d, str(tmp_path))
        assert out.schema.names == d.schema.names, name
        if name == "near_duplicates":
            ids = [r.doc_id for r in out.collect()]
            assert ids.count(905) == 1 and 100 not in ids and 0 in ids and None in ids and 900 in ids
        d = out
    assert P.run(spark, str(tmp_path)).where("length & (length - 1) != 0").count() == 0
