"""Hard negatives, personal data and lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import hardneg, lexical, pii

# ---- hard negatives ---------------------------------------------------------------------


def brute_negatives(rows, every=50, positives=5, negatives=3):
    kept = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, label, [math.floor(256 * x) for x in v]))
    last = lambda i: (i is None, i)
    out = []
    for a_id, a_label, a in kept:
        if a_id is None or a_id % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), i, lab) for i, lab, b in kept if i != a_id and len(b) == len(a)]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for ps, p_id, _ in [x for x in scored if x[2] == a_label][:positives]:
            window = [x for x in scored if x[2] != a_label and 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(a_id, p_id, n + 1, i, ps, s) for n, (s, i, _) in enumerate(window)]
    return sorted(out, key=str)


VECTORS = "vec_id long, label int, embedding array<float>, place string"


def negatives(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    return sorted((tuple(r) for r in hardneg.mine(df, **how).collect()), key=str)


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    rows = []
    for i in range(400):
        v = centres[i % 6] + 0.3 * rng.normal(size=5)
        rows.append((i, int(i * 7 % 4), [float(np.float32(x)) for x in v]))
    rows += [(400 + i, 1, rows[3][2]) for i in range(60)]  # a group of copies
    rows += [(None, 2, rows[50][2]), (None, 0, rows[50][2]), (7, 3, None), (8, None, rows[0][2]), (9, 1, [1.0, None, 0.0, 0.0, 0.0]),
             (10, 1, [float("nan")] * 5), (11, 1, [float("inf")] * 5), (450, 1, [1.0, 2.0]), (451, 1, [1.0, 1.5]), (452, 2, [0.5, 0.5]),
             (500, 1, [0.0] * 5), (550, 1, []), (551, 1, []), (50, 0, rows[50][2]), (100, int(100 * 7 % 4), rows[100][2])]
    expect = brute_negatives(rows)
    assert expect and negatives(spark, rows, block_rows=16, anchor_rows=16) == expect
    assert negatives(spark, rows) == expect  # one block


def test_hard_negatives_of_few_or_no_rows(spark):
    assert negatives(spark, []) == []
    assert negatives(spark, [(50, 1, [1.0])]) == []
    rows = [(50, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [0.4, 0.0]), (4, 2, [0.5, 0.0])]
    assert negatives(spark, rows) == brute_negatives(rows)


def test_hilbert_curve_steps_to_a_neighbour():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hardneg.hilbert(side, 3)
    assert sorted(place) == list(range(512))
    walk = side[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_zone_maps_exclude_blocks_of_other_clusters(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1000):
        v = np.zeros(8)
        v[i % 8] = 1
        rows.append((i, int(i % 3), (v + 0.02 * rng.normal(size=8)).tolist()))
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    blocks = hardneg.write_blocks(hardneg.quantised(df), 32)
    anchors = hardneg.anchors_of(blocks, 50, 5, 32)

    def wants(r, upper, lower, labels):
        return upper >= np.frombuffer(r["floors"], np.int64)[:, None]

    read = hardneg._routes(blocks, anchors, wants).select(F.sum(F.length("at") / 4)).first()[0]
    assert read < 0.4 * 20 * blocks.count()
    assert negatives(spark, rows, block_rows=32, anchor_rows=32) == brute_negatives(rows)


# ---- personal data ----------------------------------------------------------------------

FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    out = []
    for kind, form in FORMS:
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(x // 10 + x % 10 for x in twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def spell(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_base_spans_equal_the_forms():
    rng = np.random.default_rng(1)
    pieces = ["a", "b.c", "@", "@x.yz", ".", "..", "1", "25", "256", "999", "+", "+1", " ", "-", "(", ")", "é", "%", "4111111111111111",
              "4111 1111 1111 1111", "00", "1.2.3.4", "a@b.c", "555-0100", "\n", "😀", "0" * 30]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(1, 25)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == brute_base(text), text


def test_base_spans_of_long_runs_take_linear_time():
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1((" * 100_000, "@" * 400_000, "a@" * 200_000, "1 " * 200_000):
        pii.base_spans(run)
        pii._others(run, [])


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, spans string, n_ip int")
    return {r.doc_id: r for r in pii.find(df).collect()}


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    texts = [(i, f"note {i}. Please call me at +1 (20{i}) 555-01{i}{i} today") for i in range(5)]
    texts += [(10, "Please call me at 555-0147 today"), (11, "we sold 555-0199 units of it"), (12, "clean text of 2021, room 12"),
              (13, "numbers 4111111111111111 5500005555555559 side by side"), (14, "card 5500005555555559 alone"),
              (15, "one@example.com"), (16, "ask one@example.com or two (at) example (dot) org")]
    got = found(spark, texts)
    for i, t in texts:
        base = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(spell(base).encode()).hexdigest()
        assert set(filter(None, spell(base).split(","))) <= set(got[i].spans.split(","))
    t = dict(texts)
    assert got[10].spans == f"phone:{t[10].index('555')}:{t[10].index(' today')}" and got[10].n_added == 1 and got[10].n_phone == 0
    assert got[11].n_added == 0 and got[12].spans == "" and got[12].n_added == 0
    s = t[13].index("5500")
    assert f"card:{s}:{s + 16}" in got[13].spans  # a seed elsewhere, passed over by the form here
    assert got[14].n_card == 1 and got[14].n_added == 0


def test_strings_of_no_kind_need_stronger_patterns(spark):
    few = [(i, f"{i} text, my mail is user{i}@example.com thanks") for i in range(3)]
    many = [(100 + i, f"{i} text, reach us under +1 (3{i:02d}) 555-0{i:03d} always") for i in range(20)]
    texts = few + many + [(50, "x my mail is KD-48213 thanks"), (51, "x reach us under KD-48213 always"), (52, "y KD-99120 of stock"),
                          (53, "z reach us under monday always")]
    got = found(spark, texts)
    t = dict(texts)
    assert got[51].spans == f"phone:{t[51].index('KD')}:{t[51].index(' always')}"
    assert got[50].n_added == 1  # the same value elsewhere
    assert got[52].n_added == 0 and got[53].n_added == 0
    alone = found(spark, few + [(50, "x my mail is KD-48213 thanks")])
    assert alone[50].n_added == 0


def test_pii_edge_cases(spark):
    long = "word " * 100_000 + "a@b.cd"
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x a@b.cd"), (3, long), (3, long), (3, "1.2.3.4")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in pii.find(df).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    mail = hashlib.sha256(b"email:500000:500006").hexdigest()
    assert rows == sorted([
        (1, 0, 0, 0, 0, empty, "", 0), (2, 0, 0, 0, 0, empty, "", 0),
        (None, 1, 0, 0, 0, hashlib.sha256(b"email:2:8").hexdigest(), "email:2:8", 0),
        (3, 1, 0, 0, 0, mail, "email:500000:500006", 0), (3, 1, 0, 0, 0, mail, "email:500000:500006", 0),
        (3, 0, 1, 0, 0, hashlib.sha256(b"ip:0:7").hexdigest(), "ip:0:7", 0)], key=str)
    assert pii.find(df.limit(0)).collect() == []


# ---- lexical search ---------------------------------------------------------------------


def brute_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(cut(t))
    out = []
    for item, words in own.items():
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // total
            s = 0
            for w in words & b.keys():
                df = sum(w in x for _, x in bags)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * b[w] // (1000 * b[w] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=str if False else lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_entries", [200_000, 4])
def test_search_against_brute_force(spark, max_entries):
    rng = np.random.default_rng(3)
    words = ["the", "The", "cat", "Öl", "öl", "x1", "é", "dog", "re-do", "a_b", " ", "of", "zebra"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 12)))) for i in rng.permutation(120)]
    docs += [(500 + i, "zebra the cat") for i in range(30)] + [(None, "zebra the cat"), (None, "cat"), (3, "cat"), (3, "cat"), (600, None),
                                                             (601, ""), (602, " -- "), (603, "dog " * 5000), (604, "zebra cat, THE")]
    items = [(1, "The zebra"), (2, "öl Öl x1"), (3, "unknown"), (None, "cat cat dog"), (4, None), (5, ""), (2, "é"), (6, "a_b of")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    q = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, score double")
    got = sorted((tuple(r) for r in lexical.search(d, q, k=7, max_entries=max_entries).collect()), key=str)
    assert got == brute_search(docs, items, 7)
    assert lexical.search(d.limit(0), q).collect() == [] and lexical.search(d, q.limit(0)).collect() == []
