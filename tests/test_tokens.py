"""BPE: round trip, exact training against a brute-force sequential BPE, token rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tracelake.operators import tokens as T
from tracelake.operators.bpe import Merger, merge_ranks, merge_word, run_phase
from tracelake.sources.tables import table

VALIDATION = ("<|im_start|>user\nCan you inspect config.yaml?<|im_end|>\n"
              "<|im_start|>assistant\n"
              "<|thought_start|>Checking file.<|thought_end|>\n"
              "<|tool_call_start|>{\"name\": \"local_filesystem_read\"}<|tool_call_end|><|im_end|>")


def brute_force_bpe(word_counts: dict[str, int], n: int):
    words = {tuple(f"{b:02X}" for b in w.encode()): c for w, c in word_counts.items()}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for syms, c in words.items():
            for a, b in zip(syms, syms[1:]):
                pairs[(a, b)] += c
        if not pairs:
            break
        (a, b), c = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        merges.append((a, b, c))
        nxt = Counter()
        for syms, cnt in words.items():
            out, i = [], 0
            while i < len(syms):
                if i < len(syms) - 1 and syms[i] == a and syms[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            nxt[tuple(out)] += cnt
        words = nxt
    return merges


def learned(wc, n, **bounds):
    return [(r.left, r.right, r["count"]) for r in T.bpe_train(wc, n, **bounds).orderBy("rank").collect()]


def test_training_equals_sequential_bpe_until_no_pair_is_left(spark):
    rng = random.Random(1)
    counts = {"".join(rng.choice("aabbc") for _ in range(rng.randint(1, 9))): rng.randint(1, 400) for _ in range(150)}
    counts |= {"aaaaaaaaaaaaaaaa": 7, "é😀": 30, "a": 5}
    wc = spark.createDataFrame(list(counts.items()), "word string, count long")
    expect = brute_force_bpe(counts, 10_000)
    assert len(expect) > 150
    assert learned(wc, 10_000) == expect                                                     # one phase
    assert learned(wc, 10_000, top_pairs=200, max_fragments=60, reach=3.0)[:120] == expect[:120]  # many phases
    assert learned(wc, 25, top_pairs=3, max_fragments=4) == expect[:25]                      # ties beyond the lists


def test_phases_equal_sequential_bpe_on_documents(spark, sf):
    wc = T.bpe_word_counts(table(spark, sf, "documents").limit(60)).persist()
    expect = brute_force_bpe({r.word: r["count"] for r in wc.collect()}, 150)
    assert learned(wc, 150, top_pairs=300, max_fragments=400, reach=4.0) == expect


@pytest.mark.parametrize("seed", range(6))
def test_run_phase_takes_only_what_cuts_cannot_change(seed):
    """The stop rule on random word tables, without Spark: any set of frequent pairs gives a prefix."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 12))): rng.randint(1, 60) for _ in range(80)}
    expect = brute_force_bpe(counts, 400)
    pairs = Counter()
    for w, c in counts.items():
        for a, b in zip(w.encode(), w.encode()[1:]):
            pairs[a, b] += c
    for rest in sorted(set(pairs.values()))[::2]:
        taken = {p for p, c in pairs.items() if c > rest}
        below = max((c for p, c in pairs.items() if p not in taken), default=0)
        frag = Counter()
        for w, c in counts.items():
            part = [w.encode()[0]]
            for a, b in zip(w.encode(), w.encode()[1:]):
                if (a, b) in taken:
                    part.append(b)
                else:
                    frag[tuple(part)] += c
                    part = [b]
            frag[tuple(part)] += c
        names = [f"{b:02X}" for b in range(256)]
        got = run_phase([(list(f), c) for f, c in frag.items()], taken, below, names, {s: i for i, s in enumerate(names)}, 10_000)
        named = [(names[a], names[b], c) for a, b, c in got]
        assert named == expect[:len(named)] and (below or len(named) == min(400, len(expect)) or len(named) > 400)


def test_merge_word_equals_one_merge_at_a_time():
    rng = random.Random(3)
    for _ in range(200):
        names = list("abc")
        merges = []
        for _ in range(12):
            l, r = rng.choice(names), rng.choice(names)
            merges.append((l, r))
            if l + r not in names:
                names.append(l + r)
        ids = {s: i for i, s in enumerate(names)}
        word = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        want = list(word)
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(want, want[1:])) if p in merges]
            if not found:
                break
            _, i = min(found)
            want[i:i + 2] = [want[i] + want[i + 1]]
        got = merge_word([ids[x] for x in word], merge_ranks([(ids[l], ids[r], 0) for l, r in merges]), [ids[l + r] for l, r in merges])
        assert [names[i] for i in got] == want


@pytest.mark.parametrize("replay", [False, True])
def test_words_merged_together_equal_one_by_one(replay):
    """Random merges, with pairs and symbols made several times and runs of one symbol."""
    rng = random.Random(4)
    for _ in range(150):
        names = list("abc")
        pairs = []
        for _ in range(12):
            pairs.append((rng.choice(names), rng.choice(names)))
            if "".join(pairs[-1]) not in names:
                names.append("".join(pairs[-1]))
        ids = {s: i for i, s in enumerate(names)}
        merges, made = [(ids[a], ids[b], 0) for a, b in pairs], [ids[a + b] for a, b in pairs]
        words = [[rng.randrange(3) for _ in range(rng.randint(0, 15))] for _ in range(30)]
        flat, lengths = Merger(merges, made, replay).merge(np.array([x for w in words for x in w]), np.array([len(w) for w in words]))
        want = [merge_word(w, merge_ranks(merges), made, replay) for w in words]
        assert flat.tolist() == [x for w in want for x in w] and lengths.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("reach", [1.1, 2.0, 1e9])
def test_run_phase_lists_places_in_levels(reach):
    rng = random.Random(8)
    counts = {"".join(rng.choice("aab") for _ in range(rng.randint(2, 14))): rng.randint(1, 900) for _ in range(120)}
    names = [f"{b:02X}" for b in range(256)]
    got = run_phase([(list(w.encode()), c) for w, c in counts.items()], set(), 0, names, {s: i for i, s in enumerate(names)}, 10_000, reach)
    assert [(names[a], names[b], c) for a, b, c in got] == brute_force_bpe(counts, 10_000)


def test_words_of_random_syllables_train_in_few_phases(spark, monkeypatch):
    """More fragments than fit at half the highest count: a phase takes fewer pairs, not one merge at a time."""
    from tracelake.operators import bpe

    rng = random.Random(11)
    syllables = ["".join(rng.choice("abcdefgh") for _ in range(2)) for _ in range(24)]
    counts = {"".join(rng.choice(syllables) for _ in range(rng.randint(3, 6))): rng.randint(1, 9) for _ in range(3000)}
    phases = []
    apply = bpe.apply_merges
    monkeypatch.setattr(bpe, "apply_merges", lambda words, batch, made: phases.append(len(batch)) or apply(words, batch, made))
    wc = spark.createDataFrame(list(counts.items()), "word string, count long")
    assert learned(wc, 40, max_fragments=300) == brute_force_bpe(counts, 40)
    assert len(phases) <= 8, phases


def test_long_words_merge_in_short_time(spark):
    merges = learned(spark.createDataFrame([("ab" * 50 + "c", 3)], "word string, count long"), 100)
    enc = T._encoder([(a, b) for a, b, _ in merges])
    assert len(enc("ab" * 200_000)) < 8000


def test_decode_replaces_broken_utf8(spark):
    merges = spark.createDataFrame([], "rank int, left string, right string, count long")
    rows = spark.createDataFrame([(1, [T.BYTE_BASE + 0xC3, T.BYTE_BASE + 65]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in T.bpe_decode(rows, T.vocab(merges)).collect()} == {1: "\ufffdA", 2: "", 3: ""}


def test_roundtrip_with_control_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(30)
    merges = T.bpe_train(T.bpe_word_counts(docs), 30)
    extra = spark.createDataFrame([(-1, VALIDATION), (-2, ""), (-3, "  two  spaces\n\n and\ttabs  ")],
                                  "doc_id long, text string")
    rt = T.bpe_roundtrip(docs.unionByName(extra), merges)
    assert rt.where("NOT ok").count() == 0
    enc = {r.doc_id: r.ids for r in T.bpe_encode(extra, merges).collect()}
    assert enc[-1][0] == 4 and 5 in enc[-1] and 8 in enc[-1]  # control tokens stay atomic ids


def test_words_of_a_batch_are_encoded_together():
    """``bpe_encode`` merges the new words of a batch by one call, with the ids that each has alone."""
    rng = random.Random(9)
    words = {"".join(rng.choice("abcd é") for _ in range(rng.randint(1, 12))).encode() for _ in range(400)}
    merges = [(a, b) for a, b, _ in brute_force_bpe({w.decode(): rng.randint(1, 50) for w in words}, 150)]
    alone, flat = T._encoder(merges), np.frombuffer(b"".join(words), np.uint8).astype(np.int32) + T.BYTE_BASE
    ids, lengths = T._merger(merges).merge(flat, np.array([len(w) for w in words]))
    assert ids.tolist() == [i for w in words for i in alone(w)] and lengths.tolist() == [len(alone(w)) for w in words]


def test_token_rows_invariants(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, list(range(20, 40))), (3, [9, 0, 9])], "idx long, input_ids array<int>")
    rows = {r.idx: r for r in T.build_token_rows(df, max_length=8).collect()}
    assert all(len(r.input_ids) == 8 and len(r.labels) == 8 for r in rows.values())
    assert sum(rows[1].attention_mask) == 3 and rows[1].labels[3:] == [-100] * 5
    assert sum(rows[2].attention_mask) == 8
    assert rows[3].labels[:3] == [9, -100, 9]  # a real pad id is ignored too
    sp = {r.idx: (r.tokens, r.targets) for r in T.shift_pairs(T.build_token_rows(df, max_length=8)).collect()}
    assert sp[1] == ([5, 6], [6, 7]) and sp[3] == ([0], [9])


def test_pack_sequences_keeps_order_and_drops_remainder(spark):
    df = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 5))) for i in range(7)], "idx long, input_ids array<int>")
    packed = T.pack_sequences(df, 4, n_buckets=1).orderBy("window").collect()
    flat = [t for r in packed for t in r.input_ids]
    allt = [t for i in range(7) for t in range(i * 10, i * 10 + 5)]
    assert len(packed) == 35 // 4 and flat == allt[:len(flat)]
    kept = T.pack_sequences(df, 4, n_buckets=1, drop_last=False).orderBy("window").collect()
    assert [t for r in kept for t in r.input_ids] == allt and [len(r.input_ids) for r in kept] == [4] * 8 + [3]


def test_encode_keeps_every_row_and_decodes_back(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(40)
    extra = spark.createDataFrame([(-1, VALIDATION), (-2, ""), (-3, None), (-4, "ab"), (-4, "ab")], "doc_id long, text string")
    d = docs.unionByName(extra)
    merges = T.bpe_train(T.bpe_word_counts(docs), 20)
    enc = T.bpe_encode(d, merges)
    rows = {r.doc_id: r.ids for r in enc.collect()}
    assert enc.count() == 45 and rows[-2] == [] and rows[-3] == [] and rows[-4]
    back = {r.doc_id: r.text for r in T.bpe_decode(enc, T.vocab(merges)).collect()}
    want = {r.doc_id: r.text or "" for r in d.collect()}
    assert back == want
    ok = T.bpe_roundtrip(d, merges).collect()
    assert len(ok) == 45 and all(r.ok for r in ok)


def test_pretokens_in_numpy_equal_the_pattern(spark):
    """Words of every text as the JVM's regex finds them, whichever chunks and groups the texts fall into."""
    import pyarrow as pa

    from tracelake.operators.pretokens import char_classes, encoded_words

    rng = random.Random(5)
    bits = ["'", "'s", "'re", "s", "t", "r", "e", "ll", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "é", "日", "1",
            "½", "!", "\U0001f600", "<|", "<|pad|>", "<|im_end|>", "|>", "́", "\U00010400", "​"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = Counter()
    for r in T.text_pieces(df, "t", "i").withColumn("w", T.pretokens("piece")).collect():
        want.update((r.i, w) for w in (r.w if r.special_id is None else [r.piece]))
    for size in (1 << 18, 50):
        got = Counter()
        for words, at, row, _ in encoded_words(pa.array(texts, pa.string()), char_classes(spark, T.WS), size, 2 * size):
            got.update((r, words[a].decode()) for a, r in zip(at.tolist(), row.tolist()))
        assert got == want
    counts = [sorted(map(tuple, T.bpe_word_counts(df, "t", arrow=arrow).collect())) for arrow in (False, True)]
    assert counts[0] == counts[1] and counts[0]
