"""Byte-level BPE as Spark jobs: word counts, training, encode, decode, token rows.

Pre-tokenization (JVM regex, GPT-2 style classes)
    The published pattern ends in ``\\s+(?!\\S)|\\s+``: a whitespace run that
    precedes a non-space gives up its last character to the next word.  RE2
    (DuckDB) has no look-ahead, so the boundary is marked instead: the last
    whitespace before a non-space gets a private-use mark (U+E000) in front of
    it; the split pattern never matches the mark, so ``\\s+`` stops there and the
    last space joins the following ``' ?\\p{L}+'`` word.  Same tokens, no
    look-ahead, identical in Spark and DuckDB.  Control tokens are split off
    first and stay atomic.  (Texts containing U+E000 itself are not supported.)

Symbols and ids
    A symbol is the hex of its bytes (``"48"``, ``"4865"``).  Ids: 0..13 the
    reserved control tokens, 14..269 the 256 bytes, then merged tokens in merge
    order (a token string made by two merges keeps its first id).  Reference
    ids past 13 cannot be reproduced (its vocabulary file is not shipped).

Training (``bpe_train``)
    One shuffle for the word counts, then phases on the distinct-word table, each taking as many
    merges as provably equal the sequential ones (``operators.bpe``); ties break by count desc, then
    pair asc.  The word table is written to the shared folder after every phase.

Encoding and decoding
    Arrow batches without a shuffle: words of a batch are dictionary-encoded and merged once each,
    ids and bytes are gathered by offsets.
"""

from __future__ import annotations

import unicodedata  # noqa: F401  (documented rule for the whitespace class)

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.markers import ANY_MARKER, PY_WHITESPACE, SPECIAL_TOKENS, java_quote
from tracelake.operators.bpe import Merger, merge_ranks, merge_word, train
from tracelake.operators.pretokens import SPLIT, char_classes, encoded_words

#: Unicode White_Space (Python ``isspace`` without the \\x1c-\\x1f separators)
WS_CHARS = "".join(c for c in PY_WHITESPACE if not 0x1C <= ord(c) <= 0x1F)
_WS_INNER = "".join(f"\\x{{{ord(c):X}}}" for c in WS_CHARS)
WS = f"[{_WS_INNER}]"
MARK = "\ue000"
#: marks the last whitespace before a non-space
MARK_PATTERN = f"({WS})([^{_WS_INNER}])"
#: GPT-2 pre-token classes over marked text (the mark itself is never matched) -- RE2 form
PRETOKEN = ("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^" + _WS_INNER + "\\p{L}\\p{N}\\x{E000}]+|" + WS + "+")
#: the same token classes with the published look-ahead (Java form, one regex pass);
#: equal to PRETOKEN over marked text -- the DuckDB oracle of bpe_word_counts checks it
PRETOKEN_LOOKAHEAD = ("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^" + _WS_INNER + "\\p{L}\\p{N}]+|"
                      + WS + "+(?![^" + _WS_INNER + "])|" + WS + "+")

N_SPECIAL = len(SPECIAL_TOKENS)
BYTE_BASE = N_SPECIAL
MERGE_BASE = N_SPECIAL + 256
BATCH_BYTES = 4 << 20
KNOWN_WORDS = 200_000


def pretokens(text, lookahead: bool = True) -> F.Column:
    """Array of pre-tokens of a text without control tokens.

    ``lookahead`` (default): one pass of the published pattern (Java regex);
    otherwise the mark + RE2-compatible form used by the SQL oracle."""
    t = F.col(text) if isinstance(text, str) else text
    if lookahead:
        return F.regexp_extract_all(t, F.lit(PRETOKEN_LOOKAHEAD), F.lit(0))
    marked = F.regexp_replace(t, F.lit(MARK_PATTERN), F.lit(MARK + "$1$2"))
    return F.regexp_extract_all(marked, F.lit(PRETOKEN), F.lit(0))


def text_pieces(df: DataFrame, text: str, key: str) -> DataFrame:
    """``key, pi, piece, special_id`` -- control tokens split off (atomic)."""
    parts = F.when(F.col(text).contains("<|"), F.split(
        F.regexp_replace(F.col(text), F.lit(ANY_MARKER), F.lit(SPLIT + "$1" + SPLIT)), java_quote(SPLIT), -1)
    ).otherwise(F.array(F.col(text)))
    p = df.select(key, F.posexplode(parts).alias("pi", "piece")).where(F.col("piece") != "")
    sid = F.array_position(F.array(*[F.lit(t) for t in SPECIAL_TOKENS]), F.col("piece")) - 1
    return p.withColumn("special_id", F.when(sid >= 0, sid.cast("int")))


def bpe_word_counts(df: DataFrame, text: str = "text", arrow: bool = False) -> DataFrame:
    """``word, count`` over the corpus (control tokens excluded); one partial +
    final hash aggregate, so a hot word costs one row per partition.  ``arrow``: the same rows, with the words of a
    task found and counted in numpy (``operators.pretokens``) instead of one row a word."""
    if not arrow:
        p = text_pieces(df.select(F.monotonically_increasing_id().alias("_k"), text), text, "_k")
        w = p.where(F.col("special_id").isNull()).select(F.explode(pretokens("piece")).alias("word"))
        return w.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(char_classes(df.sparkSession, WS))

    def count(batches):
        import pyarrow as pa

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()).cast(pa.string()),
                                              pa.array(list(sums.values()), pa.int64())], names=["word", "c"])

        classes, sums = shared.value, {}
        for b in batches:
            for words, at, _, special in encoded_words(b.column(0), classes):
                at = at if special is None else at[~special]
                for w, c in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                    if c:
                        sums[w] = sums.get(w, 0) + c
                if len(sums) > 200_000:
                    yield from rows()
                    sums.clear()
        yield from rows()

    words = df.select(F.col(text).cast("string")).mapInArrow(count, "word string, c long")
    return words.groupBy("word").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("count"))


# ---- training ------------------------------------------------------------------------

def bpe_train(word_counts: DataFrame, n_merges: int, top_pairs: int = 50_000, max_fragments: int = 1_000_000,
              reach: float = 32.0) -> DataFrame:
    """Learn up to ``n_merges`` merges: ``rank, left, right, count`` (symbols in hex), fewer if no pair is left.

    The phases are described in ``operators.bpe``; the parameters bound what a phase sends to the
    driver and change nothing in the result."""
    import pyarrow as pa

    def cut(batches):
        for b in batches:
            words = b.column(0).cast(pa.binary())
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
            data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            syms = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(data.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([syms, b.column(1)], names=["syms", "cnt"])

    words = word_counts.where(F.col("word").isNotNull()).select("word", F.col("count").cast("long"))
    merges = train(words.mapInArrow(cut, "syms array<int>, cnt long"), n_merges, top_pairs, max_fragments, reach)
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate(merges)]
    return word_counts.sparkSession.createDataFrame(rows, "rank int, left string, right string, count long")


def vocab_rows(merges: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """``(id, token_hex, special)`` rows: control tokens, bytes, merged tokens."""
    rows = [(i, t.encode("utf-8").hex().upper(), t) for i, t in enumerate(SPECIAL_TOKENS)]
    rows += [(BYTE_BASE + b, f"{b:02X}", None) for b in range(256)]
    seen = {h for _, h, _ in rows[N_SPECIAL:]}
    nid = MERGE_BASE
    for l, r in merges:
        tok = l + r
        if tok not in seen:
            seen.add(tok)
            rows.append((nid, tok, None))
            nid += 1
    return rows


def vocab(merges: DataFrame) -> DataFrame:
    """``id, token_hex, special`` (bounded by the vocabulary size)."""
    m = [(x["left"], x["right"]) for x in merges.orderBy("rank").collect()]
    return merges.sparkSession.createDataFrame(vocab_rows(m), "id int, token_hex string, special string")


def _encoder(merge_list: list[tuple[str, str]]):
    """word -> ids: the merge of lowest rank first, by a heap over linked symbols."""
    ids = {h: i for i, h, s in vocab_rows(merge_list) if s is None}
    numbered = [(ids[a], ids[b], 0) for a, b in merge_list]
    ranks, made = merge_ranks(numbered), [ids[a + b] for a, b in merge_list]

    def encode_word(word: str | bytes) -> list[int]:
        raw = word.encode("utf-8") if isinstance(word, str) else word
        return merge_word([BYTE_BASE + b for b in raw], ranks, made)
    return encode_word


def _merger(merge_list: list[tuple[str, str]]) -> Merger:
    """``_encoder`` for many words at once."""
    ids = {h: i for i, h, s in vocab_rows(merge_list) if s is None}
    return Merger([(ids[a], ids[b], 0) for a, b in merge_list], [ids[a + b] for a, b in merge_list])


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[start:start + length]`` one after another."""
    total = int(lengths.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def text_batches(spark) -> None:
    """Texts go to Python about 4 MB at a time at most: numpy needs many times a batch's bytes, and their width has no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def bpe_encode(df: DataFrame, merges: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Text -> ids (``key, ids``), one row per input row; control tokens atomic; no BOS/EOS added.

    The words of a chunk of texts are found in numpy and dictionary-encoded by Arrow (``operators.pretokens``):
    new distinct words are merged together, each once (a bounded table keeps them over batches), ids are gathered by
    offsets; nothing is shuffled.  Null and empty texts have no ids.
    """
    text_batches(df.sparkSession)
    m = [(x["left"], x["right"]) for x in merges.orderBy("rank").collect()]  # bounded by the vocabulary
    bc = df.sparkSession.sparkContext.broadcast((_merger(m), char_classes(df.sparkSession, WS)))

    def encode(batches):
        import pyarrow as pa

        merger, classes = bc.value
        own = {t.encode(): i for i, t in enumerate(SPECIAL_TOKENS)}
        known, flat, lengths = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for b in batches:
            parts, count = [], np.zeros(b.num_rows, np.int64)
            for words, at, row, _ in encoded_words(b.column(1), classes):
                if len(known) > KNOWN_WORDS:
                    known, flat, lengths = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
                new = [w for w in words if w not in known]
                if new:
                    plain = [b"" if w in own else w for w in new]
                    ids, size = merger.merge(np.frombuffer(b"".join(plain), np.uint8).astype(np.int32) + BYTE_BASE,
                                             np.fromiter(map(len, plain), np.int64, len(plain)))
                    atomic = np.array([k for k, w in enumerate(new) if w in own], np.int64)
                    ids = np.insert(ids, (np.cumsum(size) - size)[atomic], [own[new[k]] for k in atomic])
                    size[atomic] = 1
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    flat, lengths = np.concatenate([flat, ids]), np.concatenate([lengths, size])
                    starts = np.cumsum(lengths) - lengths
                number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[at]
                parts.append(gather(flat, starts[number], lengths[number]))
                count += np.bincount(row, lengths[number], b.num_rows).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(encode, f"{key} {key_type}, ids array<int>")


def bpe_decode(encoded: DataFrame, voc: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Ids -> text (``key, text``), row by row: control tokens come back as their text, a row
    without ids as ``''``.  The tokens' bytes are one array with offsets, bounded by the vocabulary; a
    batch's bytes are gathered from it at once.  Bytes that are no UTF-8 become U+FFFD."""
    text_batches(encoded.sparkSession)
    table = {r["id"]: bytes.fromhex(r["token_hex"]) for r in voc.select("id", "token_hex").collect()}
    parts = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
    lengths = np.array([len(x) for x in parts], np.int64)
    bc = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(parts), np.uint8), lengths))

    def decode(batches):
        import pyarrow as pa

        data, lengths = bc.value
        starts = np.cumsum(lengths) - lengths
        for b in batches:
            column = b.column(1)
            at = np.asarray(column.flatten(), dtype=np.int64)
            offsets = np.asarray(column.offsets, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths[at])])[offsets - offsets[0]]
            own = gather(data, starts[at], lengths[at]).tobytes()
            raw = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()),
                                                                        pa.py_buffer(own)])
            try:
                out = raw.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:
                out = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[key, "text"])

    held = F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<int>"))
    return encoded.select(key, held.alias("_ids")).mapInArrow(decode, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def bpe_roundtrip(df: DataFrame, merges: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ok`` -- decode(encode(x)) == x for every text (null counts as empty); the text
    travels with its key, nothing is joined."""
    carried = df.select(F.struct(F.col(key).alias("k"), F.col(text).alias("src")).alias("_k"), F.col(text).alias("text"))
    dec = bpe_decode(bpe_encode(carried, merges, "text", "_k"), vocab(merges), "_k")
    return dec.select(F.col("_k.k").alias(key), (F.col("text") == F.coalesce("_k.src", F.lit(""))).alias("ok"))


def build_token_rows(encoded: DataFrame, max_length: int = 1024, pad_id: int = 0, ids: str = "input_ids") -> DataFrame:
    """Cut to ``max_length`` and right-pad with ``pad_id``; ``attention_mask`` 1 on real
    tokens; ``labels`` = ids with every pad id -> -100.

    Built from ``slice`` / ``concat`` / ``array_repeat`` (codegen); the
    per-element replacement runs only for rows whose real tokens contain the
    pad id (a literal pad control token in the text)."""
    L = max_length
    cut = F.slice(F.col(ids), 1, L)
    n = F.size("_cut")
    pad = F.array_repeat(F.lit(pad_id), F.lit(L) - n)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(L) - n))
    fast = F.concat(F.col("_cut"), F.array_repeat(F.lit(-100), F.lit(L) - n))
    slow = F.transform("input_ids", lambda x: F.when(x == pad_id, -100).otherwise(x))
    labels = F.when(F.array_contains("_cut", pad_id), slow).otherwise(fast)
    return (encoded.withColumn("_cut", cut).withColumn("input_ids", F.concat(F.col("_cut"), pad))
            .withColumn("attention_mask", mask).withColumn("labels", labels).drop("_cut"))


def shift_pairs(rows: DataFrame, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Next-token pairs ``(token t, label t+1)`` with ignored (-100) labels removed,
    as two aligned arrays per row: ``tokens, targets``.

    Fast path (codegen slices): the ignored labels are exactly a trailing run;
    otherwise a per-element filter."""
    n = F.size(ids)
    first = F.array_position(F.col(labels), -100)  # 1-based, 0 = none
    tail_only = (first == 0) | (F.array_distinct(F.slice(F.col(labels), first, n)) == F.array(F.lit(-100)))
    keep = F.when(first == 0, n - 1).otherwise(F.greatest(first - 2, F.lit(0)))
    z = F.arrays_zip(F.slice(ids, 1, n - 1).alias("t"), F.slice(labels, 2, n - 1).alias("y"))
    kept = F.filter(z, lambda p: p["y"] != -100)
    tokens = F.when(tail_only, F.slice(F.col(ids), 1, keep)).otherwise(F.transform(kept, lambda p: p["t"]))
    targets = F.when(tail_only, F.slice(F.col(labels), 2, keep)).otherwise(F.transform(kept, lambda p: p["y"]))
    return rows.withColumn("tokens", tokens).withColumn("targets", targets)


def pack_sequences(rows: DataFrame, length: int, key: str = "idx", ids: str = "input_ids", n_buckets: int = 64,
                   seed: int = 42, drop_last: bool = True) -> DataFrame:
    """Concatenate token rows (per hash bucket, in key order) and cut into full windows
    of ``length``; the remainder of each bucket is dropped, or with ``drop_last=False`` kept as
    a shorter last window.  ``bucket, window, input_ids``.

    Offsets come from the bucketed running sum of row lengths (skew-safe).  A
    row is cut into the few slices that fall into distinct windows (at most
    ``len / length + 2`` per row, never one row per token); the slices are
    regrouped per window -- a window holds exactly ``length`` tokens, so no group
    is unbounded."""
    from tracelake.functions.columns import hash_unit
    from tracelake.operators.common import running_sum
    b = rows.select(key, ids, F.pmod(hash_unit(seed, key), F.lit(n_buckets)).cast("int").alias("bucket"),
                    F.size(ids).cast("long").alias("_len"))
    r = running_sum(b, ["bucket"], key, "_len", "_end", bucket_rows=65536).where(F.col("_len") > 0)
    off = F.col("_end") - F.col("_len")
    first_w, last_w = F.floor(off / length), F.floor((F.col("_end") - 1) / length)
    s = r.select("bucket", ids, off.alias("_off"), "_len",
                 F.explode(F.sequence(first_w.cast("long"), last_w.cast("long"))).alias("window"))
    lo = F.greatest(F.col("window") * length, F.col("_off"))
    hi = F.least((F.col("window") + 1) * length, F.col("_off") + F.col("_len"))
    piece = F.slice(F.col(ids), (lo - F.col("_off") + 1).cast("int"), (hi - lo).cast("int"))
    p = s.select("bucket", "window", (lo - F.col("window") * length).alias("_start"), piece.alias("_piece"))
    w = p.groupBy("bucket", "window").agg(F.array_sort(F.collect_list(F.struct("_start", "_piece"))).alias("_w"))
    out = w.select("bucket", "window", F.flatten(F.transform("_w", lambda x: x["_piece"])).alias("input_ids"))
    return out.where(F.size("input_ids") == length) if drop_last else out
