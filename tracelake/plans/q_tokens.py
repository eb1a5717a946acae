"""Queries: BPE word counts / train / encode / decode / round trip, token rows, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import corpus as C
from tracelake.operators import tokens as T
from tracelake.plans.registry import query
from tracelake.sources.tables import table

#: 32,000 entries: 14 control tokens, 256 bytes, merges
N_MERGES = 32_000 - T.MERGE_BASE
_MERGES: dict[tuple, list[tuple]] = {}


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _file_state(spark, path: str) -> tuple:
    """Number, bytes and last change of the files: what a kept vocabulary was learned from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string")).first())


def trained_merges(spark, sf, n_merges: int = N_MERGES):
    """Merges learned on the documents of ``sf``.  The list, bounded by the vocabulary size, is kept for the session as
    long as the files are the same, so the token queries train once."""
    k = (sf, n_merges, *_file_state(spark, f"{sf}/documents.parquet"))
    if k not in _MERGES:
        m = T.bpe_train(T.bpe_word_counts(_documents(spark, sf), arrow=True), n_merges)
        _MERGES[k] = [tuple(r) for r in m.orderBy("rank").collect()]
    return spark.createDataFrame(_MERGES[k], "rank int, left string, right string, count long")


def _duck_marked(col: str = "text") -> str:
    return f"regexp_replace({col}, '{T.MARK_PATTERN}', chr(57344) || '\\1\\2', 'g')"


@query("bpe_word_counts", f"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all({_duck_marked()}, "
                          f"'{T.PRETOKEN.replace(chr(39), chr(39) * 2)}', 0)) AS word FROM documents) GROUP BY word")
def q_bpe_word_counts(spark, sf):
    return T.bpe_word_counts(_documents(spark, sf))


@query("bpe_train")
def q_bpe_train(spark, sf):
    return trained_merges(spark, sf)


@query("bpe_encode")
def q_bpe_encode(spark, sf):
    enc = T.bpe_encode(_documents(spark, sf), trained_merges(spark, sf))
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


@query("bpe_decode", "SELECT doc_id, text FROM documents")
def q_bpe_decode(spark, sf):
    m = trained_merges(spark, sf)
    enc = T.bpe_encode(_documents(spark, sf), m)
    return T.bpe_decode(enc, T.vocab(m))


@query("bpe_roundtrip", "SELECT doc_id, true AS ok FROM documents")
def q_bpe_roundtrip(spark, sf):
    return T.bpe_roundtrip(_documents(spark, sf), trained_merges(spark, sf))


_STRUCT_SQL = "[" + ", ".join("[" + ", ".join(map(str, t)) + "]" for t in C.structured_templates()) + "]"
STRUCTURED_ROWS = (f"SELECT idx, list_transform(range(512), lambda p: CAST(least(CASE WHEN tpl[(p % len(tpl)) + 1] < 30000 "
                   f"THEN tpl[(p % len(tpl)) + 1] + (idx * 7) % 500 ELSE tpl[(p % len(tpl)) + 1] END, 31999) AS INT)) "
                   f"AS input_ids FROM (SELECT event_id AS idx, {_STRUCT_SQL}[event_id % 4 + 1] AS tpl FROM events)")
TOKEN_ROWS = ("SELECT idx, list_resize(input_ids, 1024, 0) AS input_ids, "
              "list_transform(range(1, 1025), lambda i: CASE WHEN i <= least(len(input_ids), 1024) THEN 1 ELSE 0 END) "
              "AS attention_mask, list_transform(list_resize(input_ids, 1024, 0), lambda x: CASE WHEN x = 0 THEN -100 "
              "ELSE x END) AS labels FROM s")


def _structured(spark, sf):
    return C.gen_structured_token_rows(table(spark, sf, "events"), id_col="event_id")


@query("build_token_rows", f"WITH s AS ({STRUCTURED_ROWS}) {TOKEN_ROWS}")
def q_build_token_rows(spark, sf):
    return T.build_token_rows(_structured(spark, sf), max_length=1024).select(
        "idx", "input_ids", "attention_mask", "labels")


@query("shift_pairs", f"""WITH s AS ({STRUCTURED_ROWS}), r AS ({TOKEN_ROWS})
SELECT idx, list_transform(list_filter(range(1, len(input_ids)), lambda t: labels[t + 1] <> -100), lambda t: input_ids[t]) AS tokens,
  list_transform(list_filter(range(1, len(input_ids)), lambda t: labels[t + 1] <> -100), lambda t: labels[t + 1]) AS targets
FROM r""")
def q_shift_pairs(spark, sf):
    rows = T.build_token_rows(_structured(spark, sf), max_length=1024)
    return T.shift_pairs(rows).select("idx", "tokens", "targets")


PACK_LEN, PACK_BUCKETS = 1024, 8


@query("pack_sequences", f"""WITH s AS ({STRUCTURED_ROWS}),
b AS (SELECT idx, input_ids, CAST(CAST(('0x' || substr(md5('42:' || CAST(idx AS VARCHAR)), 1, 8)) AS BIGINT) % {PACK_BUCKETS} AS INT) AS bucket,
      len(input_ids) AS len FROM s),
o AS (SELECT *, sum(len) OVER (PARTITION BY bucket ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS off FROM b),
e AS (SELECT bucket, off + p AS g, input_ids[p + 1] AS tok FROM (SELECT bucket, off, input_ids, unnest(range(len(input_ids))) AS p FROM o)),
w AS (SELECT bucket, CAST(g // {PACK_LEN} AS BIGINT) AS "window", list(tok ORDER BY g % {PACK_LEN}) AS input_ids FROM e GROUP BY 1, 2)
SELECT * FROM w WHERE len(input_ids) = {PACK_LEN}""")
def q_pack_sequences(spark, sf):
    return T.pack_sequences(_structured(spark, sf), PACK_LEN, key="idx", n_buckets=PACK_BUCKETS)
