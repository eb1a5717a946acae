"""Registered queries of the operators in this folder (``QUERIES``, ``ORACLE``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import hardneg, lexical, licenses, pii, toxicity
from tracelake.llm.common import table
from tracelake.llm.embeddup import near_duplicates
from tracelake.llm.jaccard import jaccard_components
from tracelake.llm.learnedann import search
from tracelake.llm.linededup import drop_lines
from tracelake.llm.mixing import mix
from tracelake.llm.packing import pack
from tracelake.llm.tokenfile import read_tokens, token_files
from tracelake.llm.warc import archive, read_warc

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into power-of-two sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), end_id=1, max_len=2048, with_ids=False)


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair-queue mix of all sources to 150 % of the words; what is taken of each document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files and read back."""
    path, _ = archive(table(spark, sf_dir, "pages"))
    return read_warc(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as Re-Pair compressed token files, read back."""
    path, _ = token_files(table(spark, sf_dir, "documents"), end_id=2)
    return read_tokens(spark, path, with_ids=False)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by class-conditional Kneser-Ney models."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur across documents."""
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 90 % of their 3-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by ordered sentence rules."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE["op7_licenses"] = licenses.oracle()


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of cosine 0.95 or more and their components."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op10_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor by zone maps over Hilbert-ordered blocks."""
    return hardneg.mine(hardneg.relabelled(table(spark, sf_dir, "embeddings")))


ORACLE["op11_hard_negatives"] = hardneg.oracle()


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: exact forms, and what bootstrapped patterns add."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item, equal bags scored once."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical_search"] = lexical.oracle()
