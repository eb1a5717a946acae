"""Training-data pipeline over ``documents``: toxicity filter, line dedup, near-duplicate
removal, source mixing, packing.

Every stage works on all rows that its predecessor kept and returns the columns of
``documents`` (the last one returns packed pieces with their token ids).  A stage's result is written and
read again as the next one's ``docs``; the next stage begins by deleting the scratch tables of the one before.

Edge cases are those of the operators; in the near-duplicate stage equal rows of one
id stay once, texts without words and rows with a null id all stay; ``n_chars`` follows
the text where the column exists.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import toxicity as tox
from tracelake.llm.common import drop_tables, materialise, scratch, small_side, table
from tracelake.llm.jaccard import jaccard_components
from tracelake.llm.linededup import drop_lines
from tracelake.llm.mixing import mix_documents
from tracelake.llm.packing import pack


_LEFT: list[str] = []  # scratch tables of the stage before


def stage(fn):
    """Delete what the stage before left behind, unless ``docs`` was not written and still reads it; note what this
    one writes."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _LEFT, docs)
        with scratch(_LEFT):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return tox.keep_ordinary(docs, tox.train(docs, table(spark, sf_dir, "labels")))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose templates recur across documents go."""
    out = drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that share 80 % of their 5-word shingles the one with the smallest id stays."""
    comp = jaccard_components(docs, n=5, num=80, den=100)
    flags = (comp.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((F.min("component_id") < F.col("doc_id")).alias("_copy"), (F.count(F.lit(1)) > 1).alias("_again"))
             .where("_copy or _again"))
    flags = materialise(flags, "near-duplicates")
    flags = small_side(flags, F.lit(24), 16 << 20)  # else whole texts are shuffled
    kept = docs.join(flags, "doc_id", "left").where(~F.coalesce("_copy", F.lit(False)))
    once = kept.where(F.coalesce("_again", F.lit(False))).dropDuplicates(["doc_id", "text"])
    return kept.where(~F.coalesce("_again", F.lit(False))).unionByName(once).select(*docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mix_documents(docs).select(*docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences with their token ids."""
    return pack(docs, end_id=1, max_len=2048, with_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]

#: hashes, trained scores and token ids have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, one in STAGES:
        written: list[str] = []
        result = one(spark, docs, sf_dir)
        with scratch(written):
            docs = materialise(result, f"stage-{name}")
        drop_tables(spark, before)
        before = written
    drop_tables(spark, _LEFT)
    return docs
