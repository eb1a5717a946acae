"""JSONL text corpora: ``{"text": ...}`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_jsonl_text(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Read ``{"text": ...}`` lines: blank lines are skipped, a missing ``text`` is
    ``''``, a malformed line fails the job (``mode='FAILFAST'``); with
    ``mode='PERMISSIVE'`` bad lines come back in ``_corrupt_record`` instead.
    Splittable line-delimited scan: one task per file split."""
    schema = "text string" + (", _corrupt_record string" if mode.upper() == "PERMISSIVE" else "")
    df = spark.read.schema(schema).option("mode", mode).json(path)
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def sink_jsonl_text(df: DataFrame, path: str, split_col: str | None = None, mode: str = "overwrite") -> None:
    """Write one ``{"text": ...}`` per line (compact JSON; equal to Python's
    ``json.dumps`` after parsing, not byte for byte).  With ``split_col`` the
    rows go to ``path/<split_col>=<value>/`` folders (e.g. train / val)."""
    w = df.select(*(["text"] + ([split_col] if split_col else []))).write.mode(mode)
    if split_col:
        w = w.partitionBy(split_col)
    w.json(path)
