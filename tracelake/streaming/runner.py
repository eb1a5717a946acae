"""Run a streaming plan over staged files to completion (tests, checks, backfills).

Inputs are staged as Parquet files in the shared checkpoint folder; the query
runs with ``trigger(availableNow=True)`` into a Parquet file sink (exactly-once
through the sink's metadata log) and the sink is read back as a batch
DataFrame.  Nothing is collected to the driver.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "tracelake-stream", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write a batch as Parquet input files (``files``: that many, dealt evenly)."""
    (df.repartition(files) if files else df).write.mode("append").parquet(path)


def stage_by_time(df: DataFrame, path: str, ts: str, ranges: int = 4) -> int:
    """Write a table as one set of files for each range of event time, the sets one after another, so that a
    stream that takes a set at a time sees time go forward.  Each set is written, and later read, by as many tasks as
    the session's parallelism; returns that number (the stream's ``maxFilesPerTrigger``)."""
    spark = df.sparkSession
    files = max(1, spark.sparkContext.defaultParallelism)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], F.lit(10_000)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    for i, lo in enumerate([None, *cuts]):
        part = df if lo is None else df.where(at > lo)
        part = part if i == len(cuts) else part.where(at <= cuts[i])
        stage(part if i else part.union(df.where(F.col(ts).isNull())), path, files)
    return files


def run_to_sink(stream: DataFrame, sink: str, output_mode: str = "append", timeout_s: int | None = None) -> DataFrame:
    """Run ``stream`` with ``availableNow`` into a Parquet sink; return the sink as a batch DataFrame.
    ``timeout_s`` (tests) ends a run that takes longer with an error; by default a run takes what it takes."""
    spark = stream.sparkSession
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", sink + "-checkpoint").trigger(availableNow=True).start(sink))
    q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError(f"streaming query did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(sink)
