"""Shared plan helpers: skew-safe running sums, tables in the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``: lineage ends there, whichever executor is lost."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"tracelake-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                bucket_rows: int | None = 65536, inclusive: bool = True) -> DataFrame:
    """Running ``sum(value)`` per ``keys`` ordered by the integral ``order``.

    A plain window puts a whole key in one task; with ``bucket_rows`` the prefix
    sum is computed in two levels instead: per-bucket totals (partial
    aggregation), an exclusive prefix over the few bucket totals, and a window
    inside each ``(keys, bucket)`` -- so a key holding a third of all rows is
    spread over ``rows / bucket_rows`` tasks.
    """
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    if not bucket_rows:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(*frame)
        s = F.sum(value).over(w)
        return df.withColumn(out, s if inclusive else F.coalesce(s, F.lit(0)))
    b = df.withColumn("_bk", F.floor(F.col(order) / F.lit(bucket_rows)).cast("long"))
    tot = b.groupBy(*keys, "_bk").agg(F.sum(value).alias("_bt"))
    wo = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wo), F.lit(0))).drop("_bt")
    wi = Window.partitionBy(*keys, "_bk").orderBy(order).rowsBetween(*frame)
    inner = F.coalesce(F.sum(value).over(wi), F.lit(0))
    return (b.join(off, [*keys, "_bk"]).withColumn(out, F.col("_off") + inner).drop("_bk", "_off"))
