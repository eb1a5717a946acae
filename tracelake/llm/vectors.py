"""What both embedding operators take for a vector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(col="embedding"):
    """Not null, not empty, every component a finite number, not all zero."""
    v = F.col(col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def doubles(df: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of doubles) of the usable rows."""
    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))


def main_width(df: DataFrame) -> int:
    """The commonest vector length (the smallest of equal ones); other lengths take no part."""
    row = df.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    return row["w"] if row else 0


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def row_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal results wherever they stand."""
    return (x * y).sum(1)
