"""SQL pass-through over registered views, with the tool's result envelope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass
class SqlResult:
    status: str
    row_count: int | None = None
    rows: DataFrame | None = None
    message: str | None = None


def sql_select(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None,
               row_cap: int | None = None) -> SqlResult:
    """Run a read query: full ``row_count`` and its rows (the first ``row_cap`` if given).

    The text is parsed as a subquery, where the grammar has no DML or DDL, so
    ``WITH ... INSERT`` is a parse error like any other.  Errors while parsing,
    analysing or computing any column come back as an error envelope: the count reads every value, since a bare
    count would drop the columns and their errors with them.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    text = query.strip().rstrip(";")
    if not text.upper().startswith(("SELECT", "WITH", "(")):
        return SqlResult("error", message="Only read queries (SELECT / WITH) are supported.")
    try:
        df = spark.sql(f"SELECT * FROM (\n{text}\n) AS q")
        every = F.sum(F.length(F.to_json(F.struct("*"))))
        n = df.agg(F.count(F.lit(1)), every).first()[0]
    except PySparkException as e:
        return SqlResult("error", message=str(e).split("\n")[0])
    return SqlResult("success", n, df if row_cap is None else df.limit(row_cap), None)


def sql_select_rows(spark: SparkSession, query: str, views=None, row_cap: int | None = None) -> DataFrame:
    """The envelope as a DataFrame: the rows with a ``row_count`` column."""
    r = sql_select(spark, query, views, row_cap)
    if r.status != "success":
        raise ValueError(r.message)
    return r.rows.withColumn("row_count", F.lit(r.row_count).cast("long"))
