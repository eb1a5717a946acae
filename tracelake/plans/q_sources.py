"""Queries over sources and sinks: JSONL round trips, file scans, path tables, SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tracelake.operators import batches as B
from tracelake.operators.sql import sql_select_rows
from tracelake.plans.registry import query
from tracelake.session import checkpoint_dir
from tracelake.sources import files as FS
from tracelake.sources.jsonl import scan_jsonl_text, sink_jsonl_text
from tracelake.sources.tables import table


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), "tracelake-scratch", f"{name}-{uuid.uuid4().hex}")


SHUFFLE = ("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos "
           "FROM documents")


@query("sink_jsonl_text", f"""WITH s AS ({SHUFFLE})
SELECT CASE WHEN s.pos < (SELECT floor(count(*) * 0.95) FROM s) THEN 'train' ELSE 'val' END AS split, d.text
FROM s JOIN documents d ON s.doc_id = d.doc_id""")
def q_sink_jsonl_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    split = B.train_val_split(docs).select("doc_id", "split")
    out = scratch(spark, "jsonl")
    sink_jsonl_text(docs.join(split, "doc_id"), out, split_col="split")
    return spark.read.schema("text string, split string").json(out).select("split", "text")


@query("scan_jsonl_text", "SELECT CASE WHEN doc_id % 10 = 1 THEN '' ELSE text END AS text FROM documents "
                          "WHERE doc_id % 10 <> 0")
def q_scan_jsonl_text(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select(F.when(F.col("doc_id") % 10 == 0, F.lit(""))
                        .when(F.col("doc_id") % 10 == 1, F.lit("{}"))
                        .otherwise(F.to_json(F.struct("text"))).alias("value"))
    out = scratch(spark, "lines")
    lines.write.text(out)
    return scan_jsonl_text(spark, out).select("text")


NEWLINES = "replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query("scan_files_text", f"""SELECT page_id // 1024 AS bucket, CAST(sum(length({NEWLINES}) + 1) AS BIGINT) AS n_chars, CAST(sum(length({NEWLINES}) - length(replace({NEWLINES}, chr(10), '')) + 1) AS BIGINT)
  AS n_lines FROM pages GROUP BY 1""")
def q_scan_files_text(spark, sf):
    """Pages written as one text file for each 1,024 of them, however many there are, and read back by byte ranges."""
    pages = table(spark, sf, "pages")
    out = scratch(spark, "files")
    (pages.select(F.col("html").alias("value"), F.expr("page_id div 1024").alias("bucket"))
     .repartition("bucket").write.partitionBy("bucket").text(out))
    t = FS.scan_files_text(spark, out, glob="*.txt")
    own = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket")
    return t.groupBy(own).agg(F.sum(F.length("text")).cast("long").alias("n_chars"),
                              F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


PAGE_PATH = ("regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1), '/+$', '')")


def _paths(spark, sf):
    return table(spark, sf, "pages").select(FS.url_path("url").alias("path"), F.length("html").alias("length"))


@query("dir_inventory", f"""WITH p AS (SELECT string_split({PAGE_PATH}, '/') AS parts, length(html) AS len FROM pages),
e AS (SELECT parts, len, unnest(range(len(parts))) AS i FROM p)
SELECT array_to_string(parts[1:i], '/') AS dir,
  parts[i + 1] || CASE WHEN i < len(parts) - 1 THEN '/' ELSE '' END AS child,
  count(*) AS n_files, sum(len) AS bytes FROM e GROUP BY 1, 2""")
def q_dir_inventory(spark, sf):
    return FS.dir_inventory(_paths(spark, sf))


SEARCH_PATTERN = "*.html"


@query("search_files", f"SELECT {PAGE_PATH} AS path FROM pages WHERE regexp_matches({PAGE_PATH}, "
                       f"'{FS.glob_to_regex(SEARCH_PATTERN)}')")
def q_search_files(spark, sf):
    return FS.search_files(_paths(spark, sf).select("path"), SEARCH_PATTERN)


SQL_QUERY = ("SELECT o_orderpriority, count(*) AS n_lines, "
             "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue "
             "FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority ORDER BY o_orderpriority")


@query("sql_select", f"SELECT *, count(*) OVER () AS row_count FROM ({SQL_QUERY}) LIMIT 100")
def q_sql_select(spark, sf):
    views = {"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem")}
    return sql_select_rows(spark, SQL_QUERY, views)
