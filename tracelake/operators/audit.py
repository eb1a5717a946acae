"""Audits over call logs: sandbox path escapes and command allow-lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.markers import WS_CLASS
from tracelake.functions.columns import py_strip


def resolve_path(root: str, path) -> F.Column:
    """Lexical ``(root / path).resolve()``: fold ``.``, ``..`` and empty parts
    (``..`` never climbs above ``/``); absolute paths replace the root."""
    full = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"),
                                                                                F.col(path)))
    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"),
                        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when((p == "") | (p == "."), acc).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def audit_path_escapes(calls: DataFrame, root: str = "/ws", path: str = "path") -> DataFrame:
    """Per call: ``resolved``, ``escapes`` (outside the root: not the root itself and
    not under ``root + '/'``) and ``prefix_escapes`` (the reference's bare
    string-prefix test, which lets ``/ws2`` pass for root ``/ws``)."""
    r = calls.withColumn("resolved", resolve_path(root, path))
    rt = root.rstrip("/")
    return (r.withColumn("escapes", ~((F.col("resolved") == rt) | F.col("resolved").startswith(rt + "/")))
            .withColumn("prefix_escapes", ~F.col("resolved").startswith(rt)))


def audit_commands(calls: DataFrame, allowed: DataFrame, command: str = "command") -> DataFrame:
    """First whitespace token of the command must be on the allow-list; an empty
    allow-list allows everything.  ``allowed(cmd)`` is joined as adaptive execution sees fit.
    Output adds ``cmd_root``, ``allowed``, ``message``."""
    stripped = py_strip(command)
    root = F.coalesce(F.split(stripped, WS_CLASS + "+")[0], F.lit(""))
    c = calls.withColumn("cmd_root", F.when(stripped == "", F.lit("")).otherwise(root))
    al = allowed.select(F.col("cmd").alias("_cmd")).distinct()
    empty = allowed.limit(1).count() == 0
    if empty:
        c = c.withColumn("allowed", F.lit(True))
    else:
        c = c.join(al, F.col("cmd_root") == F.col("_cmd"), "left").withColumn(
            "allowed", F.col("_cmd").isNotNull()).drop("_cmd")
    return c.withColumn("message", F.when(~F.col("allowed"), F.concat(
        F.lit("Command '"), F.col("cmd_root"), F.lit("' is not in allowed command list."))))
