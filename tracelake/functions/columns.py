"""Column-level helpers; all are Spark built-ins (codegen, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.markers import NON_WS, PY_WHITESPACE, SPECIAL_TOKENS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trim every Unicode whitespace from both ends."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def count_literal(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string, no regex."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def ws_token_count(c) -> Column:
    """``len(s.split())``: number of whitespace-separated tokens."""
    return F.size(F.regexp_extract_all(col(c), F.lit(NON_WS), F.lit(0)))


def hash_unit(seed, *parts) -> Column:
    """Deterministic uniform-ish number in [0, 2^32) from md5, same in DuckDB.

    ``first 8 hex digits of md5(concat(seed, ':', part, ':', ...))`` as a long.
    """
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), col(p).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*pieces)), 1, 8), 16, 10).cast("long")


def is_marker(c) -> Column:
    return col(c).isin(*SPECIAL_TOKENS)
