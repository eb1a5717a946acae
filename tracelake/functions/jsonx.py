"""JSON helpers.

Spark's ``try_parse_json`` (Jackson) stops after the first root value and so
accepts ``{"a": 1} trailing``; Python's ``json.loads`` and DuckDB reject it.
``strict_parse`` closes that gap natively: the text is parsed inside a
two-element array whose second element is a per-row sentinel (the md5 of the
text).  The sentinel only comes back as element 1 when the text parsed as exactly
one JSON value followed by our comma -- trailing garbage, a second value or an
early bracket all break it.  One parse per value, no Python.

Remaining, documented differences to Python: ``NaN``/``Infinity`` and
duplicate keys are rejected here (Python accepts them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.columns import col


def _wrapped(c) -> tuple[Column, Column]:
    c = col(c)
    h = F.md5(c)
    w = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), h, F.lit('"]')))
    return w, h


def wrap(c) -> tuple[Column, Column]:
    """``(wrapped VARIANT, sentinel)``: materialise both once (a column or a struct
    field) and read them with ``wrapped_value`` / ``wrapped_ok`` -- inside
    higher-order lambdas Catalyst does not share common subexpressions."""
    return _wrapped(c)


def wrapped_ok(w, h) -> Column:
    return F.coalesce(F.try_variant_get(col(w), "$[1]", "string") == col(h), F.lit(False))


def wrapped_value(w, h) -> Column:
    return F.when(F.try_variant_get(col(w), "$[1]", "string") == col(h), F.try_variant_get(col(w), "$[0]", "variant"))


def strict_valid(c) -> Column:
    """True iff the text is exactly one JSON value (Python ``json.loads`` accepts it)."""
    w, h = _wrapped(c)
    return F.coalesce(F.try_variant_get(w, "$[1]", "string") == h, F.lit(False))


def strict_parse(c) -> Column:
    """VARIANT of the text if strictly valid JSON, else NULL."""
    w, h = _wrapped(c)
    return F.when(F.try_variant_get(w, "$[1]", "string") == h, F.try_variant_get(w, "$[0]", "variant"))


def is_object(v) -> Column:
    """VARIANT holds a JSON object."""
    return F.coalesce(F.schema_of_variant(col(v)).startswith("OBJECT"), F.lit(False))


def canon(v) -> Column:
    """Canonical JSON text of a VARIANT (keys sorted, compact)."""
    return F.to_json(col(v))
