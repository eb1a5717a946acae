"""Column-level helpers: markers, whitespace, strict JSON, hashing."""

from tracelake.functions.columns import col, count_literal, hash_unit, is_marker, py_strip, ws_token_count  # noqa: F401
from tracelake.functions.jsonx import canon, is_object, strict_parse, strict_valid  # noqa: F401
from tracelake.functions import markers  # noqa: F401
