"""Registered queries (``QUERIES``) and their DuckDB oracle SQL (``ORACLE``)."""

from tracelake.plans.registry import ORACLE, QUERIES  # noqa: F401
from tracelake.plans import q_extract  # noqa: F401,E402
from tracelake.plans import q_registry  # noqa: F401,E402
from tracelake.plans import q_score  # noqa: F401,E402
from tracelake.plans import q_sources  # noqa: F401,E402
from tracelake.plans import q_tokens  # noqa: F401,E402
from tracelake.plans import q_stream  # noqa: F401,E402
from tracelake.plans import q_udf  # noqa: F401,E402
