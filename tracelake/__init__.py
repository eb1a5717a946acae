"""tracelake: DataFrame operators for tool-calling corpora on Apache Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built on Spark SQL
built-ins.  Sub-packages:

* ``sources``   -- table loaders, derived fixtures, JSONL / file sources and sinks
* ``functions`` -- Column-level helpers (markers, strict JSON, whitespace, hashing)
* ``operators`` -- batch operators (extraction, rendering, registry, scoring, ...)
* ``plans``     -- the registered queries and their DuckDB oracle SQL
* ``streaming`` -- Structured Streaming forms of the operators
"""

from tracelake.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
