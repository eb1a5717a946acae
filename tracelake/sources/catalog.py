"""Literal catalog tables: canonical tool specs and the default local tools.

They are small by nature (a handful of tools) and always joined as broadcast
sides; no registered query runs on them alone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: the canonical tool catalog of the trace corpus -----------
CANONICAL_TOOLS = [
    {
        "name": "local_filesystem_read",
        "description": "Read contents of a file on the local file system.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "file_path": {"type": "string", "description": "Absolute or relative file path."},
                "offset": {"type": "integer", "description": "Byte offset to read from."},
                "length": {"type": "integer", "description": "Number of bytes to read."},
            },
            "required": ["file_path"],
        },
    },
    {
        "name": "local_filesystem_write",
        "description": "Write or overwrite content to a local file.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "file_path": {"type": "string", "description": "Destination file path."},
                "content": {"type": "string", "description": "Content string to write."},
            },
            "required": ["file_path", "content"],
        },
    },
    {
        "name": "local_process_execute",
        "description": "Execute a shell command or launch an application process locally.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "command": {"type": "string", "description": "Executable shell command."},
                "cwd": {"type": "string", "description": "Working directory for execution."},
                "timeout_ms": {"type": "integer", "description": "Timeout in milliseconds."},
            },
            "required": ["command"],
        },
    },
    {
        "name": "sqlite_database_query",
        "description": "Run a read-only SQL query against a local SQLite database file.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "db_path": {"type": "string", "description": "Path to SQLite .db file."},
                "query": {"type": "string", "description": "SELECT query to run."},
            },
            "required": ["db_path", "query"],
        },
    },
    {
        "name": "git_repository_op",
        "description": "Execute git version control operations (status, diff, log, commit).",
        "inputSchema": {
            "type": "object",
            "properties": {
                "action": {"type": "string", "enum": ["status", "diff", "log", "commit"]},
                "message": {"type": "string", "description": "Commit message if action is commit."},
            },
            "required": ["action"],
        },
    },
    {
        "name": "network_http_request",
        "description": "Perform HTTP GET/POST to a local or remote REST endpoint.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "url": {"type": "string"},
                "method": {"type": "string", "enum": ["GET", "POST"]},
                "body": {"type": "object"},
            },
            "required": ["url", "method"],
        },
    },
]
# ---------------------------------------------------------------------------


def catalog_rows(tools=None, registry_id: str = "canonical") -> list[tuple]:
    """``(registry_id, seq, name, description, input_schema)`` with compact schema JSON."""
    tools = CANONICAL_TOOLS if tools is None else tools
    return [(registry_id, i, t["name"], t.get("description", ""),
             json.dumps(t.get("inputSchema", {}), separators=(",", ":")))
            for i, t in enumerate(tools)]


CATALOG_SCHEMA = "registry_id string, seq long, name string, description string, input_schema string"


def tool_catalog(spark: SparkSession, tools=None, registry_id: str = "canonical") -> DataFrame:
    return spark.createDataFrame(catalog_rows(tools, registry_id), CATALOG_SCHEMA)


def catalog_values_sql(tools=None, registry_id: str = "canonical") -> str:
    """The same catalog as a DuckDB ``VALUES`` table expression."""
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in catalog_rows(tools, registry_id))
    return (f"SELECT * FROM (VALUES {rows}) AS t(registry_id, seq, name, description, input_schema)")
