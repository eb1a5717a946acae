"""JSON-RPC correlation and the JSON dead-letter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import py_strip
from tracelake.functions.jsonx import strict_valid

TIMEOUT_MESSAGE = "Request timed out."
BAD_BODY_MESSAGE = "Invalid JSON body"


def rpc_correlate(requests: DataFrame, responses: DataFrame, timeout_s: int = 10) -> DataFrame:
    """Each request matched to its reply by ``(conn_id, id)`` within ``timeout_s``.

    Left outer equi + interval join: ``resp_ts BETWEEN req_ts AND req_ts +
    timeout``.  Ids are unique per connection, so the join key never skews; the
    first reply wins when a server answers twice (``min_by`` on the join keys,
    which reuses the join's partitioning).  Replies with an unknown id drop out.
    Output: ``conn_id, id, method, status (ok | timeout), result (default {}),
    latency_s``.
    """
    req = requests.alias("q")
    resp = responses.alias("r")
    cond = ((F.col("q.conn_id") == F.col("r.conn_id")) & (F.col("q.id") == F.col("r.id"))
            & F.col("r.resp_ts").between(F.col("q.req_ts"),
                                         F.col("q.req_ts") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")))
    j = req.join(resp, cond, "left").select(
        F.col("q.conn_id").alias("conn_id"), F.col("q.id").alias("id"), F.col("q.method").alias("method"),
        F.col("q.req_ts").alias("req_ts"), F.col("r.resp_ts").alias("resp_ts"), F.col("r.result").alias("result"))
    first = j.groupBy("conn_id", "id").agg(
        F.first("method").alias("method"), F.first("req_ts").alias("req_ts"),
        F.min("resp_ts").alias("resp_ts"), F.min_by("result", "resp_ts").alias("result"))
    return first.select(
        "conn_id", "id", "method",
        F.when(F.col("resp_ts").isNull(), "timeout").otherwise("ok").alias("status"),
        F.when(F.col("resp_ts").isNotNull(), F.coalesce("result", F.lit("{}"))).alias("result"),
        F.expr("timestampdiff(SECOND, req_ts, resp_ts)").alias("latency_s"))


def rpc_replies(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw lines of JSON-RPC servers -> ``<other columns>, id, result``: replies that can be matched.

    Blank lines, lines that are no strict JSON object, and messages without an integer ``id`` (notifications) are
    dropped; ``result`` is JSON text, null where the reply has none.  Row-local, so the same in a stream.
    """
    text = py_strip(line)
    v = F.when(strict_valid(text), F.try_parse_json(text))
    rest = [c for c in lines.columns if c != line]
    kept = lines.select(*rest, v.alias("_v")).where(F.col("_v").isNotNull())
    kept = kept.where(F.schema_of_variant("_v").startswith("OBJECT"))
    is_long = F.schema_of_variant(F.try_variant_get("_v", "$.id", "variant")) == "BIGINT"
    return kept.where(is_long).select(*rest, F.try_variant_get("_v", "$.id", "long").alias("id"),
                                      F.to_json(F.try_variant_get("_v", "$.result", "variant")).alias("result"))


def request_bodies(requests: DataFrame, request: str = "request", body: str = "body") -> DataFrame:
    """Raw HTTP requests -> their bodies: as many bytes behind the blank line as ``Content-Length`` says (any case, none
    or no number: 0), read as UTF-8; bytes that are none become U+FFFD.  What follows them belongs to no body.
    ``request`` (string or binary) is replaced by ``body``; row-local, so the same in a stream."""
    raw = F.col(request).cast("binary")
    head = F.substring_index(F.decode(raw, "ISO-8859-1"), "\r\n\r\n", 1)  # one character for each byte
    n = F.regexp_extract(head, "(?i)\r\ncontent-length:[ \t]*([0-9]{1,9})[ \t]*(?:\r\n|$)", 1)
    size = F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(0))
    own = F.substring(raw, F.length(head) + 5, size)
    rest = [c for c in requests.columns if c != request]
    return requests.select(*rest, F.make_valid_utf8(own.cast("string")).alias(body))


def json_dead_letter(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Every body with ``valid``, ``status_code`` (200 / 400) and the rejection message.

    Validity is strict (Python ``json.loads`` rules, see ``functions.jsonx``).
    ``split_dead_letter`` gives the two sinks.
    """
    ok = strict_valid(body)
    return bodies.withColumn("valid", ok).withColumn(
        "status_code", F.when(ok, 200).otherwise(400)).withColumn(
        "message", F.when(~ok, F.lit(BAD_BODY_MESSAGE)))


def split_dead_letter(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    d = json_dead_letter(bodies, body)
    return d.where("valid"), d.where("NOT valid")
