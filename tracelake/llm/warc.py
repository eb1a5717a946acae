"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id; each task streams its range into gzip-member
files that roll at a compressed size, under temporary names unique to the attempt.
The task returns one manifest row per file; Spark commits the manifest (one attempt
per task), a second job renames exactly the files it lists, and readers open only
these.  A lost executor leaves unlisted temporary files and nothing else.

Of records with equal payloads of at least ``min_dedup`` bytes the one with the
smallest page id is a response, the others are revisits that refer to it; smaller
payloads are always responses.  Headers, lengths, ids and digests are made anew.

Edge cases: null html is an empty payload; a null url is written as
``urn:page:<id>``; a null page id sorts last, and equal rows keep one response
(the first in page order); payloads equal only among rows without id refer to
nothing; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import materialise, shared_path
from tracelake.llm.files import commit, committed, store_of

CRLF = b"\r\n"
MANIFEST = "temp string, name string, records long, bytes long, sha256 string"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def record_id(page_id, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{n}')}>"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str, n: int = 0) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP header but not the payload."""
    body = b"" if revisit else payload
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                      b"Content-Length: " + str(len(payload)).encode(), b"", b""])
    block = http + body
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, n)),
            ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
            ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Has-Url", "0" if url is None else "1")]
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            head.append(("WARC-Refers-To", record_id(refers_to, digest, 0)))
            head.append(("X-Refers-To-Page", str(refers_to)))
    head.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF + CRLF
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def write_warc(pages: DataFrame, path: str, roll_bytes: int = 64 << 20, min_dedup: int = 100,
               date: str = "2024-01-01T00:00:00Z", partitions: int | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``path``; returns the committed manifest."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    # Decisions on narrow rows (no payload): the pages whose digest occurs more than once.  Partial
    # counts first, one small row per digest after.
    narrow = p.where(F.octet_length("html") >= min_dedup).select("page_id", "digest")
    first = (narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("first_id"))
             .where("_n > 1").select("digest", "first_id"))
    said = materialise(narrow.join(first, "digest").select("page_id", "digest", "first_id"), "warc-copies")
    # A decision travels as a row of its own key and sorts before the page: payloads are shuffled once.
    kinds = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")]
    r = (p.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first_id"), F.lit(False).alias("dup"))
         .unionByName(said.select("page_id", *kinds, "digest", "first_id", F.lit(True).alias("dup"))))
    order = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    keys = ([partitions] if partitions else []) + order
    r = r.repartitionByRange(*keys).sortWithinPartitions(*order, F.desc("dup"), "url")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, base = store_of(path)
        store.create_dir(f"{base}/_temporary", recursive=True)
        attempt, files, out, last, seen = uuid.uuid4().hex, [], None, None, 0
        copies, refers_to = None, None  # key of the decision row read last, and the page that it refers to

        def close():
            out["stream"].close()
            files.append((out["temp"], out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))

        for b in batches:
            for page_id, url, html, digest, first_id, dup in zip(*(b.column(i) for i in range(6))):
                key = (page_id.as_py(), digest.as_py())
                if dup.as_py():
                    copies, refers_to = key, first_id.as_py()
                    continue
                (page_id, digest), url, html = key, url.as_py(), html.as_py().encode()
                seen = seen + 1 if last == key else 0
                last = key
                revisit = copies == key and (page_id != refers_to or seen > 0)
                rec = warc_record(page_id, url, html, digest, refers_to if revisit else None, revisit, date, seen)
                if out and out["bytes"] + len(rec) > roll_bytes:
                    close()
                    out = None
                if out is None:
                    name = f"pages-{ctx.partitionId():06d}-{len(files):05d}.warc.gz"
                    temp = f"_temporary/{attempt}-{name}"
                    out = {"temp": temp, "name": name, "records": 0, "bytes": 0, "sha": hashlib.sha256(),
                           "stream": store.open_output_stream(f"{base}/{temp}")}
                out["stream"].write(rec)
                out["sha"].update(rec)
                out["records"] += 1
                out["bytes"] += len(rec)
        if out:
            close()
        cols = list(zip(*files)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         names=["temp", "name", "records", "bytes", "sha256"])

    return commit(r.mapInArrow(write, MANIFEST), path)


def _members(stream, block: int = 1 << 20):
    """Uncompressed gzip members of a stream, one at a time."""
    d, parts = zlib.decompressobj(31), []
    data = stream.read(block)
    while data:
        parts.append(d.decompress(data))
        if d.eof:
            yield b"".join(parts)
            data, d, parts = d.unused_data or stream.read(block), zlib.decompressobj(31), []
        else:
            data = stream.read(block)
    if parts and any(parts):
        raise ValueError("a WARC file ends inside a record")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the committed files below ``path``; every digest and length is checked."""
    files = committed(spark, path, MANIFEST)
    schema = RECORD if payload else RECORD.rsplit(",", 1)[0]

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in schema.split(", ")]
        store, base = store_of(path)

        def batch(rows):
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            for name in b.column("name").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{name}") as f:
                    for raw in _members(f):
                        head, _, rest = raw.partition(CRLF + CRLF)
                        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        block = rest[:int(h["Content-Length"])]
                        if "sha256:" + hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"]:
                            raise ValueError(f"block digest of {h['WARC-Record-ID']} in {name}")
                        http, _, body = block.partition(CRLF + CRLF)
                        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Type"] == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (length, digest):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} in {name}")
                        refers = h.get("X-Refers-To-Page")
                        row = (int(h["X-Page-Id"]) if h["X-Page-Id"] else None,
                               h["WARC-Target-URI"] if h["X-Has-Url"] == "1" else None, length, digest,
                               h["WARC-Type"], int(refers) if refers else None)
                        rows.append((*row, body) if payload else row)
                        size += len(body) if payload else 100
                        if size > 8_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    return files.mapInArrow(read, schema)


def archive(pages: DataFrame, **options) -> tuple[str, DataFrame]:
    """Write into a fresh shared folder; ``(path, manifest)``."""
    path = shared_path(pages.sparkSession, "warc")
    return path, write_warc(pages, path, **options)
