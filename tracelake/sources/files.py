"""File sources and path-table operators: text scan, directory inventory, glob search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.common import written


def plain_path(path) -> F.Column:
    """A file's path without scheme, authority and URL encoding."""
    bare = F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, length, modified`` of every file below ``root``, without reading any; ``glob`` filters names in Spark's
    listing.  The names come from that listing, which the driver holds for any scan; its table of sizes
    leaves empty files out, so these have length 0 and no time."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (r.option("pathGlobFilter", glob) if glob else r).load(root)
    sized = found.select(plain_path("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified"))
    names = spark.createDataFrame([(x,) for x in found.inputFiles()], "_p string").select(plain_path("_p").alias("path"))
    return names.join(sized, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"), "modified")


def text_pieces_of_files(spark: SparkSession, root: str, glob: str | None = None, piece_bytes: int = 1 << 20) -> DataFrame:
    """Every text file under ``root`` in pieces: ``path, length, block, piece, n_bytes, text``.

    Spark's text source deals the files out by byte ranges (``spark.sql.files.maxPartitionBytes``), so many
    tasks read one large file; a range begins and ends at a line end, hence no character is cut.  A task joins
    its lines to pieces of about ``piece_bytes`` (a longer line is one piece) and decodes them as Python's text mode does: invalid
    UTF-8 becomes U+FFFD, ``\\r\\n`` and ``\\r`` become ``\\n``.  ``(block, piece)`` orders a file's pieces.  Compressed files
    are read whole by one task.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        r = r.option("pathGlobFilter", glob)
    lines = r.text(root).select(plain_path("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
                                F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def join(batches):
        import pyarrow as pa

        at, held, size, number = None, [], 0, 0

        def piece():
            data = b"\n".join(held) + b"\n"
            text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            return pa.RecordBatch.from_pydict({"path": [at[0]], "length": [at[1]], "block": [at[2]], "piece": [number],
                                               "n_bytes": [len(data)], "cr": [held[-1].endswith(b"\r")], "text": [text]}, schema=schema)

        for b in batches:
            for p, n, k, line in zip(*(c.to_pylist() for c in b.columns)):
                if held and ((p, n, k) != at or size >= piece_bytes):
                    yield piece()
                    number = number + 1 if (p, n, k) == at else 0
                    held, size = [], 0
                at = p, n, k
                held.append(line)
                size += len(line) + 1
        if held:
            yield piece()

    import pyarrow as pa
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("block", pa.int64()), ("piece", pa.int32()),
                        ("n_bytes", pa.int64()), ("cr", pa.bool_()), ("text", pa.string())])
    kind = "path string, length long, block long, piece int, n_bytes long, cr boolean, text string"
    pieces = written(lines.mapInArrow(join, kind), "text-pieces")
    # every line got an end; a file whose bytes are one fewer has none behind its last line
    sizes = pieces.groupBy("path").agg(F.sum("n_bytes").alias("_n"), F.max("length").alias("_len"),
                                       F.max(F.struct("block", "piece")).alias("_last"))
    open_ = sizes.where(F.col("_n") > F.col("_len")).select("path", F.col("_last.block").alias("block"), F.col("_last.piece").alias("piece"),
                                                           F.lit(True).alias("_open"))
    cut = F.col("_open").isNotNull()
    # a carriage return there is a line end by itself, already read as one
    text = F.when(cut & ~F.col("cr"), F.left("text", F.length("text") - 1)).otherwise(F.col("text"))
    return pieces.join(open_, ["path", "block", "piece"], "left").select(
        "path", "length", "block", "piece", (F.col("n_bytes") - cut.cast("int")).alias("n_bytes"), text.alias("text"))


def scan_files_text(spark: SparkSession, root: str, glob: str | None = None, max_chars: int | None = None,
                    piece_bytes: int = 1 << 20) -> DataFrame:
    """Every file under ``root`` as text, read by byte ranges (see ``text_pieces_of_files``).

    ``path, length, block, piece, start, text``: a file's pieces with the place of their first character; a file of any
    size stays in pieces.  With ``max_chars`` one row a file: ``path, length, text, truncated``, the first ``max_chars``
    characters as Python's ``read`` gives them.  Empty files have a row with an empty text.
    """
    pieces = text_pieces_of_files(spark, root, glob, piece_bytes)
    chars = pieces.select("path", "block", "piece", F.length("text").cast("long").alias("_c"))
    # two levels, so that no file's pieces meet in one task but as one row for each of its ranges
    blocks = chars.groupBy("path", "block").agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy("path", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    chars = chars.withColumn("_i", F.coalesce(F.sum("_c").over(inner), F.lit(0))).join(blocks, ["path", "block"])
    starts = chars.select("path", "block", "piece", (F.col("_b") + F.col("_i")).alias("start"))
    empty = list_files(spark, root, glob).where(F.col("length") == 0)
    if max_chars is None:
        none = empty.select("path", "length", F.lit(0).cast("long").alias("block"), F.lit(0).alias("piece"),
                            F.lit(0).cast("long").alias("start"), F.lit("").alias("text"))
        return pieces.join(starts, ["path", "block", "piece"]).select("path", "length", "block", "piece", "start", "text").unionByName(none)
    first = pieces.join(starts.where(F.col("start") <= max_chars), ["path", "block", "piece"])
    first = first.select("path", "length", "start", F.left("text", F.lit(max_chars) - F.col("start").cast("int")).alias("text"),
                         (F.col("start") + F.length("text") > max_chars).alias("_more"))
    one = first.groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("_t"), F.max("_more").alias("truncated"))
    out = one.select("path", "length", F.array_join(F.transform("_t", lambda x: x["text"]), "").alias("text"), "truncated")
    return out.unionByName(empty.select("path", "length", F.lit("").alias("text"), F.lit(False).alias("truncated")))


def url_path(url) -> F.Column:
    """``scheme://host/a/b?q#f`` -> ``host/a/b`` (query, fragment and trailing ``/`` dropped)."""
    p = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    return F.regexp_replace(p, "/+$", "")


def dir_inventory(paths: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Children of every directory of a path table, one row per ``(dir, child)``.

    ``child`` carries a trailing ``/`` when it is a directory (listing order =
    ``ORDER BY dir, child``); ``n_files`` / ``bytes`` cover the child's subtree.
    Rows, not per-directory arrays: a directory holding a third of all files is
    a hot key of a partial + final aggregate, never one collected list.
    """
    parts = paths.select(F.split(F.col(path), "/").alias("_p"), F.col(length).alias("_len"))
    e = parts.select("_p", "_len", F.posexplode("_p").alias("_i", "_c"))
    d = e.select(F.array_join(F.slice("_p", 1, F.col("_i")), "/").alias("dir"),
                 F.concat(F.col("_c"), F.when(F.col("_i") < F.size("_p") - 1, F.lit("/")).otherwise(F.lit("")))
                 .alias("child"), "_len")
    return d.groupBy("dir", "child").agg(F.count(F.lit(1)).alias("n_files"), F.sum("_len").alias("bytes"))


def _class(body: str) -> str:
    """The inside of a glob class as a regex class for one character of a path segment (RE2 and Java alike)."""
    negated, body = body.startswith("!"), body.removeprefix("!")
    spans, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            lo, hi, i = body[i], body[i + 2], i + 3
        else:
            lo = hi = body[i]
            i += 1
        if lo <= hi:  # an inverted range holds nothing
            spans.append((lo, hi))
    code = "".join(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}" for lo, hi in spans)
    if negated:
        return f"[^/{code}]"
    return f"[{code}]" if code else "[^\\x{0}-\\x{10ffff}]"


def _segment_regex(segment: str) -> str:
    """One path segment of a glob: ``*``, ``?``, ``[seq]``, ``[!seq]``; an unclosed ``[`` is itself."""
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            if not out or out[-1] != "[^/]*":
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            first = i + 2 if segment.startswith("!", i + 1) else i + 1
            end = segment.find("]", first + 1)  # a bracket right behind the opening one is a member
            if end < 0:
                out.append("\\[")
            else:
                out.append(_class(segment[i + 1:end]))
                i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_to_regex(pattern: str, recursive: bool = True) -> str:
    """Glob -> anchored regex (RE2 and Java alike) over ``/`` paths of files.

    A segment knows ``*``, ``?``, ``[seq]`` and ``[!seq]``; the segment ``**`` stands for any number of folders (as the last one, for
    everything below).  ``recursive`` (``rglob``) matches the pattern at any depth unless it already starts
    with ``**``.  A pattern that ends in ``/`` names folders and matches no file."""
    segments = [x for x in pattern.split("/") if x not in ("", ".")]
    if pattern.endswith("/"):
        return "^[^\\x{0}-\\x{10ffff}]$"
    segments = segments or ["**"]
    if recursive and not pattern.startswith("**"):
        segments.insert(0, "**")
    body = "".join("(?:[^/]+/)*" if x == "**" else _segment_regex(x) + "/" for x in segments[:-1])
    body += "(?:[^/]+/)*[^/]+" if segments[-1] == "**" else _segment_regex(segments[-1])
    return "^(?s:" + body + ")$"


def search_files(paths: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Paths matching a recursive glob (files only; sort with ``orderBy(path)``)."""
    return paths.where(F.col(path).rlike(glob_to_regex(pattern)))


def listing_filter(pattern: str) -> str | None:
    """The last segment as a file-name filter for Spark's listing (its classes negate with ``^`` and know escapes
    and braces); null where it allows every name or holds what the two read differently."""
    last = pattern.rsplit("/", 1)[-1]
    if last in ("", ".", "**"):
        return None
    if "[" in last and not re.fullmatch(r"[^\[\]]*(\[!?[A-Za-z0-9_]+\][^\[\]]*)*", last):
        return None
    return re.sub(r"([{}\\,^])", r"\\\1", last).replace("[!", "[^")


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The files below ``root`` that match a recursive glob: ``path`` (relative, ``/``), ``length``, ``modified``.

    A source: the last segment filters names while Spark lists the folders, the whole pattern decides on the relative
    path; no content is read."""
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    files = list_files(spark, root, listing_filter(pattern))
    files = files.where(F.startswith("path", base)).withColumn("path", F.substr("path", F.length(base) + 1))
    return search_files(files, pattern)
