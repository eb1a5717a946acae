"""Line dedup with a log-template tree.

The tree has a fixed depth: token count, then the leading tokens (tokens with a digit
are one variable).  Inside a leaf a token at its place is supported by the distinct
lines that hold it there; a document has one vote in a leaf, shared by the lines it
stands for.  The ``constant`` share of a line's tokens with the most support tells the
size of its cluster: what is supported as much is constant, the rest are variable
fields ``<*>``.  Only relations of support inside a line count, so a field is found alike
at every size of the table.  A line with too few tokens that another line holds is its
own template.  A template that recurs in ``min_docs`` documents is dropped.

Copies are told by the whole text: documents of the same token sequence, white space
and line ends aside, are one class and count once towards ``min_docs``, by their smallest
id; every other document counts, however much of it recurs.  So whole copies by
themselves are left to document dedup, and lose the lines that other documents hold.  All leaf statistics are
hash aggregates with partial sums over narrow rows; only lines in leaves that several
documents share carry their tokens, as hashes.

Edge cases: null text stays null with no lines; blank lines and lines below
``min_tokens`` tokens are never dropped; rows of a null ``doc_id`` are one document for each different text;
equal rows count once per id; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.bytewords import mix, span_hashes, text_chunks, words
from tracelake.llm.common import materialise, small_side, tidy, worker_cache

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
VARIABLE = np.uint64(0x2A2A2A2A2A2A2A2B)
_STEP = np.uint64(0x9E3779B97F4A7C15)
VOTE = 1 << 24


def line_table(text: str, depth: int, min_tokens: int, with_tokens: bool = False):
    """``line number, leaf, line hash, placed token hashes, tokens`` of the lines that can be dropped
    (placed hashes only if asked for)."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(raw == 10) + 1, [len(raw)]])
    starts, ends, line = words(raw, bounds)
    h = span_hashes(raw, starts, ends)
    at = np.flatnonzero(_DIGIT[raw])
    if len(at):
        h[np.searchsorted(starts, at, "right") - 1] = VARIABLE  # a digit lies in a token
    count = np.bincount(line, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    place = (np.arange(len(h)) - first[line]).astype(np.uint64)
    placed = mix(h ^ (place + np.uint64(1)) * _STEP)  # a token at its place
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed)])
    pick = np.flatnonzero(count >= min_tokens)
    a, n = first[pick], count[pick]
    leaf = mix(acc[a + np.minimum(n, depth)] - acc[a] + n.astype(np.uint64) * _STEP)
    whole = mix(acc[a + n] - acc[a] + n.astype(np.uint64))
    tokens = [placed[x:x + k] for x, k in zip(a.tolist(), n.tolist())] if with_tokens else None
    return pick, leaf, whole, tokens, n


def chunk_lines(data: np.ndarray, bounds: np.ndarray, depth: int, min_tokens: int):
    """``document, leaf, line hash, tokens, content`` of the lines that can be dropped, like ``line_table`` of each
    document ``data[bounds[k]:bounds[k + 1]]``, for all of them at once."""
    cuts = np.sort(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
    starts, ends, line = words(data, cuts)
    h = span_hashes(data, starts, ends)
    token = np.searchsorted(starts, bounds)
    size = np.diff(token)
    at = (np.arange(1, len(h) + 1) - np.repeat(token[:-1], size)).astype(np.uint64)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ at * _STEP))])
    content = mix(acc[token[1:]] - acc[token[:-1]] + size.astype(np.uint64))
    digits = np.flatnonzero(_DIGIT[data])
    if len(digits):
        h[np.searchsorted(starts, digits, "right") - 1] = VARIABLE
    count = np.bincount(line, minlength=len(cuts) - 1)
    first = np.cumsum(count) - count
    place = (np.arange(len(h)) - np.repeat(first, count)).astype(np.uint64)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ (place + np.uint64(1)) * _STEP))])
    pick = np.flatnonzero(count >= min_tokens)
    a, n = first[pick], count[pick]
    leaf = mix(acc[a + np.minimum(n, depth)] - acc[a] + n.astype(np.uint64) * _STEP)
    whole = mix(acc[a + n] - acc[a] + n.astype(np.uint64))
    doc = np.searchsorted(bounds, cuts[pick], "right") - 1
    return doc, leaf, whole, n, content[doc]


def _doc():
    """Two columns that name a document: its id, or without one a hash of its text."""
    text = F.xxhash64(F.col("text").cast("string"))
    return [F.coalesce(F.col("doc_id").cast("long"), text).alias("doc"), F.col("doc_id").isNull().alias("nameless")]


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``doc, nameless, content, leaf, line, n`` of every line that can be dropped."""
    def parse(batches):
        import pyarrow as pa

        worker_cache("linededup")
        for b in batches:
            ids, nameless, out = np.asarray(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), [[], [], [], [], [], []]
            for lo, data, bounds in text_chunks(b.column(2)):
                doc, leaf, whole, n, content = chunk_lines(data, bounds, depth, min_tokens)
                out[0].append(ids[lo + doc])
                out[1].append(content.view(np.int64))
                out[2].append(leaf.view(np.int64))
                out[3].append(whole.view(np.int64))
                out[4].append(n.astype(np.int32))
                out[5].append(nameless[lo + doc])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)],
                                             names=["doc", "content", "leaf", "line", "n", "nameless"])

    return docs.select(*_doc(), F.col("text").cast("string")).mapInArrow(
        tidy(parse), "doc long, content long, leaf long, line long, n int, nameless boolean")


def _tokens(docs: DataFrame, leaves: DataFrame, depth: int, min_tokens: int, bits: int = 22) -> DataFrame:
    """``leaf, line, tokens`` once per distinct line of the given leaves (a Bloom filter of fixed size first)."""
    slots = (leaves.select(F.pmod("leaf", F.lit(1 << bits)).alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow())  # <= 2**bits / 64 rows
    bloom = np.zeros((1 << bits) // 64, np.int64)
    bloom[slots["w"].to_numpy()] = slots["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def parse(batches):
        import pyarrow as pa

        worker_cache("linededup")
        table, seen = shared.value, set()
        for b in batches:
            out = []
            for t in b.column(0):
                t = t.as_py()
                if not t:
                    continue
                _, leaf, whole, tokens, *_ = line_table(t, depth, min_tokens, with_tokens=True)
                p = np.mod(leaf.view(np.int64), 1 << bits)
                for k in np.flatnonzero((table[p // 64] >> (p % 64)) & 1):
                    w = int(whole[k])
                    if w not in seen:
                        if len(seen) > 300_000:
                            seen.clear()
                        seen.add(w)
                        out.append((int(leaf[k:k + 1].view(np.int64)[0]), int(whole[k:k + 1].view(np.int64)[0]),
                                    tokens[k].view(np.int64)))
            c = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()),
                                              pa.array(c[2], pa.list_(pa.int64()))], names=["leaf", "line", "tokens"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(parse), "leaf long, line long, tokens array<long>")
    return rows.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))


def dropped_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 3, constant: float = 0.7) -> DataFrame:
    """``doc, nameless, lines``: hashes of the lines that each document loses."""
    lines = materialise(_lines(docs, depth, min_tokens), "lines")
    leaves = lines.groupBy("leaf").agg(F.countDistinct("content").alias("d"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    leaves = materialise(leaves.where(F.col("d") >= min_docs).select("leaf", (F.col("lo") != F.col("hi")).alias("many")), "leaves")
    near = lines.join(leaves, "leaf")
    # generalise inside leaves of several lines
    held = near.where("many").groupBy("leaf", "line").agg(F.min("content").alias("holder"))
    share = F.greatest(F.lit(1), F.floor(F.lit(VOTE) / F.count(F.lit(1)).over(Window.partitionBy("leaf", "holder"))))
    held = held.select("leaf", "line", share.alias("vote"))
    tokens = _tokens(docs, leaves.where("many").select("leaf"), depth, min_tokens).join(held, ["leaf", "line"])
    tokens = tokens.select("leaf", "line", "vote", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    tokens = materialise(tokens, "line-tokens")
    # a token of one line only is constant in no cluster of several lines
    support = (tokens.groupBy("leaf", "t").agg(F.sum("vote").alias("support"), F.count(F.lit(1)).alias("k"))
               .where("k > 1").select("leaf", "t", "support"))
    need = F.ceil(F.col("n") * constant)
    place = F.rank().over(Window.partitionBy("leaf", "line").orderBy(F.desc("support")))
    shape = (tokens.join(support, ["leaf", "t"]).select("leaf", "line", "t", "n", place.alias("place")).where(F.col("place") <= need)
             .groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("t").alias("x"))
             .select("leaf", "line", "c", F.xxhash64("leaf", "x", "c").alias("template")))
    named = (near.join(shape, ["leaf", "line"], "left")
             .withColumn("template", F.when(F.col("c") >= F.ceil(F.col("n") * constant), F.col("template")).otherwise(F.col("line")))
             .select("doc", "nameless", "content", "line", "template"))
    named = materialise(named, "templates")
    # of the documents of one whole text the smallest id counts
    drop = (named.groupBy("template", "content").agg(F.min(F.struct("nameless", "doc")).alias("doc"))
            .groupBy("template").agg(F.countDistinct("doc").alias("d")).where(F.col("d") >= min_docs).select("template"))
    return named.join(drop, "template").groupBy("doc", "nameless").agg(F.collect_set("line").alias("lines"))


def drop_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 3, constant: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with recurring lines taken out of ``text``, plus ``n_lines`` and
    ``dropped`` (numbers of the lines taken out, from 0).  Those two names are the operator's."""
    lost = materialise(dropped_lines(docs, depth, min_docs, min_tokens, constant), "lost-lines")
    lost = small_side(lost, F.lit(24) + 8 * F.size("lines"), 16 << 20)  # else whole texts are shuffled
    kept = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    j = docs.select(F.struct(*kept).alias("_d"), *_doc()).join(lost, ["doc", "nameless"], "left").select(
        F.col("_d.text").cast("string").alias("text"), "lines", "_d")

    def cut(batches):
        import pyarrow as pa

        worker_cache("linededup")
        for b in batches:
            texts, counts, gone = [], [], []
            for t, lines in zip(b.column(0), b.column(1)):
                t, lines = t.as_py(), lines.as_py()
                parts = t.split("\n") if t is not None else []
                out: list[int] = []
                if lines:
                    bad = np.array(lines, np.int64).view(np.uint64)
                    number, _, whole, *_ = line_table(t, depth, min_tokens)
                    out = number[np.isin(whole, bad)].tolist()
                    lost_ = set(out)
                    t = "\n".join(p for i, p in enumerate(parts) if i not in lost_)
                texts.append(t)
                counts.append(len(parts))
                gone.append(out)
            d = b.column(2)
            fields = [pa.array(texts, pa.string()) if c == "text" else d.field(i) for i, c in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*fields, pa.array(counts, pa.int32()), pa.array(gone, pa.list_(pa.int32()))],
                                             names=[*kept, "n_lines", "dropped"])

    fields = ", ".join(f"`{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in kept)
    return j.mapInArrow(tidy(cut), f"{fields}, n_lines int, dropped array<int>")
