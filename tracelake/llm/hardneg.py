"""Hard negatives for embeddings: Hilbert-ordered Parquet blocks with zone maps, read by interval bounds.

1. Components become integers, ``floor(scale * x)``.  The ``curve_dims`` dimensions of the largest
   variance, cut into equal steps between their extremes, give each row its place on a Hilbert
   curve; rows are range-sorted by (length, place) and written as Parquet, one row per block of
   ``block_rows`` vectors, with the smallest and largest value of every dimension (zone map) and the block's labels.
2. An anchor's bounds for a block are ``sum(max(a*lo, a*hi))`` and ``sum(min(a*lo, a*hi))``: interval
   arithmetic over the zone map.  All anchors meet all zone maps, in groups of at most
   ``anchor_rows`` anchors and chunks of about ``zone_rows`` maps.
3. Positives: the anchor's own block gives a first lower bound of its last positive's score; only blocks that hold
   its label and whose upper bound reaches that score are read.
4. Negatives: every positive's score gives a window.  The own block gives a first lower bound for
   each window; only blocks with another label that meet some window at or above that bound are read.
   Tasks hold the best rows of an anchor over all blocks that they read.

Bounds and scores are exact integers, so nothing is lost by pruning.  On vectors without structure
(independent components) the zone maps exclude little and nearly all blocks are read.

Edge cases: rows with a null label, a null vector or any null or non-finite component take no part, nor do vectors
with a component of ``2**26`` or more after scaling (their scores need more than 64 bits) or more
than 2048 components; only vectors of equal length are compared; vectors of zeros and of no component
have score 0 with all others; a null vec_id is no anchor, ranks last among equal scores and is returned as null;
rows of equal vec_id are rows of their own, but none is a positive or negative of an anchor of its id; an anchor without a
positive, a positive without a negative in its window, and an empty table give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialise, parallelism, small_batches, small_side

_NULL_ID = np.iinfo(np.int64).max  # stands for a null vec_id inside a task
_LIMIT = 1 << 26
_BITS, _CURVE_DIMS = 7, 8


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, q`` (array of longs) of the rows that take part; extremes are checked as doubles."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                          F.transform(x, lambda v: v * F.lit(float(scale))).alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(_LIMIT)))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & fine & (F.size("x") <= 2048))
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v).cast("long")).alias("q"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, dims) of ``bits`` bits a dimension; dims * bits < 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & q, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _by_width(column):
    """``width, rows, matrix`` of each vector length of an Arrow list column."""
    import pyarrow.compute as pc

    widths = np.asarray(pc.list_value_length(column))
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield int(w), at, np.asarray(column.take(at).flatten(), dtype=np.int64).reshape(len(at), w)


def _spread(rows: DataFrame) -> dict:
    """Per vector length: the curve's dimensions with their smallest and largest value.  A task sends
    one row for each length (at most 2049)."""

    def sums(batches):
        import pyarrow as pa

        held: dict = {}
        for b in batches:
            for w, _, m in _by_width(b.column(0)):
                f = m.astype(np.float64)
                new = (len(m), f.sum(0), (f * f).sum(0), f.min(0), f.max(0))
                old = held.get(w)
                held[w] = new if old is None else (old[0] + new[0], old[1] + new[1], old[2] + new[2],
                                                   np.minimum(old[3], new[3]), np.maximum(old[4], new[4]))
        for w, (n, s, s2, lo, hi) in held.items():
            yield pa.RecordBatch.from_pydict({"w": [w], "n": [n], "s": [s.tolist()], "s2": [s2.tolist()],
                                              "lo": [lo.tolist()], "hi": [hi.tolist()]}, schema=schema)

    import pyarrow as pa
    doubles = pa.list_(pa.float64())
    schema = pa.schema([("w", pa.int32()), ("n", pa.int64()), ("s", doubles), ("s2", doubles), ("lo", doubles), ("hi", doubles)])
    parts = rows.select("q").mapInArrow(sums, "w int, n long, s array<double>, s2 array<double>, lo array<double>, hi array<double>")
    at = F.posexplode(F.arrays_zip("s", "s2", "lo", "hi")).alias("i", "x")
    per_dim = parts.select("w", "n", at).groupBy("w", "i").agg(
        F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.s2").alias("s2"), F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    per_dim = per_dim.withColumn("var", F.col("s2") / F.col("n") - (F.col("s") / F.col("n")) ** 2)
    first = per_dim.withColumn("p", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("var"), "i")))
    curve: dict = {}
    for r in first.where(F.col("p") <= _CURVE_DIMS).orderBy("w", "p").collect():  # at most 8 rows for each length
        curve.setdefault(r["w"], []).append((r["i"], r["lo"], r["hi"]))
    return curve


_BLOCK = ("block long, width long, n int, ids binary, labels binary, q binary, lo array<long>, hi array<long>, "
          "own_labels array<long>")


def write_blocks(rows: DataFrame, block_rows: int = 1024) -> DataFrame:
    """The Hilbert-ordered block table, in the shared folder."""
    curve = _spread(rows)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            width, at_place = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for w, at, m in _by_width(b.column(2)):
                width[at] = w
                dims = curve.get(w, [])
                if dims:
                    cells = [np.clip((m[:, i] - lo) / max(hi - lo, 1) * (1 << _BITS), 0, (1 << _BITS) - 1) for i, lo, hi in dims]
                    at_place[at] = hilbert(np.stack(cells, 1), _BITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(width), pa.array(at_place)],
                                             names=["vec_id", "label", "q", "width", "place"])

    def block(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        pending: list = []
        size = 0

        def out(table):
            nonlocal number
            _, _, m = next(_by_width(table.column(2).combine_chunks()))
            ids = np.asarray(table.column(0).fill_null(_NULL_ID).combine_chunks(), dtype=np.int64)
            labels = np.asarray(table.column(1).combine_chunks(), dtype=np.int64)
            order = np.argsort(ids, kind="stable")  # equal scores: the place inside the block is the order
            m, ids, labels = m[order], ids[order], labels[order]
            number += 1
            return pa.RecordBatch.from_pydict(
                {"block": [number], "width": [m.shape[1]], "n": [len(m)], "ids": [ids.tobytes()], "labels": [labels.tobytes()],
                 "q": [m.astype(np.int32).tobytes()], "lo": [m.min(0).tolist()], "hi": [m.max(0).tolist()],
                 "own_labels": [np.unique(labels).tolist()]}, schema=schema)

        for b in batches:
            widths = np.asarray(b.column(3))
            cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if pending and pending[0].column(3)[0].as_py() != widths[lo]:
                    yield out(pa.Table.from_batches(pending))
                    pending, size = [], 0
                while lo < hi:
                    part = b.slice(lo, min(hi - lo, block_rows - size))
                    pending.append(part)
                    lo, size = lo + part.num_rows, size + part.num_rows
                    if size == block_rows:
                        yield out(pa.Table.from_batches(pending))
                        pending, size = [], 0
        if pending:
            yield out(pa.Table.from_batches(pending))

    import pyarrow as pa
    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("width", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("q", pa.binary()), ("lo", longs), ("hi", longs), ("own_labels", longs)])
    placed = rows.mapInArrow(place, "vec_id long, label long, q array<long>, width long, place long")
    # equal vectors stand at one place of the curve: the id parts them, so that no copy group lands in one task
    ordered = placed.repartitionByRange("width", "place", "vec_id").sortWithinPartitions("width", "place", "vec_id")
    return materialise(ordered.mapInArrow(block, _BLOCK), "hardneg-blocks")


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(rows, width).astype(np.int64)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; by doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, allowed: np.ndarray, k: int):
    """Per row the ``k`` best allowed columns (score, then column): ``row, column`` in that order."""
    allowed = np.asarray(allowed)
    out_r, out_c = [], []
    n = scores.shape[1]
    kk = min(k, n)
    least, most = (int(scores.min()), int(scores.max())) if scores.size else (0, 0)
    if scores.size and (most - least + 2) < (1 << 62) // n:
        key = np.where(allowed, (scores - least + 1) * n + np.arange(n - 1, -1, -1), -1)
        top = np.argpartition(-key, kk - 1, axis=1)[:, :kk]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        ok = np.take_along_axis(allowed, top, 1)
        r, p = np.nonzero(ok)
        return r, top[r, p]
    for i in range(len(scores)):  # scores too large for one key
        c = np.flatnonzero(allowed[i])
        c = c[np.argsort(-scores[i, c], kind="stable")][:k]
        out_r += [i] * len(c)
        out_c += c.tolist()
    return np.array(out_r, np.int64), np.array(out_c, np.int64)


_ANCHORS = "grp long, width long, ids binary, labels binary, q binary, floors binary, home binary, windows binary"


def anchors_of(blocks: DataFrame, every: int, positives: int, anchor_rows: int = 1024) -> DataFrame:
    """Groups of at most ``anchor_rows`` anchors of neighbouring blocks, with the score that the own block gives
    for the last positive (``floors``; the least integer where it has fewer)."""

    def own(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                at = np.flatnonzero((ids % every == 0) & (ids != _NULL_ID))
                if not len(at):
                    continue
                m = _matrix(r["q"], len(ids), r["width"])
                floors = np.full(len(at), np.iinfo(np.int64).min)
                for lo in range(0, len(at), 256):
                    part = at[lo:lo + 256]
                    s = _dots(m[part], m)
                    row, col = _best(s, (labels == labels[part][:, None]) & (ids != ids[part][:, None]), positives)
                    n = np.bincount(row, minlength=len(part))
                    last = np.cumsum(n) - 1
                    full = np.flatnonzero(n == positives)
                    floors[lo + full] = s[row[last[full]], col[last[full]]]
                yield pa.RecordBatch.from_pydict(
                    {"block": [r["block"]], "width": [r["width"]], "ids": [ids[at].tobytes()], "labels": [labels[at].tobytes()],
                     "q": [m[at].astype(np.int32).tobytes()], "floors": [floors.tobytes()],
                     "home": [np.full(len(at), r["block"]).tobytes()]})

    def pack(key, frame):
        import pandas as pd

        frame = frame.sort_values("block")
        width = int(frame["width"].iloc[0])
        ids, labels, floors, home = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("ids", "labels", "floors", "home"))
        q = np.frombuffer(b"".join(frame["q"]), np.int32).reshape(len(ids), width)
        rows = []
        for i, lo in enumerate(range(0, len(ids), anchor_rows)):
            cut = slice(lo, lo + anchor_rows)
            rows.append((int(key[0]) * 64 + i, width, ids[cut].tobytes(), labels[cut].tobytes(), q[cut].tobytes(),
                         floors[cut].tobytes(), home[cut].tobytes(), b""))
        return pd.DataFrame(rows, columns=["grp", "width", "ids", "labels", "q", "floors", "home", "windows"])

    cols = blocks.select("block", "width", "ids", "labels", "q")
    found = cols.mapInArrow(own, "block long, width long, ids binary, labels binary, q binary, floors binary, home binary")
    # 32 neighbouring blocks hold at most 32 times a block's rows: a bounded group
    by = F.shiftright("block", 5) * 4096 + F.col("width")
    return materialise(found.groupBy(by.alias("g")).applyInPandas(pack, _ANCHORS), "hardneg-anchors")


def _routes(blocks: DataFrame, anchors: DataFrame, wants, zone_rows: int = 2048) -> DataFrame:
    """``grp, block, at`` (places of the anchors in the group): whom interval arithmetic sends to which block.
    ``wants(anchor row, upper, lower, labels)`` gives the matrix of anchors x maps."""
    zones = blocks.select("block", "width", "lo", "hi", "own_labels")
    chunks = max(1, -(-zones.count() // zone_rows))
    zones = zones.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
    packed = zones.groupBy("width", "chunk").agg(F.collect_list(F.struct("block", "lo", "hi", "own_labels")).alias("zones"))
    spread = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    pairs = spread.join(packed, ["width", "chunk"])

    def bound(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                w = r["width"]
                a = _matrix(r["q"], len(r["ids"]) // 8, w)
                lo = np.array([z["lo"] for z in r["zones"]], np.int64).reshape(len(r["zones"]), w)
                hi = np.array([z["hi"] for z in r["zones"]], np.int64).reshape(len(r["zones"]), w)
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                meet = wants(r, _dots(up, hi) + _dots(down, lo), _dots(up, lo) + _dots(down, hi),
                             [z["own_labels"] for z in r["zones"]])
                blocks_of = [z["block"] for z in r["zones"]]
                at = [np.flatnonzero(meet[:, j]).astype(np.int32) for j in range(meet.shape[1])]
                rows = [(r["grp"], blocks_of[j], x.tobytes()) for j, x in enumerate(at) if len(x)]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("grp", "block", "at"), map(list, zip(*rows)))))

    return pairs.select("grp", "width", "ids", "labels", "q", "floors", "windows", "zones").mapInArrow(
        bound, "grp long, block long, at binary")


def _visit(blocks: DataFrame, anchors: DataFrame, routes: DataFrame, allowed, slots: int, k: int, keep: int = 48) -> DataFrame:
    """``uid, slot, score, id``: for each slot of an anchor the ``k`` best rows over the blocks that a task reads.
    ``allowed(slot, anchor row, at, scores, ids, labels)`` gives the rows that a slot takes."""
    cols = anchors.select("grp", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("q").alias("a_q"), "windows")
    cols = small_side(cols, F.length("a_q") + F.length("a_ids") * 2 + F.length("windows"))
    # a given number of partitions: these tasks compute much on few bytes
    dealt = routes.repartition(parallelism(blocks.sparkSession), "block")
    jobs = dealt.join(blocks.select("block", "width", "ids", "labels", "q"), "block").join(cols, "grp")

    def read(batches):
        import pyarrow as pa

        held: OrderedDict = OrderedDict()  # group -> uid, slot, score, id of the best so far

        def rows(state):
            uid, slot, score, ids = state
            for lo in range(0, len(uid), 100_000):
                i = ids[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[lo:lo + 100_000]), pa.array(slot[lo:lo + 100_000].astype(np.int32)),
                     pa.array(score[lo:lo + 100_000]), pa.array(i, mask=i == _NULL_ID)], names=["uid", "slot", "score", "id"])

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                at = np.frombuffer(r["at"], np.int32)
                w = r["width"]
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                m = _matrix(r["q"], len(ids), w)
                a = _matrix(r["a_q"], len(r["a_ids"]) // 8, w)
                parts = [held.pop(r["grp"], None)]
                for lo in range(0, len(at), 256):
                    part = at[lo:lo + 256]
                    s = _dots(a[part], m)
                    for slot in range(slots):
                        row, col = _best(s, allowed(slot, r, part, s, ids, labels), k)
                        parts.append((r["grp"] * 1024 + part[row].astype(np.int64), np.full(len(row), slot), s[row, col], ids[col]))
                uid, slot, score, found = (np.concatenate(x) for x in zip(*(p for p in parts if p is not None)))
                order = np.lexsort((found, -score, slot, uid))
                group = uid[order] * slots + slot[order]
                order = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
                held[r["grp"]] = tuple(x[order] for x in (uid, slot, score, found))
                if len(held) > keep:
                    yield from rows(held.popitem(last=False)[1])
        for state in held.values():
            yield from rows(state)

    found = jobs.mapInArrow(read, "uid long, slot int, score long, id long")
    best = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, block_rows: int = 1024, anchor_rows: int = 1024) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each of an anchor's first
    ``positives`` rows of its label the first ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` per cent of the positive's."""
    spark = vectors.sparkSession
    small_batches(spark)
    anchor_rows = min(max(anchor_rows, block_rows // 2), 1024)  # at most 64 groups from 32 blocks
    blocks = write_blocks(quantised(vectors, scale), block_rows)
    anchors = anchors_of(blocks, every, positives, anchor_rows)

    def same_label(r, upper, lower, labels):
        own = np.frombuffer(r["labels"], np.int64)
        has = np.stack([np.isin(own, x) for x in labels], 1)
        return has & (upper >= np.frombuffer(r["floors"], np.int64)[:, None])

    def positive(slot, r, at, s, ids, labels):
        return (labels == np.frombuffer(r["a_labels"], np.int64)[at][:, None]) & (ids != np.frombuffer(r["a_ids"], np.int64)[at][:, None])

    pos = materialise(_visit(blocks, anchors, _routes(blocks, anchors, same_label), positive, 1, positives)
                      .select("uid", (F.col("rank") - 1).alias("slot"), "score", F.col("id").alias("positive_id")),
                      "hardneg-positives")

    # the windows of a group's anchors: positives x (low, high), as one binary
    per_group = pos.groupBy(F.shiftright("uid", 10).alias("grp")).agg(
        F.collect_list(F.struct((F.col("uid") % 1024).alias("at"), "slot", "score")).alias("scores"))
    kind = anchors.schema
    cols = [c for c in anchors.columns if c != "windows"]

    def windows(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i in range(b.num_rows):
                scores = b.column(b.num_columns - 1)[i].as_py()
                n = len(b.column("ids")[i].as_py()) // 8
                win = np.zeros((n, positives, 2), np.int64)
                win[:, :, 0], win[:, :, 1] = 1, 0  # no window: nothing lies in it
                for x in scores:
                    win[x["at"], x["slot"]] = -(-low * x["score"] // 100), high * x["score"] // 100
                out.append(win.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(out, pa.binary())], names=kind.names)

    anchors = materialise(anchors.join(per_group, "grp").mapInArrow(windows, kind), "hardneg-windows")

    def shape(r, name="windows"):
        return np.frombuffer(r[name], np.int64).reshape(-1, positives, 2)

    def meets(r, upper, lower, labels):
        own, win = np.frombuffer(r["labels"], np.int64), shape(r)
        other = np.stack([~np.isin(own, x) if len(x) == 1 else np.ones(len(own), bool) for x in labels], 1)
        return other & ((upper[:, :, None] >= win[:, None, :, 0]) & (lower[:, :, None] <= win[:, None, :, 1])
                        & (win[:, None, :, 0] <= win[:, None, :, 1])).any(2)

    def negative(slot, r, at, s, ids, labels):
        win = shape(r)[at, slot]
        return ((labels != np.frombuffer(r["a_labels"], np.int64)[at][:, None]) & (s >= win[:, :1]) & (s <= win[:, 1:])
                & (ids != np.frombuffer(r["a_ids"], np.int64)[at][:, None]))

    def home(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                own = np.frombuffer(b.column(1)[i].as_py(), np.int64)
                found = np.unique(own)
                yield pa.RecordBatch.from_pydict(
                    {"grp": [b.column(0)[i].as_py()] * len(found), "block": found.tolist(),
                     "at": [np.flatnonzero(own == x).astype(np.int32).tobytes() for x in found]})

    # the own blocks first: a window starts at the last negative found there
    at_home = anchors.select("grp", "home").mapInArrow(home, "grp long, block long, at binary")
    last = _visit(blocks, anchors, at_home, negative, positives, negatives).where(F.col("rank") == negatives)
    raised = last.groupBy(F.shiftright("uid", 10).alias("grp")).agg(
        F.collect_list(F.struct((F.col("uid") % 1024).alias("at"), "slot", "score")).alias("scores"))

    def narrowed(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i in range(b.num_rows):
                win = shape({"windows": b.column("windows")[i].as_py()}).copy()
                for x in b.column(b.num_columns - 1)[i].as_py() or ():
                    win[x["at"], x["slot"], 0] = x["score"]
                out.append(win.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(out, pa.binary())], names=kind.names)

    anchors = materialise(anchors.join(raised, "grp", "left").mapInArrow(narrowed, kind), "hardneg-narrowed")
    neg = _visit(blocks, anchors, _routes(blocks, anchors, meets), negative, positives, negatives)
    names = anchors.select("grp", "ids")

    def spell(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0)[i].as_py() * 1024 + np.arange(len(ids))), pa.array(ids)],
                                                 names=["uid", "anchor_id"])

    names = names.mapInArrow(spell, "uid long, anchor_id long")
    out = neg.join(pos.select("uid", "slot", "positive_id", F.col("score").alias("positive_score")), ["uid", "slot"]).join(names, "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh id gets the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


def oracle() -> str:
    score = "CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT)"
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {score} AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM r WHERE rank <= 3"""
