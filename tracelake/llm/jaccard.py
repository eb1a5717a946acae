"""Exact n-gram Jaccard join of whole texts as a recursive metric-space join.

Documents are points by their sets of word n-grams; a link is a Jaccard distance of at most ``1 - num/den``, which
bounds the symmetric difference ``|x ^ y|``, a metric, by ``(den - num) / (den + num) * (|x| + |y|)``.

1. Equal sets are one point (a class); its representative is the smallest doc id.
2. Unrelated texts are all at distance 1, where documents as pivots part nothing.  So the outermost regions are
   balls below distance 1: the holders of one shingle.  Shingles have a global order (rare before very
   common ones) and a point is in the regions of its first ones, up to place ``n - ceil(num * n / den) + 1``: two
   linked points share a region.
3. Every region's smallest point is a pivot: its distance to the others is taken exactly, links join components.
   Only regions that still hold several components stay open.
4. An open region is joined recursively (``voronoi_pairs``).  Documents in it are pivots: first the one
   nearest to the region's centre, then the farthest ones.  Each point belongs to the Voronoi cell of its nearest pivot
   and is replicated into every cell whose pivot is at most twice its own link bound farther: by the triangle
   inequality no link leaves these windows.  Cells are joined the same way; one that is small, or that no
   pivot parts, compares the points whose distances to its pivot differ by the link bound at most.  Distances here are
   those of parity sketches (one bit for each of 512 classes of shingles): a metric that never exceeds
   ``|x ^ y|``, so windows are safe.  What is left is compared exactly on the whole sets.
   Regions of more than ``block`` points are cut into blocks; pairs of blocks meet.
5. Links and equal sets give components.

Nothing is capped: the order of shingles, sketches and the Bloom filter only save work.
Very common shingles are those that some part of the corpus holds in a fixed share of
its documents; their list is bounded by ``max_common``.

Edge cases: null and white-space-only texts have no shingle and link with
nothing; texts shorter than n words are one shingle; a null ``doc_id`` is returned
with its set size and itself (null) as component and links with nothing; equal rows and equal ids give
one row per input row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bytewords import mix, text_chunks, word_hashes
from tracelake.llm.common import connected_components, drop_tables, materialise, scratch, tidy, worker_cache

SKETCH_BITS = 512
_MUL = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def ngram_sets(column, n: int):
    """Yield ``(row, sorted distinct 64-bit n-gram hashes)`` of an Arrow string column."""
    worker_cache("jaccard")
    for lo, data, bounds in text_chunks(column):
        h, row = word_hashes(data, bounds)
        rows = len(bounds) - 1
        count = np.bincount(row, minlength=rows)
        first = np.cumsum(count) - count
        g = np.zeros(len(h), np.uint64)
        m = max(0, len(h) - n + 1)
        for k in range(n):
            g[:m] += h[k:k + m] * _MUL[k % len(_MUL)] + np.uint64(k)
        g = mix(g)
        for r in range(rows):
            c, a = int(count[r]), int(first[r])
            if c >= n:
                yield lo + r, np.unique(g[a:a + c - n + 1])
            elif c:
                x = np.array([c], np.uint64)
                for k in range(a, a + c):
                    x = mix(x ^ h[k:k + 1])
                yield lo + r, x
            else:
                yield lo + r, g[:0]


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_len(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def sketch(s: np.ndarray) -> bytes:
    """One bit for each class of shingles: is the number of its members odd?  An element more or less flips one
    bit, so sketches differ in at most ``|x ^ y|`` bits."""
    counts = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)


def common_shingles(docs: DataFrame, n: int, share: float, max_common: int, part: int = 1_000_000) -> np.ndarray:
    """Shingles that at least ``share`` of the documents of some part of the corpus hold, least common
    first; all documents are counted.  A shingle with that share overall is among them."""
    def count(batches):
        import pyarrow as pa

        held, size, texts = [], 0, 0

        def out():
            v, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            keep = c >= max(8, share * texts)
            return pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))],
                                              names=["s", "c"])

        for b in batches:
            for _, s in ngram_sets(b.column(0), n):
                held.append(s)
                size += len(s)
                texts += 1
                if size > part:
                    yield out()
                    held, size, texts = [], 0, 0
        yield out()

    top = (docs.select("text").mapInArrow(tidy(count), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
           .orderBy(F.desc("c"), "s").limit(max_common).toArrow())  # at most max_common rows
    return top["s"].to_numpy().view(np.uint64)[::-1].copy()


def signatures(docs: DataFrame, n: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """``doc_id, c, n, prefix, sketch`` of every document that has a shingle."""
    order = np.argsort(common, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))
    schema = "doc_id long, c long, n int, prefix array<long>, sketch binary"

    def sign(batches):
        import pyarrow as pa

        keys, rank = shared.value
        for b in batches:
            ids, out, prefixes = b.column(0).to_pylist(), [], []
            for k, s in ngram_sets(b.column(1), n):
                if not len(s) or ids[k] is None:
                    continue
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    hot = keys[at] == s
                    ordered = np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]])]])
                else:
                    ordered = s
                prefixes.append(ordered[:prefix_len(len(s), num, den)].view(np.int64))
                out.append((ids[k], class_of(s), len(s), sketch(s)))
            d, c, m, x = zip(*out) if out else ((),) * 4
            off = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(c, pa.int64()), pa.array(m, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)), pa.array(x, pa.binary())],
                names=["doc_id", "c", "n", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(sign), schema)


FINE = 512


def fine_sketch(s: np.ndarray) -> bytes:
    """The same with many classes in 8 bits each: sharper, for pairs that are about to be verified."""
    return np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=FINE), 255).astype(np.uint8).tobytes()


def _possible(na, nb, low, num, den):
    """Size window and ``low <= |x ^ y|``: pairs that may be linked."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    # linked: |x ^ y| <= (den - num) / (den + num) * (|x| + |y|)
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (low.astype(np.int64) * (den + num) <= (den - num) * (na + nb))


def _sketches(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def voronoi_pairs(vec, n, wanted, num: int, den: int, leaf: int = 64, pivots: int = 8, max_pairs: int = 100_000):
    """Yield ``(i, j)``: all pairs of points that ``wanted(i, j)`` allows and whose sizes and sketches allow a link."""
    reach = n.astype(np.int64) * (den - num) // num  # no link of a point differs in more
    stack = [(np.arange(len(vec)), np.zeros(0, np.int64))]  # points of a cell, replicated points
    while stack:
        own, guests = stack.pop()
        if not len(own) or len(own) + len(guests) < 2:
            continue
        every = np.concatenate([own, guests])
        bound = reach[every]
        centre = np.packbits(np.unpackbits(vec[own].view(np.uint8), axis=1).mean(0) >= 0.5).view(np.uint64)
        first = own[np.argmin(bits_apart(vec[own], centre))]
        apart = [bits_apart(vec[every], vec[first])]
        if len(every) > leaf:
            nearest = apart[0][:len(own)].copy()
            while len(apart) < pivots:
                far = int(np.argmax(nearest - bound[:len(own)]))
                if nearest[far] <= bound[far]:
                    break
                apart.append(bits_apart(vec[every], vec[own[far]]))
                nearest = np.minimum(nearest, apart[-1][:len(own)])
        if len(apart) > 1:
            d = np.stack(apart, 1)
            home = d.argmin(1)
            inside = d <= (d.min(1) + 2 * bound)[:, None]
            is_own = np.arange(len(every)) < len(own)
            cells = []
            for q in range(d.shape[1]):
                # a pair of two cells is found in the first of them
                cells.append((every[is_own & (home == q)], every[inside[:, q] & ((is_own & (home > q)) | ~is_own)]))
            if max(len(a) + len(b) for a, b in cells) <= 0.8 * len(every):
                stack += cells
                continue
        # the triangle inequality by the first pivot: only points of similar distance to it
        order = np.argsort(apart[0], kind="stable")
        at, dist, mine = every[order], apart[0][order], order < len(own)
        after = np.searchsorted(dist, dist + bound[order], "right") - np.arange(len(at)) - 1
        done = np.cumsum(after)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + max_pairs, "right")))
            k = after[lo:hi]
            i = np.repeat(np.arange(lo, hi), k)
            j = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + i + 1
            lo = hi
            ok = mine[i] | mine[j]
            i, j = at[i[ok]], at[j[ok]]
            ok = wanted(i, j)
            i, j = i[ok], j[ok]
            ok = _possible(n[i], n[j], bits_apart(vec[i], vec[j]), num, den)
            if ok.any():
                yield i[ok], j[ok]


def star_candidates(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of the pairs whose sizes and sketches allow a link."""
    r = reps.select("c", "n", "sketch")
    j = (pairs.join(r.toDF("a", "na", "sa"), "a").join(r.toDF("b", "nb", "sb"), "b")
         .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
         .select("a", "b", "na", "nb", "sa", "sb"))

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                ok = _possible(b.column(2).to_numpy(), b.column(3).to_numpy(),
                               bits_apart(_sketches(b.column(4)), _sketches(b.column(5))), num, den)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return j.mapInArrow(tidy(keep), "a long, b long")


def region_candidates(regions: DataFrame, num: int, den: int, max_pairs: int = 100_000, leaf: int = 64) -> DataFrame:
    """``regions(key, side, c, comp, n, sketch)`` -> possible pairs ``a < b`` of different components.

    Rows come sorted by key; a key has at most two blocks of bounded size.  A key with two sides
    compares across them, one with a single side compares inside it.  Regions of more than ``leaf`` points
    are joined recursively, the small ones of a batch all at once."""
    def join(batches):
        import pyarrow as pa

        held = None

        def batch(t, i, j):
            a, b = t["c"][i], t["c"][j]
            p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

        def pairs(t):
            key, side, comp = t["key"], t["side"], t["comp"]
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            sizes = np.diff(np.append(starts, len(key)))

            def wanted(i, j):
                return (comp[i] != comp[j]) & ((key[i, 1] == key[i, 2]) | (side[i] != side[j]))

            for at, size in zip(starts[sizes > leaf].tolist(), sizes[sizes > leaf].tolist()):
                own = slice(at, at + size)
                if comp[own].min() < comp[own].max():
                    for i, j in voronoi_pairs(t["sketch"][own], t["n"][own], lambda i, j: wanted(i + at, j + at), num, den, leaf,
                                              max_pairs=max_pairs):
                        yield batch(t, i + at, j + at)
            # of the small regions row i pairs with the rows after it, a bounded number of pairs at a time
            after = np.repeat(np.where(sizes > leaf, 0, starts + sizes), sizes) - np.arange(len(key)) - 1
            after = np.maximum(after, 0)
            done = np.cumsum(after)
            lo = 0
            while lo < len(after):
                hi = int(np.searchsorted(done, (done[lo - 1] if lo else 0) + max_pairs, "right"))
                hi = max(hi, lo + 1)
                k = after[lo:hi]
                i = np.repeat(np.arange(lo, hi), k)
                j = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + i + 1
                lo = hi
                ok = wanted(i, j)
                i, j = i[ok], j[ok]
                ok = _possible(t["n"][i], t["n"][j], bits_apart(t["sketch"][i], t["sketch"][j]), num, den)
                if ok.any():
                    yield batch(t, i[ok], j[ok])

        def load(b):
            key = np.stack([b.column(x).to_numpy().astype(np.int64) for x in range(3)], 1)
            return {"key": key, "side": b.column(3).to_numpy(), "c": b.column(4).to_numpy(), "comp": b.column(5).to_numpy(),
                    "n": b.column(6).to_numpy(), "sketch": _sketches(b.column(7))}

        for b in batches:
            if not b.num_rows:
                continue
            t = load(b)
            if held is not None:
                t = {k: np.concatenate([held[k], t[k]]) for k in t}
            change = np.flatnonzero((t["key"][1:] != t["key"][:-1]).any(1))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last region may go on in the next batch
            held = {k: v[cut:] for k, v in t.items()}
            if cut:
                yield from pairs({k: v[:cut] for k, v in t.items()})
        if held is not None:
            yield from pairs(held)

    cols = ["s", "i", "j", "side", "c", "comp", "n", "sketch"]
    return (regions.select(*cols).repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
            .mapInArrow(tidy(join), "a long, b long").distinct())


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, bits: int = 22) -> DataFrame:
    """The pairs ``a, b`` (classes) that are linked, from the whole sets of their representatives.

    The texts are read again; a Bloom filter of fixed size lets most of the others pass by."""
    spark = docs.sparkSession
    wanted = (pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(reps.select("c", "rep"), "c"))
    wanted = materialise(wanted, "wanted")
    mask = (1 << bits) - 1
    slot = F.col("c").bitwiseXOR(F.col("rep")).bitwiseAND(F.lit(mask))  # names of classes are hashes
    words = (wanted.select(slot.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow())  # <= 2**bits / 64 rows
    bloom = np.zeros((1 << bits) // 64, np.int64)
    bloom[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = spark.sparkContext.broadcast(bloom)

    def classes(batches):
        import pyarrow as pa

        table = shared.value

        def batch(out):
            c, m, f, x = zip(*out) if out else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(m, pa.int32()), pa.array(f, pa.binary()),
                                               pa.array(x, pa.binary())], names=["c", "n", "f", "set"])

        for b in batches:
            ids, out, size = b.column(0).to_pylist(), [], 0
            for k, s in ngram_sets(b.column(1), n):
                if not len(s) or ids[k] is None:
                    continue
                c = class_of(s)
                p = (c ^ ids[k]) & mask
                if (int(table[p >> 6]) >> (p & 63)) & 1:
                    out.append((c, len(s), fine_sketch(s), s.tobytes()))
                    size += s.nbytes
                if size > 4_000_000:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)

    # one shuffle of the sets by class; what only passed the filter by chance goes there as well
    sets = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(classes), "c long, n int, f binary, set binary")
    sets = sets.join(wanted.select("c"), "c", "left_semi").dropDuplicates(["c"])
    sets = materialise(sets, "sets")

    def near(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                fa, fb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int16) for i in (4, 5))
                ok = _possible(b.column(2).to_numpy(), b.column(3).to_numpy(), np.abs(fa - fb).sum(1), num, den)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    # sketches travel with every pair, whole sets only with the pairs that they leave
    f, sets = sets.select("c", "n", "f"), sets.select("c", "set")
    pairs = (pairs.join(f.toDF("a", "na", "fa"), "a").join(f.toDF("b", "nb", "fb"), "b")
             .select("a", "b", "na", "nb", "fa", "fb").mapInArrow(tidy(near), "a long, b long"))
    pairs = materialise(pairs, "near")  # small joins leave no shuffle here: a task would hold two Python workers
    j = (pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb"))

    def exact(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return j.mapInArrow(tidy(exact), "a long, b long")


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, common_share: float = 0.001,
                  max_common: int = 200_000, block: int = 2048, leaf: int = 64):
    """``(documents, links, classes)``: ``doc_id, c, n, rep`` of every document with a shingle, links
    ``a, b`` between classes (all that join different components) and the classes.  Tables of whole prefixes and
    sets are deleted as soon as nothing reads them."""
    spark, used = docs.sparkSession, []

    def verified(pairs):
        with scratch(used):
            out = verify(pairs, reps, docs, n, num, den)
        out = materialise(out, "links")
        drop_tables(spark, used)
        return out

    common = common_shingles(docs, n, common_share, max_common)
    with scratch(used):
        sigs = materialise(signatures(docs, n, num, den, common), "signatures")
    reps = materialise(sigs.groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                             F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "classes")
    documents = materialise(sigs.select("doc_id", "c", "n").join(reps.select("c", "rep"), "c"), "members")
    drop_tables(spark, used)
    rows = reps.select("c", F.explode("prefix").alias("s"))
    pivots = rows.groupBy("s").agg(F.min("c").alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
    regions = materialise(rows.join(pivots, "s"), "regions")
    # the pivot of each region against its points
    stars = regions.where("c != p").select(F.col("p").alias("a"), F.col("c").alias("b")).distinct()
    stars = materialise(star_candidates(stars, reps, num, den), "stars")
    links = verified(stars)
    # points of different components inside one region
    comp = connected_components(links).withColumnRenamed("id", "c")
    named = regions.join(comp, "c", "left").withColumn("comp", F.coalesce("component_id", "c")).select("s", "c", "comp", "k")
    mixed = (named.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s"))
    blocks = F.ceil(F.col("k") / block).cast("int")
    open_ = (named.join(mixed, "s").join(reps.select("c", "n", "sketch"), "c").withColumn("m", blocks)
             .withColumn("side", F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
             .withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o")))
    rest = region_candidates(open_, num, den, leaf=leaf)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(rest.join(done, ["a", "b"], "left_anti"), "rest")
    return documents, links.unionByName(verified(rest)), reps


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n`` of every row."""

    def size(batches):
        import pyarrow as pa

        for b in batches:
            out = np.zeros(b.num_rows, np.int32)
            for k, s in ngram_sets(b.column(1), n):
                out[k] = len(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(size), "doc_id long, n int")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest doc id reachable by links)."""
    documents, links, reps = jaccard_links(docs, n, num, den, **options)
    name = reps.select("c", "rep")
    edges = (links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
             .unionByName(documents.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    comp = connected_components(edges).withColumnRenamed("id", "doc_id")
    whole = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"))
    # documents without shingles, and every row of a repeated id
    count = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_with"))
    none = (whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_all")).join(count, "doc_id", "left")
            .select("doc_id", F.expr("_all - coalesce(_with, 0)").alias("_k")).where("_k > 0")
            .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).select("doc_id", F.lit(0).alias("n")))
    nameless = set_sizes(docs.where(F.col("doc_id").isNull()), n)
    return (documents.select("doc_id", "n").unionByName(none).join(comp, "doc_id", "left").unionByName(
        nameless.withColumn("component_id", F.col("doc_id")))
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))
