"""Exact ranked lexical search over whole texts, with equal bags scored once.

1. Items are taken in blocks of about ``max_entries`` distinct (item, term) entries, so that what a
   task holds of them has a bound; there is one block unless the items are many.  Blocks are dealt
   by a hash of the item, and every block meets all documents.
2. Every text is cut into terms once per block.  Only the terms of the block's items are kept: a bag is the sorted
   (term, tf) vector, with ``n``, the number of all terms.  Bags go to the shared folder.
3. ``N`` and ``L`` are sums over the bags, document frequencies are per-task counts added up.
4. Bags of one 64-bit hash, one vector (compared byte by byte) and one ``m`` are one class; it keeps its
   smallest doc_id.  Classes, not documents, are scored: every class against every item it shares a
   term with.  A task keeps ``k`` classes per item by (score, smallest doc_id); these merge by a window.
   A document of any other class stands behind ``k`` documents, one of each kept class.
5. Kept classes are expanded: their ``k`` smallest doc_ids are enough for any item, for equal scores
   rank by doc_id.

The function that cuts terms sees the UTF-8 bytes: separators are ASCII, so no character is cut.

Edge cases: null and empty texts, and texts of separators only, have no term, count nowhere and match nothing;
rows of equal doc_id are documents of their own; a null doc_id ranks behind the others of equal score;
item rows of equal id are one item with the terms of all (a null id is an id of its own); items
without a known term, and empty tables, give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialise, small_batches, small_side

#: bytes that are no part of a term become spaces, A-Z becomes a-z
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))
#: stands for a null doc_id inside a task: behind every other
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _item_terms(items: DataFrame, item: str) -> DataFrame:
    """``item, term`` distinct."""
    kind = items.schema[item].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = set(terms(t))
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())],
                                             names=["item", "term"])

    rows = items.where(F.col("text").isNotNull()).select(F.col(item).alias("item"), F.encode("text", "UTF-8").alias("t"))
    return rows.mapInArrow(cut, f"item {kind}, term binary").distinct()


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, vec``: vec is the term ids and then the frequencies, 32 bits each; empty without a known term."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches):
        import pyarrow as pa

        get = known.value.get
        for b in batches:
            n, vec, keep = [], [], []
            for i in range(b.num_rows):
                words = terms(b.column(1)[i].as_py())
                if not words:
                    continue
                ids = np.array([x for x in map(get, words) if x is not None], dtype="<u4")
                keep.append(i)
                n.append(len(words))
                vec.append(b"".join(x.astype("<u4").tobytes() for x in np.unique(ids, return_counts=True)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                                              pa.array(vec, pa.binary())], names=["doc_id", "n", "vec"])

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("t"))
    return rows.mapInArrow(count, "doc_id long, n long, vec binary").withColumn("h", F.xxhash64("vec"))


def _frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for b in batches:
            ids = [np.frombuffer(v, "<u4")[: len(v) // 8] for v in b.column(0).to_pylist()]
            if ids:
                total += np.bincount(np.concatenate(ids), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["t", "df"])

    sums = bags.select("vec").mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    df = np.zeros(size, np.int64)
    for r in sums.collect():  # one row per term of the block
        df[r["t"]] = r["df"]
    return df


def _best_classes(classes: DataFrame, weights: np.ndarray, of_term: list[np.ndarray], n_items: int, k: int) -> DataFrame:
    """``item, score, first, cid``: for every item a task's ``k`` best classes by (score, smallest doc_id)."""
    starts = np.cumsum([0, *(len(x) for x in of_term)])
    index = (weights, starts, np.concatenate(of_term) if of_term else np.zeros(0, np.int64))
    shared = classes.sparkSession.sparkContext.broadcast(index)
    step = max(1, 400_000 // max(1, n_items))

    def score(batches):
        import pyarrow as pa

        w, starts, postings = shared.value
        least = np.ones(n_items, np.int64)  # a score below is of no use any more
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def compact():
            nonlocal held, size
            item, points, first, cid = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((cid, first, -points, item))
            item = item[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            keep = order[place < k]
            full = order[place == k - 1]
            held = [tuple(x[keep] for x in (np.concatenate(y) for y in zip(*held)))]
            least[held[0][0][np.isin(keep, full)]] = points[full]
            size = len(keep)

        for b in batches:
            cid = np.asarray(b.column(0))
            first = np.asarray(b.column(1).fill_null(_LAST))
            m = np.asarray(b.column(2))
            vecs = b.column(3)
            for lo in range(0, b.num_rows, step):
                rows = range(lo, min(lo + step, b.num_rows))
                parts = [np.frombuffer(vecs[r].as_py(), "<u4").astype(np.int64) for r in rows]
                half = [len(p) // 2 for p in parts]
                at = np.repeat(np.arange(len(parts)), half)
                ids = np.concatenate([p[:h] for p, h in zip(parts, half)])
                tf = np.concatenate([p[h:] for p, h in zip(parts, half)])
                points = w[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[lo:][at]))
                total = np.zeros(len(parts) * n_items, np.int64)
                ends = np.cumsum(starts[ids + 1] - starts[ids])
                cut = 0
                while cut < len(ids):  # about 400,000 postings at a time
                    to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 400_000, "right")))
                    own, held_by = ids[cut:to], starts[ids[cut:to] + 1] - starts[ids[cut:to]]
                    where = np.arange(held_by.sum()) - np.repeat(np.cumsum(held_by) - held_by, held_by) \
                        + np.repeat(starts[own], held_by)
                    np.add.at(total, np.repeat(at[cut:to] * n_items, held_by) + postings[where],
                              np.repeat(points[cut:to], held_by))
                    cut = to
                total = total.reshape(len(parts), n_items)
                r, item = np.nonzero(total >= least)
                if len(r):
                    held.append((item, total[r, item], first[lo + r], cid[lo + r]))
                    size += len(r)
                if size > 200_000 + 2 * k * n_items:
                    compact()
        if held:
            compact()
            item, points, first, cid = held[0]
            for lo in range(0, len(item), 50_000):
                f = first[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[lo:lo + 50_000], pa.int64()), pa.array(points[lo:lo + 50_000], pa.int64()),
                     pa.array(f, pa.int64(), mask=f == _LAST), pa.array(cid[lo:lo + 50_000], pa.int64())],
                    names=["item", "score", "first", "cid"])

    return classes.select("cid", "first", "m", "vec").mapInArrow(score, "item long, score long, first long, cid long")


def _first(df: DataFrame, by: str, order: list, k: int, as_: str = "_n") -> DataFrame:
    return df.withColumn(as_, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int")).where(F.col(as_) <= k)


def _search_block(docs: DataFrame, entries: list, k: int) -> DataFrame:
    """``item`` (place in the block), ``rank, doc_id, score``; entries: (item's place, term)."""
    vocabulary = sorted({t for _, t in entries})
    place = {t: i for i, t in enumerate(vocabulary)}
    n_items = max(i for i, _ in entries) + 1
    of_term: list[list[int]] = [[] for _ in vocabulary]
    for i, t in entries:
        of_term[place[t]].append(i)
    bags = materialise(_bags(docs, vocabulary), "lexical-bags")
    n_docs, n_terms = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = _frequencies(bags, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    m = F.expr(f"50 + (cast(50 as decimal(38,0)) * n * {n_docs}) div {n_terms or 1}")
    bags = bags.where(F.length("vec") > 0).withColumn("m", m)
    classes = bags.groupBy("h", "m", "vec").agg(F.min("doc_id").alias("first"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "lexical-classes")
    found = _best_classes(classes, weights, [np.array(x, np.int64) for x in of_term], n_items, k)
    best = [F.desc("score"), F.asc_nulls_last("first"), "cid"]
    best_classes = materialise(_first(found, "item", best, k).drop("_n"), "lexical-best")
    wanted = materialise(classes.join(best_classes.select("cid").distinct(), "cid", "left_semi"), "lexical-wanted")
    members = bags.join(small_side(wanted.select("cid", "h", "m", "vec"), F.length("vec") + 32), ["h", "m", "vec"])
    members = members.select("cid", "doc_id")
    members = _first(members, "cid", [F.asc_nulls_last("doc_id")], k).drop("_n")
    rows = best_classes.select("item", "score", "cid").join(members, "cid")
    return _first(rows, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank") \
        .select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id",
           max_entries: int = 200_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    entries = materialise(_item_terms(items, item), "lexical-items")
    kind = entries.schema["item"].dataType.simpleString()
    blocks = math.ceil(entries.count() / max_entries)
    out = spark.createDataFrame([], f"{item} {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        own = entries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about max_entries rows
        if not own:
            continue
        ids = sorted({r["item"] for r in own}, key=lambda x: (x is None, x))
        place = {x: i for i, x in enumerate(ids)}
        found = _search_block(docs, [(place[r["item"]], bytes(r["term"])) for r in own], k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, {item} {kind}")
        out = out.unionByName(materialise(found.join(names, "item").select(item, "rank", "doc_id", "score"), "lexical-found"))
    return out


def oracle(k: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = (f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), "
           "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")
    return f"""WITH t AS (SELECT doc_id, {cut} AS term FROM documents),
i AS (SELECT DISTINCT item_id, {cut} AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM n, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {k}"""
