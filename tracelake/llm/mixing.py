"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every document gets a hash position (of its id and text) inside its source; the finish time of its
k-th copy is ``(k * source_size + cumulative size) / target``, so all sources
progress alike from 0 to 1.  The copies in finish order are cut at the total
budget.  Both running sums are two-level (hash or finish-time ranges of about
``BUCKET_ROWS`` rows, their totals, then a window inside each range), so a source
with a third of all rows is spread over many tasks.  The range of the cut is the
only one that is sorted.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` times all sizes; a target stops at ``epochs`` times its source's
size and the excess is shared again by weight, i.e. ``min(epochs * size, L * weight)``
with the level L found from prefix sums over the sources (one row each).

Edge cases: null text has size 0 and is never taken; null ``doc_id`` and null
source are ordinary values (one more source); equal rows are separate rows in a
fixed order; an empty table or one without words gives targets of 0 and takes
nothing; extra columns are ignored (``mix_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialise, small_side

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
SIGN = 1 << 63


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """The narrow rows that are mixed; ``_t`` tells texts of equal ids apart."""
    return docs.select(
        F.col("doc_id"), F.col("source"),
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("_s"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("_t"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))


def _bucket(n: int):
    """Range of the hash (0 .. n-1), monotone in it."""
    return F.floor((F.col("_h").cast("double") + float(SIGN)) / float(2 * SIGN) * n).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``_s, source, source_size`` -> with ``target``; the windows run over one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(epochs)
    s = sizes.withColumn("_w", w).withColumn("_c", cap)
    by = Window.orderBy(F.col("_c") / F.col("_w"), F.col("_s"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("_c").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.withColumn("_l", level).withColumn("_level", F.max("_l").over(Window.partitionBy()))
    return s.select("_s", "source", "source_size", F.least("_c", F.col("_level") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies`` (and row keys)."""
    rows = materialise(_keyed(docs, seed), "mix-rows")
    n, budget = rows.agg(F.count(F.lit(1)), F.sum("size")).first()  # two numbers
    ranges = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("_b", _bucket(ranges))
    totals = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_bs"), F.first("source").alias("source"))
    sizes = totals.groupBy("_s").agg(F.first("source").alias("source"), F.sum("_bs").alias("source_size"))
    targets = source_targets(sizes, weights, share, epochs)
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.select("_s", "_b", F.coalesce(F.sum("_bs").over(ahead), F.lit(0)).alias("_off"))
               .join(targets.drop("source"), "_s"))
    inside = (Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size", "_t")
              .rowsBetween(Window.unboundedPreceding, 0))
    timed = (rows.withColumn("_in", F.sum("size").over(inside)).join(offsets, ["_s", "_b"])
             .withColumn("_cum", F.col("_off") + F.col("_in")).drop("_b", "_in", "_off"))
    timed = materialise(timed, "mix-times")
    finish = [(F.col("source_size") * k + F.col("_cum")) / F.col("target") for k in range(epochs)]
    keys = ["_f", "_s", "_h", "doc_id", "_t", "_cum"]

    def key(f):
        return F.struct(f.alias("_f"), "_s", "_h", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"),
                        F.coalesce("_t", F.lit(0)).alias("_t"), "_cum")

    # finish times run from 0 to about 1: equal ranges hold about equal numbers of words
    copies = (timed.where(F.col("size") > 0).select("size", F.explode(F.array(*[key(f) for f in finish])).alias("k"))
              .select("size", "k.*").withColumn("_r", F.floor(F.col("_f") * ranges).cast("long")))
    limit = (budget or 0) * share
    sums = copies.groupBy("_r").agg(F.sum("size").alias("_n"))
    run = sums.withColumn("_upto", F.sum("_n").over(Window.orderBy("_r")))
    cut = run.where(F.col("_upto") > limit).orderBy("_r").limit(1).first()
    if cut is None:
        taken = [F.lit(True)] * epochs
    else:
        r, left = cut["_r"], limit - (cut["_upto"] - cut["_n"])
        last = (copies.where(F.col("_r") == r)
                .withColumn("_run", F.sum("size").over(Window.partitionBy("_r").orderBy(*keys)
                                                       .rowsBetween(Window.unboundedPreceding, 0)))
                .where(F.col("_run") <= left).agg(F.max(F.struct(*keys)).alias("k")).first()["k"])
        end = F.lit(r)
        if last is None:
            taken = [F.floor(f * ranges) < end for f in finish]
        else:
            at = F.struct(F.lit(last["_f"]).alias("_f"), F.lit(last["_s"]).alias("_s"), F.lit(last["_h"]).alias("_h"),
                          F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["_t"]).cast("long").alias("_t"),
                          F.lit(last["_cum"]).cast("long").alias("_cum"))
            taken = [(F.floor(f * ranges) < end) | (key(f) <= at) for f in finish]
    copies_taken = sum((F.coalesce(t, F.lit(False)).cast("long") for t in taken[1:]),
                       F.coalesce(taken[0], F.lit(False)).cast("long"))
    return timed.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
                        F.when(F.col("size") > 0, copies_taken).otherwise(F.lit(0)).cast("long").alias("copies"),
                        "_s", "_t").withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, all its columns kept.

    Decisions are collapsed to one narrow row for each id, source and text; whole
    texts meet them in one join.  Only rows that are equal in the three are numbered; they share their copies evenly."""
    rows = ["_i", "_s", "_t"]
    ident = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_i"), F.col("_s"), F.col("_t")]
    keep = (mix(docs, **options).select(*ident, F.col("copies")).groupBy(*rows)
            .agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_all")))
    keep = materialise(keep.where(F.col("_all") > 0), "mix-decisions")
    s = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("_s")
    whole = docs.select(F.struct("*").alias("_d"), ident[0], s, F.xxhash64("text").alias("_t"))
    whole = whole.join(small_side(keep, F.length("_i") + F.length("_s") + 40, 16 << 20), rows)
    one = whole.where(F.col("_rows") == 1).select("_d", F.col("_all").alias("_copies"))
    number = F.row_number().over(Window.partitionBy(*rows).orderBy(F.lit(0)))
    share = F.floor(F.col("_all") / F.col("_rows")) + (number <= F.col("_all") % F.col("_rows")).cast("long")
    many = whole.where(F.col("_rows") > 1).select("_d", share.alias("_copies"))
    return (one.unionByName(many).where(F.col("_copies") > 0)
            .select("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_d.*"))
