"""Seeded shuffle, exact train/validation split, fixed and per-epoch batches.

Exact global positions without a single-partition window: the shuffle key
``md5(seed ':' id)`` (ties broken by id) is range-sorted, every row gets
``monotonically_increasing_id`` (consecutive inside a partition) and its
partition id, the tiny per-partition count table is prefix-summed and joined
back (its size is the number of partitions, a proven bound).  The sorted key
table is checkpointed to the shared checkpoint folder first, so both passes see
one layout and a lost executor does not re-sample the range boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import checkpoint_dir


def shuffle_key(seed, id_col: str, *extra) -> F.Column:
    parts = [F.lit(str(seed))]
    for e in extra:
        parts += [F.lit(":"), F.col(e).cast("string")]
    parts += [F.lit(":"), F.col(id_col).cast("string")]
    return F.md5(F.concat(*parts))


def global_positions(df: DataFrame, order_cols: list[str], out: str = "pos", keys: list[str] | None = None,
                     checkpoint: bool = True) -> DataFrame:
    """0-based position of every row in the total order ``order_cols`` (must be unique).

    Only ``keys + order_cols`` go through the sort; the result is keyed by
    ``keys`` (default: ``order_cols``) and is joined back by the caller.
    """
    keys = keys or order_cols
    cols = list(dict.fromkeys([*keys, *order_cols]))
    s = (df.select(*cols).repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        checkpoint_dir(df.sparkSession)
        s = s.checkpoint(eager=True)
    # one row per partition: a bounded metadata table, prefix-summed on the driver
    counts = sorted(s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")).collect())
    offs, run = [], 0
    for pid, n, m0 in counts:
        offs.append((pid, run, m0))
        run += n
    offs_df = df.sparkSession.createDataFrame(offs, "_pid int, _off long, _m0 long")
    return (s.join(F.broadcast(offs_df), "_pid")
            .select(*keys, (F.col("_off") + F.col("_mid") - F.col("_m0")).alias(out)))


def seeded_shuffle(df: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Seeded permutation: ``id, shuffle_key, pos`` ordered by ``(md5(seed:id), id)``."""
    k = df.select(id_col, shuffle_key(seed, id_col).alias("shuffle_key"))
    pos = global_positions(k, ["shuffle_key", id_col], keys=[id_col])
    return k.join(pos, id_col)


def train_val_split(df: DataFrame, id_col: str = "doc_id", seed: int = 42, train_frac: float = 0.95,
                    exact: bool = True) -> DataFrame:
    """First ``int(n * train_frac)`` rows after the shuffle are ``train``, the rest ``val``.

    ``exact=False``: row-local ``pmod(hash, 100) < 100 * train_frac`` -- no
    global order, approximate sizes (the scale default for streaming corpora).
    """
    if not exact:
        h = F.pmod(F.conv(F.substring(shuffle_key(seed, id_col), 1, 8), 16, 10).cast("long"), F.lit(100))
        return df.withColumn("split", F.when(h < int(round(100 * train_frac)), "train").otherwise("val"))
    s = seeded_shuffle(df.select(id_col), id_col, seed)
    n = s.count()  # a scalar: the cut point is int(n * train_frac)
    cut = int(n * train_frac)
    return s.select(id_col, "pos", F.when(F.col("pos") < cut, "train").otherwise("val").alias("split"))


def fixed_batches(df: DataFrame, id_col: str = "doc_id", seed: int = 42, batch_size: int = 1000) -> DataFrame:
    """Consecutive groups of ``batch_size`` in shuffled file order; the last partial batch is kept."""
    s = seeded_shuffle(df.select(id_col), id_col, seed)
    return s.select(id_col, "pos", F.floor(F.col("pos") / batch_size).cast("long").alias("batch_id"))


def epoch_batches(df: DataFrame, epochs: int = 2, batch_size: int = 4, id_col: str = "doc_id", seed: int = 42,
                  drop_last: bool = True) -> DataFrame:
    """Per epoch a fresh seeded order, batches of ``batch_size``; with ``drop_last`` the
    short last batch is dropped (training loader), else kept (eval loader).
    The epoch column is a generator (``explode(sequence(1, E))``), not a join."""
    e = df.select(id_col).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    e = e.withColumn("_k", shuffle_key(seed, id_col, "epoch"))
    pos = global_positions(e, ["epoch", "_k", id_col], keys=["epoch", id_col])
    # positions are global over (epoch, key): rebase on the epoch's first position
    per = pos.groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_s"))
    b = pos.join(F.broadcast(per), "epoch").withColumn("epos", F.col("pos") - F.col("_s"))
    b = b.withColumn("batch", F.floor(F.col("epos") / batch_size).cast("long"))
    if drop_last:
        b = b.where(F.col("batch") < F.floor(F.col("_n") / batch_size))
    return b.select("epoch", id_col, "epos", "batch")


def accumulation_steps(batches: DataFrame, accum: int = 8, warmup_frac: float = 0.05) -> DataFrame:
    """Optimizer steps from micro-batches: one step per ``accum`` batches of an epoch,
    the remainder makes none.  ``epoch, batch, opt_step`` (NULL for remainder
    batches), plus ``total_steps = (batches // accum) * epochs`` and
    ``warmup_steps = int(total * warmup_frac)``."""
    nb = batches.groupBy("epoch").agg(F.countDistinct("batch").alias("_nb"))
    e = batches.select("epoch", "batch").distinct().join(F.broadcast(nb), "epoch")
    steps = F.floor(F.col("_nb") / accum)
    e = e.withColumn("_spe", steps)
    total = int(nb.agg(F.sum(F.floor(F.col("_nb") / accum))).first()[0] or 0)  # a scalar
    return e.select(
        "epoch", "batch",
        F.when(F.col("batch") < F.col("_spe") * accum,
               (F.col("epoch") - 1) * F.col("_spe") + F.floor(F.col("batch") / accum)).cast("long").alias("opt_step"),
        F.lit(total).cast("long").alias("total_steps"),
        F.lit(int(total * warmup_frac)).cast("long").alias("warmup_steps"))
