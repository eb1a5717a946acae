"""Window-style operators: metric logs, top-k sampling, turn caps, recovery detection.

Hot keys: a run / group / conversation may hold a third of all rows.  The
operators here avoid a whole-key window wherever the semantics allow it:
``row_number() / rank() <= k`` filters are planned with Spark's
``WindowGroupLimit`` (a partial top-k before the shuffle), running min/sum use
the two-level bucketed prefix of ``operators.common``, per-key aggregates are
partial + final hash aggregates, and "next turn" is an equi join on
``turn + 1`` instead of a ``lead`` window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.columns import hash_unit


# ---- metric logs ----------------------------------------------------------------

def eval_mean_loss(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss",
                   n_batches: int = 50) -> DataFrame:
    """Mean of the first ``n_batches`` valid losses (NaN not counted) per run; 0.0 if none."""
    runs = log.select(run).distinct()
    valid = log.where(~F.isnan(loss) & F.col(loss).isNotNull())
    w = Window.partitionBy(run).orderBy(step)
    first = valid.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n_batches)
    m = first.groupBy(run).agg(F.avg(loss).alias("_m"))
    return runs.join(m, run, "left").select(run, F.round(F.coalesce("_m", F.lit(0.0)), 6).alias("mean_loss"))


def running_min_prev(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                     bucket_rows: int = 65536) -> DataFrame:
    """Minimum of ``value`` over the rows strictly before each row (per key), two-level
    bucketed like ``running_sum`` so a hot key is spread over many tasks.
    ``order`` must be integral."""
    b = df.withColumn("_bk", F.floor(F.col(order) / F.lit(bucket_rows)).cast("long"))
    tot = b.groupBy(*keys, "_bk").agg(F.min(value).alias("_bm"))
    wo = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.min("_bm").over(wo)).drop("_bm")
    wi = Window.partitionBy(*keys, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.min(value).over(wi)
    return (b.join(off, [*keys, "_bk"]).withColumn(out, F.least(F.col("_off"), inner)).drop("_bk", "_off"))


def best_so_far(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss") -> DataFrame:
    """Per step: is this a new best loss (strictly below every earlier one)?
    NaN is never a best; the first finite value always is."""
    r = running_min_prev(log, [run], step, loss, "_prev")
    is_best = F.coalesce(F.col(loss) < F.col("_prev"), ~F.isnan(loss)) & ~F.isnan(loss)
    return r.withColumn("is_best", is_best).drop("_prev")


def checkpoint_best(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss") -> DataFrame:
    """Final best per run: the first step reaching the minimum loss (strict ``<``)."""
    v = log.where(~F.isnan(loss) & F.col(loss).isNotNull())
    return v.groupBy(run).agg(F.min_by(step, F.struct(loss, step)).alias("best_step"),
                              F.min(loss).alias("best_loss"))


BUDGET_US = int(11.5 * 3600 * 1_000_000)


def budget_cutoff(log: DataFrame, run: str = "run_id", step: str = "step", ts: str = "ts",
                  budget_us: int = BUDGET_US) -> DataFrame:
    """Keep a run's steps until the elapsed time since its first step reaches the
    budget (11.5 h); from the first breaching step on, everything is cut.

    Two partial aggregates (run start, first breach) and joins on the run id --
    no per-run window; AQE splits a skewed run in the joins.
    """
    start = log.groupBy(run).agg(F.min_by(ts, step).alias("_t0"))
    e = log.join(start, run).withColumn("elapsed_us", F.expr(f"timestampdiff(MICROSECOND, _t0, {ts})"))
    breach = e.where(F.col("elapsed_us") >= budget_us).groupBy(run).agg(F.min(step).alias("_cut"))
    k = e.join(breach, run, "left")
    return k.where(F.col("_cut").isNull() | (F.col(step) < F.col("_cut"))).drop("_t0", "_cut")


def clean_metric_log(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss",
                     every: int = 20) -> tuple[DataFrame, DataFrame]:
    """(kept rows: finite loss on every ``every``-th step, bad-loss count per run)."""
    finite = ~F.isnan(loss) & (F.abs(F.col(loss)) < float("inf"))
    kept = log.where(finite & (F.col(step) % every == 0))
    bad = log.groupBy(run).agg(F.sum(F.when(finite, 0).otherwise(1)).alias("n_bad"))
    return kept, bad


# ---- top-k sampling -------------------------------------------------------------

def topk_ties(cands: DataFrame, k: int = 40, grp: str = "grp", score: str = "score") -> DataFrame:
    """Mask scores below the k-th largest: ``rank() <= k`` keeps ties at the k-th;
    k above the group size keeps all; ``k <= 0`` keeps all."""
    if k <= 0:
        return cands.withColumn("rank", F.lit(1))
    w = Window.partitionBy(grp).orderBy(F.desc(score))
    return cands.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)


def topk_softmax(cands: DataFrame, k: int = 40, temperature: float = 0.6, grp: str = "grp",
                 cand: str = "cand", score: str = "score") -> DataFrame:
    """Temperature-scaled softmax over the top-k survivors (``prob`` rounded to 6
    digits); ``temperature <= 0`` is argmax: prob 1 for the best, lowest id on ties.

    Log-sum-exp in two aggregates: the maximum of each group, then the sum of the exponentials below it, each
    partial before its shuffle and joined back on the group (a hot group's join is split by adaptive execution).
    So with ``k <= 0``, or many ties, no group is held in one window."""
    s = topk_ties(cands, k, grp, score)
    if temperature <= 0:
        win = s.groupBy(grp).agg(F.min_by(cand, F.struct(-F.col(score), F.col(cand))).alias("_w"))
        return s.join(win, grp).withColumn("prob", F.when(F.col(cand) == F.col("_w"), 1.0).otherwise(0.0)).drop("_w")
    own = F.col(grp).eqNullSafe(F.col("_g"))
    top = s.groupBy(F.col(grp).alias("_g")).agg(F.max(score).alias("_max"))
    s = s.join(top, own).drop("_g").withColumn("_z", F.exp((F.col(score) - F.col("_max")) / temperature))
    total = s.groupBy(F.col(grp).alias("_g")).agg(F.sum("_z").alias("_sum"))
    s = s.join(total, own).withColumn("prob", F.round(F.col("_z") / F.col("_sum"), 6))
    return s.drop("_g", "_z", "_max", "_sum")


def weighted_draw(probs: DataFrame, seed: int = 42, grp: str = "grp", cand: str = "cand",
                  prob: str = "prob") -> DataFrame:
    """One weighted draw per group (exponential race): ``min_by(cand, -ln(u) / p)``
    with ``u`` from a seeded md5 -- reproducible and a partial aggregate."""
    u = (hash_unit(seed, grp, cand).cast("double") + 0.5) / 4294967296.0
    race = F.when(F.col(prob) > 0, -F.log(u) / F.col(prob))
    return (probs.where(F.col(prob) > 0).withColumn("_r", race).groupBy(grp)
            .agg(F.min_by(cand, F.struct("_r", cand)).alias("drawn")))


# ---- multi-turn logs ------------------------------------------------------------

def cap_turns(turns: DataFrame, max_turns: int = 5, conv: str = "conv_id", turn: str = "turn",
              has_call: str = "has_call") -> DataFrame:
    """At most ``max_turns`` assistant turns (1-based ``turn``) per conversation,
    stopping after the first turn with no call.  The ``turn <= max_turns``
    filter runs first, so the window sees at most ``max_turns`` rows per key."""
    t = turns.where(F.col(turn) <= max_turns)
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.when(~F.col(has_call), 1).otherwise(0)).over(w), F.lit(0))
    return t.withColumn("_s", stopped).where(F.col("_s") == 0).drop("_s")


def detect_recovery(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per error turn: the next turn's call changed (name or arguments) and whether it
    succeeded.  ``next`` is an equi join on ``(conv, turn + 1)`` (dense turns), so
    a hot conversation is spread by turn, not held in one window."""
    a = turns.where(F.col("status") == "error").alias("a")
    b = turns.select(conv, turn, "name", "args", "status").alias("b")
    j = a.join(b, (F.col(f"a.{conv}") == F.col(f"b.{conv}")) & (F.col(f"b.{turn}") == F.col(f"a.{turn}") + 1), "left")
    changed = F.coalesce((F.col("a.name") != F.col("b.name")) | (F.col("a.args") != F.col("b.args")), F.lit(False))
    return j.select(F.col(f"a.{conv}").alias(conv), F.col(f"a.{turn}").alias(turn),
                    F.col("b.name").alias("next_name"), changed.alias("changed"),
                    (changed & (F.col("b.status") != "error")).alias("recovered"))


