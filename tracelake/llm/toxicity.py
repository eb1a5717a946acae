"""Toxicity by two class-conditional Kneser-Ney models.

Per class (toxic, ordinary) an interpolated Kneser-Ney model of the characters of
a word, ``order`` characters at a time, is counted over the labelled training
documents.  Orders up to ``shared_order`` are counted over both classes together:
rare expressions of either class back off to the same counts.  A word's score is
its toxic minus its ordinary log-likelihood; a document's are averaged over
its words, and a logistic curve fitted on the fifth of the training documents that is held
out of the counts turns it into 0..1.

Counting is a Spark job: distinct words with class counts, then distinct n-grams with
class counts, continuation counts and totals of contexts over all of them, then
probabilities, one length after the other.  No n-gram is left out: the table of
log-ratios (12 bytes a gram and a context, as sorted hashes) that scoring looks up grows with the
labelled text.  Labels come from at most about ``max_labelled``
rows, chosen by id hash, so that the label side of the join has a bounded size.

Edge cases: null and empty texts get the curve's value for no evidence; null labels
and labels without a document are no training rows; several labels of one id count
as their maximum; a table without labels, or with one class only, scores every text by
the smoothed share of toxic labels; null ids are scored and never trained on; equal
rows get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bytewords import mix
from tracelake.llm.common import materialise, tidy, worker_cache

#: characters that stand between words, besides white space
BREAKS = {ord(c): " " for c in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~¡¿«»„“”…–—"}
#: log-likelihood ratios of a word from which on its excess is averaged by itself
HINGES = (1.0, 2.0, 4.0)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.zeros(0, np.uint64), np.zeros(0, np.float32)


def words_of(text: str | None) -> list[str]:
    return text.lower().translate(BREAKS).split() if text else []


def held_out(col="doc_id"):
    """The documents whose labels are never looked at."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def word_counts(train: DataFrame, flush: int = 300_000) -> DataFrame:
    """``train(text, toxic)`` -> ``word, c0, c1``."""
    def count(batches):
        import pyarrow as pa

        tally = (Counter(), Counter())

        def out():
            w = list(set(tally[0]) | set(tally[1]))
            b = pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([tally[0][x] for x in w], pa.int64()),
                                            pa.array([tally[1][x] for x in w], pa.int64())], names=["word", "c0", "c1"])
            tally[0].clear()
            tally[1].clear()
            return b

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                tally[toxic].update(words_of(text.as_py()))
                if len(tally[0]) + len(tally[1]) > flush:
                    yield out()
        yield out()

    parts = train.select("text", "toxic").mapInArrow(tidy(count), "word string, c0 long, c1 long")
    return parts.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def ngram_counts(words: DataFrame, order: int, flush: int = 300_000) -> DataFrame:
    """``gram, c0, c1`` of all grams of 1..order characters of ``^word$``, weighted by the word's counts."""
    def count(batches):
        import pyarrow as pa

        c0, c1 = Counter(), Counter()

        def out():
            g = list(set(c0) | set(c1))
            b = pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array([c0[x] for x in g], pa.int64()),
                                            pa.array([c1[x] for x in g], pa.int64())], names=["gram", "c0", "c1"])
            c0.clear()
            c1.clear()
            return b

        for b in batches:
            for word, x0, x1 in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = f"^{word.as_py()}$"
                for i in range(1, len(s)):
                    for j in range(max(0, i - order + 1), i + 1):
                        g = s[j:i + 1]
                        if x0:
                            c0[g] += x0
                        if x1:
                            c1[g] += x1
                    if len(c0) + len(c1) > flush:
                        yield out()
        yield out()

    return (words.mapInArrow(tidy(count), "gram string, c0 long, c1 long").groupBy("gram")
            .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """By length 1..order: a hash of as many code points that end at each place (what begins before the first is void)."""
    out = [mix(points + _STEP)]
    for n in range(1, min(order, len(points))):
        h = mix(out[-1] * _STEP)
        h[n:] = mix(out[-1][n:] * _STEP + points[:-n])
        out.append(h)
    return out


def _hashed(rows: DataFrame, order: int) -> DataFrame:
    """``gram, v`` -> ``h, v``."""
    def apply(batches):
        import pyarrow as pa

        for b in batches:
            grams = b.column(0).to_pylist()
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64)
            by, ends, h = gram_hashes(points, order), np.cumsum(sizes) - 1, np.zeros(len(grams), np.uint64)
            for n in np.unique(sizes[sizes > 0]).tolist():
                h[sizes == n] = by[n - 1][ends[sizes == n]]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(1)], names=["h", "v"])

    return rows.mapInArrow(tidy(apply), "h long, v float")


def _table(rows: DataFrame, order: int):
    """Sorted hashes and values."""
    t = _hashed(rows, order).toArrow()
    h, v = t["h"].to_numpy().view(np.uint64), t["v"].to_numpy()
    at = np.argsort(h)
    return h[at], v[at]


def kneser_ney(grams: DataFrame, order: int, shared_order: int, discount: float = 0.75):
    """``gram, c0, c1`` of all grams -> (``gram, v``: log-ratio of the classes' probabilities,
    ``gram, v``: log-ratio of a context's backoff weights)."""
    length, tail = F.length("gram"), F.expr("substring(gram, 2)")
    left = grams.where(length > 1).groupBy(tail.alias("gram")).agg(
        F.sum((F.col("c0") > 0).cast("long")).alias("l0"), F.sum((F.col("c1") > 0).cast("long")).alias("l1"))
    # Kneser-Ney counts: raw at the top and at a word's start, else left contexts
    top = (length == order) | F.col("gram").startswith("^")
    kn = grams.join(left, "gram", "left").select("gram", *[
        F.when(top, F.col(f"c{k}")).otherwise(F.coalesce(f"l{k}", F.lit(0))).alias(f"c{k}") for k in (0, 1)])
    both = F.col("c0") + F.col("c1")
    kn = kn.select("gram", *[F.when(length <= shared_order, both).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in (0, 1)])
    kn = materialise(kn.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")), "kneser-ney")
    types = [F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"n{k}") for k in (0, 1)]
    total = kn.groupBy("context").agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in (0, 1)], *types)
    back = [F.when(F.col(f"t{k}") > 0, discount * F.col(f"n{k}") / F.col(f"t{k}")).otherwise(1.0).alias(f"b{k}") for k in (0, 1)]
    total = materialise(total.select("context", "t0", "t1", *back), "contexts")
    uniform = 1 / (kn.where(length == 1).count() + 1)
    levels = []
    for n in range(1, order + 1):
        at = kn.where(length == n).join(total, "context")
        if n == 1:
            at = at.select("*", F.lit(uniform).alias("p0"), F.lit(uniform).alias("p1"))
        else:  # every suffix of a counted gram is counted
            at = at.join(levels[-1].select(F.col("gram").alias("tail"), "p0", "p1"), tail == F.col("tail"))
        p = [(F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"c{k}") - discount, F.lit(0.0)) / F.col(f"t{k}")).otherwise(0.0)
              + F.col(f"b{k}") * F.col(f"p{k}")).alias(f"p{k}") for k in (0, 1)]
        levels.append(materialise(at.select("gram", *p), f"grams-{n}"))
    every = levels[0]
    for one in levels[1:]:
        every = every.unionByName(one)
    return (every.select("gram", F.log(F.col("p1") / F.col("p0")).cast("float").alias("v")),
            total.select(F.col("context").alias("gram"), F.log(F.col("b1") / F.col("b0")).cast("float").alias("v")))


class Model:
    """Log-likelihood ratios of grams, and of their contexts' backoff weights, by hash."""

    def __init__(self, ratio: tuple, back: tuple, order: int, weights=None):
        self.ratio, self.back, self.order, self.weights = ratio, back, order, weights
        self.cache: dict[str, float] = {}

    @staticmethod
    def _find(table, h):
        keys, values = table
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return hit, np.where(hit, values[at], 0.0).astype(float)

    def words(self, words: list[str], window: int = 1 << 17) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of every word."""
        order, text = self.order, "".join(f"^{w}$" for w in words)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(len(words))
        for lo in range(0, len(text), window):
            a = max(0, lo - order)
            points = np.frombuffer(text[a:lo + window].encode("utf-32-le"), np.uint32).astype(np.uint64)
            by, place = gram_hashes(points, order), np.arange(a, a + len(points))
            word = np.searchsorted(starts, place, "right") - 1
            inside, value = place - starts[word], np.zeros(len(points))
            left = np.flatnonzero((place >= lo) & (inside > 0))
            for n in range(len(by), 0, -1):
                fits = inside[left] >= n - 1
                at = left[fits]
                hit, v = self._find(self.ratio, by[n - 1][at])
                value[at] += v
                miss = at[~hit]
                value[miss] += self._find(self.back, by[n - 2][miss - 1] if n > 1 else np.zeros(len(miss), np.uint64))[1]
                left = np.concatenate([left[~fits], miss])
            out += np.bincount(word, value, len(words))
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """The words of some texts go to the cache."""
        if len(self.cache) > 100_000:
            self.cache.clear()
        new = list(set().union(*texts).difference(self.cache))
        self.cache.update(zip(new, self.words(new).tolist()))

    def all_features(self, column, group: int = 50) -> list[list[float]]:
        out = []
        for lo in range(0, len(column), group):
            texts = [words_of(t) for t in column.slice(lo, group).to_pylist()]
            self.learn(texts)
            out += map(self.features, texts)
        return out

    def features(self, words: list[str]) -> list[float]:
        """Of a text's words, which are in the cache: constant, mean ratio per word, mean excess over each of :data:`HINGES` (a few strong
        words in a long ordinary text), the excesses times log length, inverse length."""
        scores = [self.cache[w] for w in words]
        n = len(scores)
        if not n:
            return [1.0] + [0.0] * (2 * len(HINGES) + 2)
        v = np.array(scores)
        over = [float(np.maximum(v - t, 0).mean()) for t in HINGES]
        return [1.0, float(v.mean()), *over, *(x * math.log(n) for x in over), 1 / n]

    def scores(self, column) -> list[float]:
        z = (float(np.dot(self.weights, x)) for x in self.all_features(column))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, v)))) for v in z]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])

    def loss(v):
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * v @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        t, now = 1.0, loss(w)
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w / scale


def train(docs: DataFrame, labels: DataFrame, order: int = 6, shared_order: int = 2,
          max_labelled: int = 1_000_000, max_curve: int = 50_000) -> Model:
    """Fit on ``labels(doc_id, toxic)`` of documents that are not held out."""
    spark = docs.sparkSession
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    known = materialise(known, "labels")
    n, positive = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    prior = ((positive or 0) + 0.5) / (n + 1)

    def plain(slope):
        return np.array([math.log(prior / (1 - prior)), slope] + [0.0] * (2 * len(HINGES) + 1))

    flat = Model(_EMPTY, _EMPTY, order, plain(0.0))
    if not n or not positive or positive == n:
        return flat
    # at most max_labelled rows of two numbers: the label side is bounded
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0))
    words = word_counts(rows.where(~F.col("curve")))
    grams = materialise(ngram_counts(words, order), "grams")
    model = Model(*(_table(t, order) for t in kneser_ney(grams, order, shared_order)), order)
    shared = spark.sparkContext.broadcast((model.ratio, model.back))

    def measure(batches):
        import pyarrow as pa

        m = Model(*shared.value, order)
        for b in batches:
            x = m.all_features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    share = min(1.0, max_curve / max(1, min(n, max_labelled) // 5))
    curve = rows.where("curve").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1e6 * share))
    got = curve.select("text", "toxic").mapInArrow(tidy(measure), "x array<double>, toxic int").toArrow()  # <= max_curve rows
    shared.unpersist()
    y = got["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.weights = logistic(np.array(got["x"].to_pylist()), y)
    else:  # too few labels for a curve: even odds at no evidence but the prior
        model.weights = plain(10.0)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` that the caller selects by ``doc_id``: ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.back, model.order, model.weights))

    def apply(batches):
        import pyarrow as pa

        m = _loaded(shared)
        for b in batches:
            s = m.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()),
                                              pa.array([int(v >= threshold) for v in s], pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(
        tidy(apply), "doc_id long, held_out boolean, score double, predicted int")


def _loaded(shared) -> Model:
    """One model per Python worker and broadcast, with its word cache, as long as no other operator's stage runs there."""
    value, kept = shared.value, worker_cache("toxicity")
    if id(value) not in kept:
        kept.clear()
        kept[id(value)] = value, Model(*value)
    return kept[id(value)][1]


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents scored below ``threshold``, columns and order of ``docs`` kept."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.back, model.order, model.weights))
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        m = _loaded(shared)
        for b in batches:
            yield b.filter(pa.array([v < threshold for v in m.scores(b.column(at))], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
