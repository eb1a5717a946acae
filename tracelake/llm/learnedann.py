"""Approximate nearest neighbours with learned partitions.

On a bounded sample the k-nearest-neighbour graph is built exactly, cut into balanced
partitions (recursive median splits, then rounds of balanced swaps that raise the number
of neighbours in one's own partition), and a small neural classifier learns a vector's
partition.  Every row is indexed under its most probable partition; a query is routed
to its most probable partitions, as many as reach ``recall`` on the sample and at least
``k + 1`` indexed rows, and the rows there are reranked by exact inner products in double
precision.  Partitions over ``block`` rows and routes over ``block`` queries are cut into blocks that
meet pairwise; each returns k rows a query and a window merges them.

Edge cases: vectors that are null, zero, non-finite or of another length than the commonest
are neither queries nor candidates; equal rows are separate candidates; a query's own row is
left out by id (all rows of that id); null ids are candidates last among equals and never
queries; with fewer than k candidates all are returned; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialise
from tracelake.llm.vectors import doubles, main_width, matrix, row_dots


def neighbour_graph(x: np.ndarray, k: int, rows: int = 256) -> np.ndarray:
    """Indices of the k largest inner products of every row, itself left out."""
    out = []
    for lo in range(0, len(x), rows):
        s = x[lo:lo + rows] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k].copy())
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """Partition of the rows into ``parts`` (a power of two) sets of equal size, few graph edges cut."""
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        new = label * 2
        for p in np.unique(label):
            at = np.flatnonzero(label == p)
            y = x[at] - x[at].mean(0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ axis, kind="stable")
            new[at[order[len(at) // 2:]]] += 1
        label = new
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)  # both directions
        gain = votes - votes[np.arange(len(x)), label][:, None]
        gain[np.arange(len(x)), label] = -1
        want = gain.argmax(1)
        best = gain[np.arange(len(x)), want]
        move = np.flatnonzero(best > 0)
        swaps = 0
        target = label.copy()
        for p in range(parts):
            for q in range(p + 1, parts):
                a = move[(label[move] == p) & (want[move] == q)]
                b = move[(label[move] == q) & (want[move] == p)]
                n = min(len(a), len(b))
                if n:
                    target[a[np.argsort(-best[a], kind="stable")[:n]]] = q
                    target[b[np.argsort(-best[b], kind="stable")[:n]]] = p
                    swaps += n
        label = target
        if not swaps:
            break
    return label


class Router:
    """One hidden layer and a softmax over partitions."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.sqrt(row_dots(x, x))[:, None]
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x, label, parts, hidden: int = 128, epochs: int = 40, batch: int = 256, seed: int = 3) -> "Router":
        r = np.random.RandomState(seed)
        x = x / np.sqrt(row_dots(x, x))[:, None]
        p = [r.standard_normal((x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5 * 2, np.zeros(hidden),
             r.standard_normal((hidden, parts)) * (1 / hidden) ** 0.5, np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo:lo + batch]
                h = np.maximum(x[at] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(at)), label[at]] -= 1
                z /= len(at)
                back = (z @ p[2].T) * (h > 0)
                t += 1
                rate = 0.003 * (1 - epoch / epochs) + 1e-4
                for k, g in enumerate((x[at].T @ back, back.sum(0), h.T @ z, z.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        return cls(*p)


def fit(vectors: DataFrame, width: int, parts: int | None = None, k: int = 20, max_sample: int = 12_000, recall: float = 0.97):
    """``(router, probes)`` from at most about ``max_sample`` rows, chosen by id hash.

    ``parts`` by default follows the table: 32 up to 131,072 rows, then twice as many whenever the
    table doubles, as long as the sample has 64 rows for each."""
    n = vectors.count()
    if parts is None:
        parts = 32
        while parts * 4096 < n and parts * 64 < max_sample:
            parts *= 2
    share = min(1.0, max_sample / max(1, n))
    below = -(1 << 63) + int(share * (1 << 64))  # of the whole 64-bit hash: no table is too large for a sample
    sample = vectors if share == 1.0 else vectors.where(F.xxhash64("vec_id", F.lit(21)) < F.lit(below).cast("long"))
    # a hot vector may fill the sample: equal vectors count once
    got = sample.select("v").distinct().limit(2 * max_sample).toArrow()
    x = matrix(got["v"].combine_chunks(), width) if got.num_rows else np.zeros((0, width))
    x = x[np.lexsort(x.T)] if len(x) else x  # one order, whatever the rows' order
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    if parts == 1:
        return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    graph = neighbour_graph(x, min(10, len(x) - 1))
    label = balanced_partition(x, graph, parts)
    router = Router.fit(x, label, parts)
    logits = router.logits(x)
    at = logits.argmax(1)
    rank = np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1)
    asked = np.arange(0, len(x), max(1, len(x) // 1500))
    true = neighbour_graph(x, min(k, len(x) - 1))[asked]
    need = rank[asked[:, None], at[true]].ravel()  # probes that reach each true neighbour
    probes = int(np.quantile(need, recall, method="higher")) + 1
    return router, probes


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, parts: int | None = None, max_sample: int = 12_000,
           recall: float = 0.97, block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of ``embeddings`` found for each row of ``queries``."""
    base = doubles(embeddings)
    width = main_width(base)
    if not width:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.where(F.size("v") == width)
    router, probes = fit(base, width, parts, k, max_sample, recall)
    model = (router.w1, router.b1, router.w2, router.b2)
    parts = model[3].shape[0]

    def assign(batches):
        import pyarrow as pa

        r = Router(*model)
        for b in batches:
            x = matrix(b.column(1), width)
            yield pa.RecordBatch.from_arrays([pa.array(r.logits(x).argmax(1).astype(np.int32)), b.column(0),
                                              pa.array([q.tobytes() for q in x], pa.binary())], names=["part", "vec_id", "x"])

    index = materialise(base.mapInArrow(assign, "part int, vec_id long, x binary"), "ann-index")
    sizes = np.zeros(parts, np.int64)
    for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per partition
        sizes[r["part"]] = r["n"]

    def route(batches):
        import pyarrow as pa

        r = Router(*model)
        for b in batches:
            x = matrix(b.column(1), width)
            if not len(x):
                continue
            order = np.argsort(-r.logits(x), axis=1, kind="stable")
            ahead = np.cumsum(sizes[order], axis=1) - sizes[order]
            # the most probable partitions, and further ones until there are enough rows besides the query's
            i, j = np.nonzero((np.arange(parts)[None, :] < probes) | (ahead <= k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[i, j].astype(np.int32)), b.column(0).take(pa.array(i)),
                 pa.array([q.tobytes() for q in x], pa.binary()).take(pa.array(i))], names=["part", "query_id", "q"])

    asked = doubles(queries).where((F.size("v") == width) & F.col("vec_id").isNotNull())
    routed = materialise(asked.mapInArrow(route, "part int, query_id long, q binary"), "ann-routes")
    load = routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    m = {r["part"]: (max(1, -(-int(sizes[r["part"]]) // block)), -(-r["n"] // block)) for r in load}
    if not m:
        m = {0: (1, 1)}
    cut = F.create_map(*[F.lit(z) for p, (a, b) in m.items() for z in (p, f"{a},{b}")])

    def cells(df, own, ident):
        ab = F.split(F.element_at(cut, F.col("part")), ",")
        mine, other = (ab[0].cast("int"), ab[1].cast("int")) if own == "xb" else (ab[1].cast("int"), ab[0].cast("int"))
        return (df.where(F.element_at(cut, F.col("part")).isNotNull())
                .withColumn(own, F.pmod(F.xxhash64(ident, F.lit(5)), mine).cast("int"))
                .withColumn("qb" if own == "xb" else "xb", F.explode(F.sequence(F.lit(0), other - 1))))

    def near(rows, asks):
        import pyarrow as pa

        x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, width)
        q = np.frombuffer(b"".join(asks["q"].to_pylist()), np.float64).reshape(-1, width)
        known = rows["vec_id"].to_numpy(zero_copy_only=False) if rows["vec_id"].null_count == 0 else \
            np.array([2**63 - 1 if v is None else v for v in rows["vec_id"].to_pylist()], np.int64)
        ids, out = asks["query_id"].to_numpy(), [[], [], []]
        for lo in range(0, len(q), 256):
            s = q[lo:lo + 256] @ x.T
            s[ids[lo:lo + 256][:, None] == known[None, :]] = -np.inf
            for r in range(len(s)):
                row = s[r]
                n = min(k, int(np.isfinite(row).sum()))
                if not n:
                    continue
                edge = np.partition(row, len(row) - n)[len(row) - n]
                at = np.flatnonzero((row >= edge - 1e-9 * (1 + abs(edge))) & np.isfinite(row))
                exact = row_dots(np.broadcast_to(q[lo + r], (len(at), width)), x[at])
                best = np.lexsort((known[at], -exact))[:n]
                out[0].append(np.full(n, ids[lo + r]))
                out[1].append(known[at[best]])
                out[2].append(exact[best])
        cat = lambda z, t: pa.array(np.concatenate(z) if z else np.zeros(0), t)
        return pa.table({"query_id": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})

    left = cells(index, "xb", "vec_id").groupBy("part", "xb", "qb")
    right = cells(routed, "qb", "query_id").groupBy("part", "xb", "qb")
    found = left.cogroup(right).applyInArrow(near, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"),
                    F.when(F.col("vec_id") != 2**63 - 1, F.col("vec_id")).alias("vec_id"), "score"))
