"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by at most ``2 - 2t`` in squared distance.  After one
fixed rotation the dimensions are split into blocks, each with the share of that budget
that it has of the dimensions; in some block a linked pair is within the block's share.
Each block is a range join: two coordinates of the block make a grid with cells twice
as wide as the range, a vector also goes to the next cells it is in range of, and a
pair meets in the cell of the larger indices.  The blocks of dimensions are joined one after the other, each in rounds that
send about ``share`` of the vector table through a shuffle, whose files go when the round ends.  In a cell block distances give candidates;
cosines on the original vectors in double precision decide.  A link is counted only in the
first block whose budget it keeps, so blocks need no common list of pairs: a task adds 50,000 pairs at a
time to link counts and a forest, drops them, and returns counts and forest.  Cells over ``block`` vectors are cut into
blocks that meet pairwise, a round taking every ``rounds``-th of them.  Equal vectors are one class with a weight.

Edge cases: null, zero and non-finite vectors and those of another length than the
commonest link with nothing; equal rows and equal ids are separate vectors of one
class; a null id counts as a vector, its component is the smallest other id; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import connected_components, materialise, shared_path
from tracelake.llm.vectors import doubles, main_width, matrix, row_dots

SLACK = 1e-5  # of squared distance, for coordinates kept in single precision


def rotation(width: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def split(width: int, block_dims: int) -> list[tuple[int, int]]:
    """Dimension ranges of the blocks."""
    n = max(1, round(width / block_dims))
    edges = [round(k * width / n) for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _budgets(width, parts, threshold):
    return [(2 - 2 * threshold) * (b - a) / width + SLACK for a, b in parts]


def join_cell(x, y, side, across, k, parts, budgets, threshold, cell, wide, rows: int = 128):
    """Yield ``i, j`` of the linked pairs of one cell whose home cell and first block this is, at most 50,000 at
    a time; ``across``: only pairs of different ``side``."""
    a, b = parts[k]
    own = y[:, a:b]
    sq = (own ** 2).sum(1)
    one = np.ones_like(sq)
    # squared distances by one product: |u|^2 + |v|^2 - 2 uv
    u, v = np.column_stack([own, sq, one]), np.column_stack([-2 * own, one, sq])
    norm = np.sqrt(row_dots(x, x))
    place = np.floor(y[:, a:min(a + 2, b)].astype(np.float64) / wide).astype(np.int64)
    for lo in range(0, len(x), rows):
        hi = min(lo + rows, len(x))
        near = u[lo:hi] @ v[lo:].T <= np.float32(budgets[k] + 1e-4)
        at = np.flatnonzero(near)
        i, j = at // (len(x) - lo) + lo, at % (len(x) - lo) + lo
        keep = (j > i) & ((side[i] != side[j]) | (not across))
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 50_000):
            p, q = i[at:at + 50_000], j[at:at + 50_000]
            ok = (np.maximum(place[p], place[q]) == cell).all(1)
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            ok = row_dots(x[p], x[q]) >= threshold * (norm[p] * norm[q])
            p, q = p[ok], q[ok]
            d = (y[p].astype(np.float64) - y[q].astype(np.float64)) ** 2
            ok = d[:, a:b].sum(1) <= budgets[k]
            for e, (s0, s1) in enumerate(parts[:k]):
                ok &= d[:, s0:s1].sum(1) > budgets[e]
            if ok.any():
                yield p[ok], q[ok]


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each row's root, the smallest of its tree) after joining the trees of every pair."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def rounds_of(cells: DataFrame, row_bytes: int, most: int) -> int:
    """Rounds in which the rows of all cells, each sent to every block of its cell, are at most about ``most`` bytes."""
    sent = cells.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    return max(1, -(-sent * row_bytes // max(most, 1)))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, block_dims: int = 16, block: int = 12_000,
                    share: float = 1.0, least_bytes: int = 256 << 20) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding"))
    spark = rows.sparkSession
    kind = np.float32 if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    good = doubles(rows)
    width = main_width(good)
    good = good.where(F.size("v") == width).select("vec_id", F.xxhash64("v").alias("c"), "v")
    parts, turn = split(max(width, 1), block_dims), rotation(max(width, 1))
    budgets = _budgets(max(width, 1), parts, threshold)
    wide = [2 * float(np.sqrt(b)) for b in budgets]

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            x = (matrix(b.column(2), width) + 0.0).astype(kind)  # no -0.0: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "c", "x"])

    def turned(batches):
        import pyarrow as pa

        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), kind).reshape(-1, max(width, 1)).astype(np.float64)
            y = ((x / np.sqrt(row_dots(x, x))[:, None]) @ turn).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in y], pa.binary())], names=["c", "x", "rep", "weight", "y"])

    classes = good.mapInArrow(packed, "vec_id long, c long, x binary").groupBy("c", "x").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(classes.mapInArrow(turned, "c long, x binary, rep long, weight long, y binary"), "vectors")

    def places(column, k):
        """Rows and cells (two indices) of block ``k`` where the vectors go."""
        lo, hi = parts[k]
        y = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, max(width, 1))
        z = y[:, lo:min(lo + 2, hi)].astype(np.float64)
        home, reach = np.floor(z / wide[k]).astype(np.int64), np.floor((z + wide[k] / 2) / wide[k]).astype(np.int64)
        for step in np.ndindex(*(2,) * z.shape[1]):
            at = home + np.array(step)
            i = np.flatnonzero((at <= np.maximum(home, reach)).all(1))
            if len(i):
                yield i, at[i, 0], at[i, 1] if z.shape[1] > 1 else np.zeros(len(i), np.int64)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(len(parts)):
                for _, p, q in places(b.column(0), k):
                    at, n = np.unique(np.column_stack([p, q]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n)],
                                                     names=["k", "p", "q", "n"])

    # at most (2 / range) ** 2 cells a block of dimensions, whatever the data
    cells = classes.select("y").mapInArrow(sizes, "k int, p long, q long, n long").groupBy("k", "p", "q").agg(F.sum("n").alias("n"))
    cells = materialise(cells.withColumn("m", F.ceil(F.col("n") / block).cast("int")), "cells")
    row_bytes = width * (np.dtype(kind).itemsize + 4) + 64
    most = max(least_bytes, int(share * classes.count() * row_bytes))

    def joined(k):
        def place(batches):
            import pyarrow as pa

            for b in batches:
                for i, p, q in places(b.column(3), k):
                    i = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), *(x.take(i) for x in b.columns)],
                                                     names=["p", "q", "c", "weight", "x", "y"])

        def links(key, t):
            import pyarrow as pa

            p, q = (key[n].as_py() for n in range(2))
            x = np.frombuffer(b"".join(t["x"].to_pylist()), kind).reshape(-1, width).astype(np.float64)
            y = np.frombuffer(b"".join(t["y"].to_pylist()), np.float32).reshape(-1, width)
            c, side, w = t["c"].to_numpy(), t["side"].to_numpy(), t["weight"].to_numpy()
            cell = np.array([p, q][:min(2, parts[k][1] - parts[k][0])])
            count, label = np.zeros(len(c), np.int64), np.arange(len(c))
            for i, j in join_cell(x, y, side, key[2].as_py() != key[3].as_py(), k, parts, budgets, threshold, cell, wide[k]):
                np.add.at(count, i, w[j])
                np.add.at(count, j, w[i])
                label = unite(label, i, j)
            hit = np.flatnonzero(count)
            return pa.table({"c": pa.array(c[hit]), "links": pa.array(count[hit]), "root": pa.array(c[label[hit]])})

        return place, links

    path = shared_path(spark, "vector-links")
    for k in range(len(parts)):
        place, links = joined(k)
        own = cells.where(F.col("k") == k).drop("k")
        rounds = rounds_of(own, row_bytes, most)
        placed = classes.select("c", "weight", "x", "y").mapInArrow(place, "p long, q long, c long, weight long, x binary, y binary")
        sided = placed.join(F.broadcast(own.drop("n")), ["p", "q"]).withColumn("side", F.pmod(F.xxhash64("c", F.lit(1)), F.col("m")).cast("int"))
        for r in range(rounds):  # blocks i and j of a cell meet in the round of i + j
            first = F.pmod(F.lit(r) - F.col("side"), F.lit(rounds))
            met = sided.where(first < F.col("m")).withColumn("o", F.explode(F.sequence(first, F.col("m") - 1, F.lit(rounds))))
            work = met.withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
            found = work.select("p", "q", "i", "j", "side", "c", "weight", "x", "y").groupBy("p", "q", "i", "j").applyInArrow(
                links, "c long, links long, root long")
            found = materialise(found, "vector-links", path)
    comp = connected_components(found.where("c != root").select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "c")
    total = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.select("c", "rep", "weight").join(comp, "c", "left").withColumn("g", F.coalesce("component_id", "c"))
    first = named.groupBy("g").agg(F.min("rep").alias("component"))
    named = (named.join(first, "g").join(total, "c", "left")
             .select("c", F.col("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    keyed = rows.withColumn("v", F.col("embedding").cast("array<double>")).withColumn(
        "c", F.when(F.coalesce((F.size("v") == width), F.lit(False)), F.xxhash64("v"))).select("vec_id", "c")
    out = keyed.join(named, "c", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
