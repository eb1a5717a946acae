"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import functools
import json
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import checkpoint_dir


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at a time at most: their width has no bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor reaches."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.  ``path``: add it to the table
    there, and read all of it."""
    added, path = path is not None, path or shared_path(df.sparkSession, name)
    if _SCRATCH and path not in _SCRATCH[-1]:
        _SCRATCH[-1].append(path)
    with shuffles_end(df.sparkSession):
        df.write.mode("append" if added else "errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_end(spark: SparkSession):
    """Spark deletes the shuffle files of a query that begins within as soon as it ends; else they stay until the
    driver happens to collect its garbage, and those of many queries pile up on the executors' disks."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def scratch(paths: list[str]):
    """Within it, ``materialise`` notes the paths of its tables in ``paths``, for ``drop_tables``."""
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.pop()


def drop_tables(spark: SparkSession, paths: list[str], used_by: DataFrame | None = None) -> None:
    """Delete scratch tables; those that ``used_by`` still reads stay (and stay in ``paths``)."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    files = used_by.inputFiles() if paths and used_by is not None else []
    used = {f.rsplit("/", 2)[-2] for f in files}  # the tables' folders have names of their own
    for path in list(paths):
        if path.rsplit("/", 1)[-1] not in used:
            paths.remove(path)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


_WORKER: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks.  Workers are reused by later stages: the first task
    of another owner drops what the one before has kept and gives the memory back."""
    if owner not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            give_back()
        _WORKER[owner] = {}
    return _WORKER[owner]


def tidy(fn):
    """An Arrow function that gives its freed memory back when its task ends: workers stay for later stages, and
    what the C library keeps of large arrays would count against the executor."""

    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Freed memory goes back to the system (where the C library offers it)."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def small_side(df: DataFrame, row_bytes, most: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``row_bytes`` each, sum to ``most`` at most; else as it is,
    for a shuffled join."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cell(col, i):
    """The i-th value of an Arrow column as a plain Python value."""
    return col[i].as_py()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (long ids, a != b, any direction) -> ``id, component_id``.

    Alternating large-star / small-star rounds (every node ends linked to the
    smallest id it can reach).  Each task first contracts its own edges to a
    spanning forest, every round is written to the shared folder, and the loop
    ends when a round leaves the edges as they were.  Only ids that occur in
    ``edges`` are returned.
    """
    spark = edges.sparkSession

    def forest(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
            if len(parent) > 2_000_000:  # bounded memory: emit what is known and start over
                pairs = [(x, root(x)) for x in parent if root(x) != x]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                                  pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])
                parent.clear()
        pairs = [(x, root(x)) for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    def star(e: DataFrame, large: bool) -> DataFrame:
        """One hash aggregate per round finds each node's smallest neighbour; the
        join back is an equi join that adaptive execution splits when a hub is hot."""
        both = e.select("a", "b")
        if large:
            both = both.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = both.join(m, "a")
        if large:
            out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                m.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    e = materialise(e.mapInArrow(tidy(forest), "a long, b long").distinct(), "cc")
    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = materialise(star(star(e, True), False), "cc")
        now = state(e)
        if tuple(now) == tuple(seen):
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return nodes.unionByName(nodes.select(F.col("component_id").alias("id"), "component_id")).distinct()


def dumps(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def crc32_ids(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF
