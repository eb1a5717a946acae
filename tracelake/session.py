"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(cpus: int | str | None = None, shuffle_partitions: int = 8,
              app: str = "tracelake", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    master = f"local[{cpus or '*'}]"
    b = SparkSession.builder.master(master).appName(app)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("TRACELAKE_DRIVER_MEMORY", "16g"))
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the operator must read it from the session (a folder every
    executor can reach).  Only when it is unset -- local tests -- a fresh scratch
    folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    if not d:
        d = tempfile.mkdtemp(prefix="tracelake-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def ship_package(spark: SparkSession) -> None:
    """Give executors this package (once per context), so that a session started in any
    folder can run its Python tasks; the archive travels by Spark's own file distribution."""
    sc = spark.sparkContext
    if getattr(sc, "_tracelake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        to = os.path.join(tempfile.mkdtemp(prefix="tracelake-pkg-"), "tracelake")
        sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(package), os.path.basename(package)))
    sc._tracelake_shipped = True
