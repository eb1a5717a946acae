"""Binary shard files in a shared store: temporary names, a manifest, then renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def store_of(path: str):
    """Arrow file system and plain path of a URI or an absolute path."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def commit(written: DataFrame, path: str) -> DataFrame:
    """Run the writing job ``written`` (one row per file, with ``temp`` and ``name``
    relative to ``path``), commit its rows as the manifest, then rename the files
    listed there.  Files of lost or repeated attempts are in no manifest; a renaming
    task that runs again finds its work done.  Returns the committed manifest."""
    spark, schema = written.sparkSession, written.schema
    written.write.parquet(f"{path}/_manifest")
    manifest = spark.read.schema(schema).parquet(f"{path}/_manifest")

    def rename(batches):
        from pyarrow import fs

        store, base = store_of(path)
        for b in batches:
            for temp, name in zip(b.column("temp").to_pylist(), b.column("name").to_pylist()):
                if store.get_file_info(f"{base}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{base}/{temp}", f"{base}/{name}")
            yield b

    manifest.mapInArrow(rename, T.StructType(schema.fields)).write.parquet(f"{path}/_committed")
    return spark.read.schema(schema).parquet(f"{path}/_committed")


def committed(spark, path: str, schema: str) -> DataFrame:
    """The manifest of ``path``, one file per task: its rows are few and each stands for a whole file."""
    m = spark.read.schema(schema).parquet(f"{path}/_committed")
    return m.repartition(max(1, min(10_000, m.count())), "name")
