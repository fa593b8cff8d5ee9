"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors share, from spark.checkpoint.dir; it goes when the driver ends.

    If that is unset a local master gets a temporary folder; on a cluster each executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glossaria-"))
        found = sc.getCheckpointDir()
    top = f"{found.rstrip('/')}/glossaria-{sc.applicationId}"
    if top not in _MARKED:
        fs, path = file_system(spark, top)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(top)
    return top


_MARKED: set[str] = set()


def file_system(spark: SparkSession, at: str):
    """Hadoop's file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what was written within it in the shared folder, but for the paths that are taken out of the list it gives."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)
        for at in made:
            fs, path = file_system(spark, at)
            fs.delete(path, True)


#: Whether Spark deletes a query's shuffle files when it ends, instead of when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run within it go when these end.  Only for what is written and read from there on."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def kept(made: list[str], *tables: DataFrame) -> None:
    """Takes frozen tables out of the list of a scratch that one is within, and hands them to the scratch around it, if there is one."""
    for t in tables:
        made.remove(t.frozen_at)
        if len(_MADE) > 1:
            _MADE[-2].append(t.frozen_at)


def frozen(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: computed once, the lineage cut, safe when executors are lost.  Its shuffle files go at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    with _shuffles_dropped(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.frozen_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like frozen, dealt into n buckets by key, so that cogroups and joins by it needn't move it again."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    with _shuffles_dropped(spark):
        df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.frozen_at = path
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the files of frozen tables that nothing reads any more."""
    for t in tables:
        fs, path = file_system(t.sparkSession, t.frozen_at)
        fs.delete(path, True)


def n_buckets(spark: SparkSession, n_bytes: int, bucket_bytes: int = 64 << 20) -> int:
    """Buckets for so many bytes: as many as a shuffle would have partitions, more if they got large."""
    return min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // bucket_bytes))
