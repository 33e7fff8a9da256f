"""Session helpers: lineage cuts in the shared folder and task spreading."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` when the cluster names one; set a local folder only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, on whatever file system Spark reads it; none where it does not exist."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()] if files.exists(place) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system Spark reads it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so lost executors cost no recomputation of earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    For results that several later branches read, each with its own columns. Tables stay until the shared folder is
    cleared, as the caller may still read from them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`stage`, in buckets of ``keys``, by which ``df`` must be partitioned already, into :func:`buckets`.

    Each task writes one file, in the order of its rows. Joins, windows and aggregations whose keys hold these read the
    table without a shuffle (joins with more keys: inside :func:`partitioned_by_some`).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets(spark), *keys).option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}")
    writer.option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


@contextlib.contextmanager
def partitioned_by_some(spark: SparkSession) -> Iterator[None]:
    """Here a join may use sides partitioned by some of its keys; for keys that are known to spread well. Only around what runs at once."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def buckets(spark: SparkSession) -> int:
    """Tasks of a shuffle whose result is kept in buckets: what the session asks for, four for each core at least."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str, factor: int = 4, shuffled: bool = False) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks where the bytes alone would make few.

    A scan with more splits than cores is passed through. The result of a shuffle (``shuffled``) is always spread, as
    adaptive execution sizes its tasks by bytes, and as asking for its number of tasks would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(factor * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if shuffled else 0)
    if not shuffled and df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(tasks, *keys)


def frame_stage(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` whose results pass :func:`settled`."""

    @functools.wraps(work)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return settled(work(frames))

    return run


def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result frames of a Python stage as Arrow takes them: no empty ones, and text as plain objects."""
    for frame in frames:
        if len(frame):
            yield frame.astype({c: object for c, kind in frame.dtypes.items() if isinstance(kind, pd.StringDtype)})
