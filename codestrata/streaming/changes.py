"""Changed files as streams: bursts of changes, and counts that follow them.

The functions take static and streaming DataFrames alike; watermarks only matter for streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.functions import text as T
from codestrata.functions.paths import extension, file_name, plain_path


def is_interesting(path: Column) -> Column:
    """Whether a change of the path matters: a source or manifest outside never-walked directories, and no editor's scratch file."""
    name = file_name(path)
    skipped = F.exists(F.split(path, "/"), lambda d: d.isin(*T.SKIP_DIRS))
    scratch = name.rlike(r"~$|^\.#|\.tmp$")
    return ~skipped & ~scratch & (T.is_manifest(name) | T.language_of(extension(path)).isNotNull())


def bursts(changes: DataFrame, key: str, at: str, path: str, gap: str = "400 milliseconds", late: str = "10 minutes") -> DataFrame:
    """``key, started, ended, paths``: changes that follow each other within ``gap``, with their distinct interesting paths, sorted.

    In a stream a burst comes out once the watermark (``late`` behind the newest change) has passed its end.
    """
    kept = changes.select(F.col(key), F.col(at), plain_path(F.col(path)).alias("path")).where(is_interesting(F.col("path")) & F.col(at).isNotNull())
    timed = kept.withWatermark(at, late) if kept.isStreaming else kept
    found = timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths")


def windowed_counts(changes: DataFrame, key: str, at: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``key, started, changes``: changes per tumbling window. An extension: the debounced bursts are all that watching a tree needs."""
    timed = changes.withWatermark(at, late) if changes.isStreaming else changes.where(F.col(at).isNotNull())
    return timed.groupBy(key, F.window(at, window).alias("w")).agg(F.count("*").alias("changes")).select(key, F.col("w.start").alias("started"), "changes")


def on_changes(changes: DataFrame, path: str, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``act`` on the distinct interesting paths of every batch of a stream, to parse again what changed."""

    def each(batch: DataFrame, number: int) -> None:
        act(batch.select(plain_path(F.col(path)).alias("path")).where(is_interesting(F.col("path"))).dropDuplicates(["path"]), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
