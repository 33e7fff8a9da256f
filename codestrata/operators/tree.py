"""Files, modules and import edges of the scans, as their last complete snapshot holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.paths import extension, parent_dir, path_prefixes
from codestrata.operators.running import row_numbers
from codestrata.operators.snapshots import snapshot_rows


def latest_files(snapshots: DataFrame, snapshot_files: DataFrame) -> DataFrame:
    """``scan_id, commit_id, path, module, language, loc, bytes, depends_on``: one row per file of a scan's last snapshot. Null loc and bytes count 0."""
    numbered, rows = snapshot_rows(snapshots, snapshot_files)
    last = rows.where("idx = last_idx").join(numbered.where("idx = last_idx").select("scan_id", "commit_id"), "scan_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return last.select("scan_id", "commit_id", "path", parent_dir(F.col("path")).alias("module"), T.language_of(extension(F.col("path"))).alias("language"), zero("loc").cast("int").alias("loc"), zero("bytes").cast("long").alias("bytes"), "depends_on")


def import_edges(files: DataFrame) -> DataFrame:
    """``scan_id, src, dst``: distinct edges between different files that the tree holds; targets that are absent are dropped."""
    said = files.select("scan_id", F.col("path").alias("src"), F.explode("depends_on").alias("dst")).where("dst <> src").distinct()
    return said.join(files.select("scan_id", F.col("path").alias("dst")), ["scan_id", "dst"], "left_semi").select("scan_id", "src", "dst")


def missing_targets(files: DataFrame) -> DataFrame:
    """``scan_id, src, dst`` of imports whose target the tree does not hold."""
    said = files.select("scan_id", F.col("path").alias("src"), F.explode("depends_on").alias("dst")).distinct()
    return said.join(files.select("scan_id", F.col("path").alias("dst")), ["scan_id", "dst"], "left_anti").select("scan_id", "src", "dst")


def modules(files: DataFrame) -> DataFrame:
    """``scan_id, module_id, module, files, loc``: directories, numbered from 0 in byte order of their paths."""
    summed = files.groupBy("scan_id", "module").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return row_numbers(summed, ["scan_id"], [F.col("module")], "n").withColumn("module_id", F.col("n") - 1).drop("n")


def path_rollup(files: DataFrame) -> DataFrame:
    """``scan_id, dir, files, size``: every directory, the root included, with all that lies below; a file weighs at least 1."""
    below = files.select("scan_id", F.explode(path_prefixes(F.col("path"))).alias("dir"), F.greatest("loc", F.lit(1)).alias("size"))
    return below.groupBy("scan_id", "dir").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("scan_id", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def walk_outcome(source_files: DataFrame, include: str | None = None, exclude: str | None = None, max_bytes: int = T.MAX_BYTES) -> DataFrame:
    """``file_id, path, outcome``: what a walk makes of each file: skipped directory, manifest, no source, not included, excluded, too large, binary, or source.

    ``include`` and ``exclude`` are regular expressions over the path (see :func:`codestrata.functions.globs.glob_regex`).
    """
    from codestrata.functions.paths import file_name, plain_path

    path = plain_path(F.col("rel_path"))
    in_skipped = F.exists(F.split(parent_dir(path), "/"), lambda d: d.isin(*T.SKIP_DIRS))
    outcome = (
        F.when(in_skipped, "SkippedDir").when(T.is_manifest(file_name(path)), "Manifest").when(T.language_of(extension(path)).isNull(), "NoSource")
        .when(F.lit(False) if include is None else ~path.rlike(include), "NotIncluded").when(F.lit(False) if exclude is None else path.rlike(exclude), "Excluded")
        .when(F.coalesce("bytes", F.length("content"), F.lit(0)) > max_bytes, "TooLarge").when(F.coalesce(T.looks_binary(F.col("content")), F.lit(False)), "Binary").otherwise("Source"))
    return source_files.where("rel_path is not null").select("file_id", path.alias("path"), outcome.alias("outcome"))
