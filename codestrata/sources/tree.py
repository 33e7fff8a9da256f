"""Source trees on disk as DataFrames: paths are listed on the driver, contents are read in tasks."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.globs import any_glob
from codestrata.functions.paths import extension, file_name
from codestrata.session import delete_folder, folders, frame_stage
from codestrata.tables import importable


def list_paths(root: str) -> list[str]:
    """Sorted paths below ``root`` that version control does not ignore; in a plain folder all but hidden and never-walked ones."""
    asked = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True)
    if asked.returncode == 0:
        return sorted({p for p in asked.stdout.decode().split("\0") if p and os.path.isfile(os.path.join(root, p)) and not any(d.startswith(".") or d in T.SKIP_DIRS for d in p.split("/")[:-1])})
    found = []
    for here, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in T.SKIP_DIRS]
        found += [os.path.relpath(os.path.join(here, n), root).replace(os.sep, "/") for n in names if not n.startswith(".") and not os.path.islink(os.path.join(here, n))]
    return sorted(found)


def _reader(root: str, cap: int):
    @frame_stage
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, contents, faults = [], [], []
            for path in pdf["path"]:
                try:
                    full = Path(root, path)
                    sizes.append(full.stat().st_size)
                    contents.append(full.read_bytes() if sizes[-1] <= cap else None)
                    faults.append(None)
                except OSError as e:
                    sizes += [0] * (len(faults) + 1 - len(sizes))
                    contents.append(None)
                    faults.append(e.strerror)
            yield pd.DataFrame({"path": pdf["path"], "bytes": sizes, "content": contents, "fault": faults})

    return read


def scan_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, cap: int = T.MAX_BYTES) -> DataFrame:
    """``path, language, bytes, content, outcome, msg`` of every listed file.

    Outcome is Source, Manifest, NoSource, NotIncluded, Excluded, TooLarge, Binary or Unreadable. Manifests are told
    before the globs; only files that the globs leave are read; content is null where the file is no source or manifest.
    """
    importable(spark)
    paths = list_paths(root)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kind = (
        F.when(T.is_manifest(file_name(F.col("path"))), "Manifest").when(T.language_of(extension(F.col("path"))).isNull(), "NoSource")
        .when(~F.col("path").rlike(any_glob(include)) if include else F.lit(False), "NotIncluded").when(F.col("path").rlike(any_glob(exclude)) if exclude else F.lit(False), "Excluded").otherwise("Source"))
    told = rows.withColumn("kind", kind)
    wanted = told.where("kind in ('Source', 'Manifest')").select("path")
    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    read = wanted.repartition(tasks).mapInPandas(_reader(str(Path(root).resolve()), cap), "path string, bytes long, content binary, fault string")
    joined = told.join(read, "path", "left")
    outcome = F.when(~F.col("kind").isin("Source", "Manifest"), F.col("kind")).when(F.col("fault").isNotNull(), "Unreadable").when(F.col("bytes") > cap, "TooLarge").when(T.looks_binary(F.col("content")), "Binary").otherwise(F.col("kind"))
    shown = joined.withColumn("outcome", outcome)
    return shown.select("path", T.language_of(extension(F.col("path"))).alias("language"), "bytes", F.when(F.col("outcome").isin("Source", "Manifest"), F.col("content")).alias("content"), "outcome", F.col("fault").alias("msg"))


def content_cache(files: DataFrame, folder: str, version: int, parse) -> DataFrame:
    """``hash`` and the columns of ``parse(misses)``, each different content parsed once over all runs.

    ``files`` has ``content``; ``parse`` takes ``hash, content`` and returns rows with ``hash``. Known hashes are read
    from the parquet cache in ``folder`` under this schema version, the others are parsed and appended. Caches of older
    versions are removed; a newer one is refused.
    """
    spark, place = files.sparkSession, f"{folder}/v{version}"
    held = [int(n[1:]) for n in folders(spark, folder) if n.startswith("v") and n[1:].isdigit()]
    if max(held, default=0) > version:
        raise ValueError(f"the cache is of version {max(held)}, newer than {version}")
    for old in held:
        if old < version:
            delete_folder(spark, f"{folder}/v{old}")
    wanted = files.where("content is not null").select(F.sha2("content", 256).alias("hash"), "content").groupBy("hash").agg(F.any_value("content").alias("content"))
    if version in held:
        known = spark.read.parquet(place).dropDuplicates(["hash"])
        parse(wanted.join(known.select("hash"), "hash", "left_anti")).write.mode("append").parquet(place)
    else:
        parse(wanted).write.parquet(place)
    return spark.read.parquet(place).dropDuplicates(["hash"]).join(wanted.select("hash"), "hash", "left_semi")
