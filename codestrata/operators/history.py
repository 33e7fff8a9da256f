"""Churn, ownership and co-change from commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import plain_path


def clean_commits(commits: DataFrame, window_days: int | None = None) -> DataFrame:
    """``scan_id, id, commit_time, author, files``: one row per commit (the one ingested last), files plain, distinct and sorted.

    With ``window_days`` only commits of that many days before the scan's newest are kept. Null ids and scans are no commits; null files are none.
    """
    rows = commits.where("id is not null and scan_id is not null").select("scan_id", "id", "ingested_at", "commit_time", "author", F.transform(F.coalesce("files", F.array().cast("array<string>")), plain_path).alias("files"))
    last = rows.groupBy("scan_id", "id").agg(F.max(F.struct("ingested_at", "commit_time", "author", "files")).alias("v"))
    out = last.select("scan_id", "id", "v.commit_time", "v.author", F.array_sort(F.array_distinct(F.filter("v.files", lambda f: f.isNotNull()))).alias("files"))
    if window_days is None:
        return out
    heads = out.groupBy("scan_id").agg(F.max("commit_time").alias("head_time"))
    return out.join(heads, "scan_id").where(F.col("commit_time") >= F.col("head_time") - window_days * 86_400).drop("head_time")


def repo_history(clean: DataFrame) -> DataFrame:
    """``scan_id, total_commits, with_files, head_time``; commits without files count in the total."""
    return clean.groupBy("scan_id").agg(F.count("*").alias("total_commits"), F.count_if(F.size("files") > 0).alias("with_files"), F.max("commit_time").alias("head_time"))


def file_history(clean: DataFrame) -> DataFrame:
    """``scan_id, path, commits, first_touched, last_touched, authors, top_author, top_author_share``.

    The top author has most commits, of equals the least name; null authors commit but are nobody.
    """
    touched = clean.select("scan_id", "commit_time", "author", F.explode("files").alias("path"))
    by_author = touched.groupBy("scan_id", "path", "author").agg(F.count("*").alias("n"), F.min("commit_time").alias("lo"), F.max("commit_time").alias("hi"))
    # max_by takes the greatest order, so the least name among equals comes from a second, per-count minimum
    best = F.max(F.when(F.col("author").isNotNull(), F.col("n")))
    sums = by_author.groupBy("scan_id", "path").agg(F.sum("n").alias("commits"), F.min("lo").alias("first_touched"), F.max("hi").alias("last_touched"), F.count("author").alias("authors"), best.alias("best"))
    tops = by_author.join(sums.select("scan_id", "path", "best"), ["scan_id", "path"]).where("n = best and author is not null").groupBy("scan_id", "path").agg(F.min("author").alias("top_author"))
    out = sums.join(tops, ["scan_id", "path"], "left")
    return out.select("scan_id", "path", "commits", "first_touched", "last_touched", "authors", "top_author", (F.coalesce("best", F.lit(0)) / F.col("commits")).cast("float").alias("top_author_share"))


def cochange(clean: DataFrame, max_files: int = 50, min_support: int = 5, min_confidence: float = 0.4, limit: int = 500) -> DataFrame:
    """``scan_id, a, b, together, confidence``: the top pairs of each scan that change together.

    Commits of more than ``max_files`` files are left out before anything is counted; confidence is by the less-changed
    file; order is confidence and together descending, then a, b; the limit is the reference's top list.
    """
    kept = clean.where((F.size("files") >= 1) & (F.size("files") <= max_files))
    changes = kept.select("scan_id", F.explode("files").alias("path")).groupBy("scan_id", "path").agg(F.count("*").alias("n"))
    frequent = changes.where(F.col("n") >= min_support)
    firsts = kept.select("scan_id", "files", F.posexplode("files").alias("i", "a")).where(F.col("i") + 1 < F.size("files"))
    pairs = firsts.select("scan_id", "a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("b")).groupBy("scan_id", "a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= min_support)
    named = pairs.join(frequent.select("scan_id", F.col("path").alias("a"), F.col("n").alias("na")), ["scan_id", "a"]).join(frequent.select("scan_id", F.col("path").alias("b"), F.col("n").alias("nb")), ["scan_id", "b"])
    told = named.withColumn("confidence", (F.col("together") / F.least("na", "nb")).cast("float")).where(F.col("confidence") >= F.lit(min_confidence).cast("float"))
    order = Window.partitionBy("scan_id").orderBy(F.desc("confidence"), F.desc("together"), "a", "b")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("scan_id", "a", "b", "together", "confidence")


def percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the FLOAT share of rows of the scan that lie strictly below each value.

    Counts per distinct value are summed along the values, so no scan's rows are sorted in one task.
    """
    counts = df.groupBy("scan_id", value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy("scan_id").orderBy(value)) - F.col("_n")
    share = (below / F.sum("_n").over(Window.partitionBy("scan_id"))).cast("float")
    return df.join(counts.select("scan_id", value, share.alias(out)), ["scan_id", value])
