"""Looking at single files and edges: neighbours, import sites, lookup by part of a path, search and view filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``scan_id, path, relation, other``: what each of the ``wanted`` files (``scan_id, path``) imports and what imports it, one row each."""
    asked = wanted.select("scan_id", "path").distinct()
    out = edges.join(asked.withColumnRenamed("path", "src"), ["scan_id", "src"], "left_semi").select("scan_id", F.col("src").alias("path"), F.lit("imports").alias("relation"), F.col("dst").alias("other"))
    back = edges.join(asked.withColumnRenamed("path", "dst"), ["scan_id", "dst"], "left_semi").select("scan_id", F.col("dst").alias("path"), F.lit("imported by").alias("relation"), F.col("src").alias("other"))
    return out.unionByName(back).distinct()


def node_detail(files: DataFrame, fan: DataFrame, history: DataFrame, findings: DataFrame, missing: DataFrame, wanted: DataFrame) -> DataFrame:
    """``scan_id, path, module, language, loc, fan_in, fan_out, commits, top_author, findings, unresolved`` of the ``wanted`` files.

    The last two are counts; commits is 0 and the author null without history. Neighbours come from :func:`neighbours`.
    """
    key = ["scan_id", "path"]
    named = findings.select("scan_id", F.explode("paths").alias("path")).groupBy(*key).agg(F.count("*").alias("findings"))
    lost = missing.groupBy("scan_id", F.col("src").alias("path")).agg(F.count("*").alias("unresolved"))
    rows = files.join(wanted.select(*key).distinct(), key, "left_semi").join(fan, key, "left").join(history.select(*key, "commits", "top_author"), key, "left").join(named, key, "left").join(lost, key, "left")
    return rows.select(*key, "module", "language", "loc", "fan_in", "fan_out", F.coalesce("commits", F.lit(0)).alias("commits"), "top_author", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def edge_sites(statements: DataFrame, resolved: DataFrame) -> DataFrame:
    """``scan_id, src, dst, line, kind, specifier``: the import statements behind each edge, as written; barrels are not seen through."""
    hits = resolved.where("outcome in ('Resolved', 'CaseMismatch')").select("scan_id", "file_id", "specifier", F.col("names").alias("wanted"), F.col("target").alias("dst"))
    asked = statements.withColumn("wanted", F.when(F.col("family") == "python", F.col("names")).otherwise(F.array().cast("array<string>")))
    met = asked.join(hits, ["scan_id", "file_id", "specifier", "wanted"])
    return met.where("path <> dst").select("scan_id", F.col("path").alias("src"), "dst", "line", "kind", "specifier")


def find_files(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``scan_id, asked, path, hits, also``: the file that each ``asked`` part of a path (``scan_id, asked``) means.

    The file of just that path; else the only one that ends in it at a folder's begin. Where several do, ``path`` and
    ``also`` are the two least of ``hits`` and nothing is meant; where none does, both are null and ``hits`` is 0.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, n, F.size(parts))))
    tails = files.select("scan_id", "path", F.posexplode(ends).alias("at", "asked"))
    # merged by hint: the optimizer takes the exploded tails for no larger than the files, and would broadcast them
    tails = tails.hint("merge")
    key = ["scan_id", "asked"]
    told = asked.select(*key).distinct().join(tails, key, "left").groupBy(*key).agg(F.max(F.when(F.col("at") == 0, F.col("path"))).alias("exact"), F.count("path").alias("n"), F.min("path").alias("first"))
    both = told.join(tails, key, "left").groupBy(*key).agg(F.max("exact").alias("exact"), F.max("n").alias("n"), F.min("first").alias("first"), F.min(F.when(F.col("path") != F.col("first"), F.col("path"))).alias("also"))
    return both.select("scan_id", "asked", F.coalesce("exact", "first").alias("path"), F.when(F.col("exact").isNotNull(), 1).otherwise(F.col("n")).cast("long").alias("hits"), F.when(F.col("exact").isNull(), F.col("also")).alias("also"))


def search(fan: DataFrame, part: str, most: int = 60) -> DataFrame:
    """``scan_id, place, path, fan_in``: the ``most`` most imported files of a scan whose path holds ``part`` in any letter case; the limit is the search's list."""
    met = fan.where(F.contains(F.lower("path"), F.lit(part.lower())))
    return met.select("scan_id", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("fan_in"), "path")).alias("place"), "path", "fan_in").where(F.col("place") <= most)


def view(files: DataFrame, fan: DataFrame, min_loc: int = 0, part: str = "", orphans_only: bool = False) -> DataFrame:
    """``scan_id, path, loc, fan_in``: files of at least ``min_loc`` lines whose path holds ``part``, or only those that nothing imports."""
    rows = files.select("scan_id", "path", "loc").join(fan.select("scan_id", "path", "fan_in"), ["scan_id", "path"])
    kept = rows.where((F.col("loc") >= min_loc) & F.contains(F.lower("path"), F.lit(part.lower())))
    return kept.where("fan_in = 0") if orphans_only else kept


def headline_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``scan_id, headline, severity, change``: findings (with ``scan_id, headline, severity``) that are ``new`` or ``fixed`` between two revisions, by headline as it stands; repeats stay."""
    key = ["scan_id", "headline"]
    came = new.join(old.select(*key), key, "left_anti").select(*key, "severity", F.lit("new").alias("change"))
    return came.unionByName(old.join(new.select(*key), key, "left_anti").select(*key, "severity", F.lit("fixed").alias("change")))


def finding_markdown(findings: DataFrame) -> DataFrame:
    """``scan_id, headline, text``: each finding as a section of Markdown: headline, kind, severity and files."""
    listed = F.array_join(F.transform("paths", lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n")
    text = F.concat(F.lit("### "), "headline", F.lit("\n\n**"), "kind", F.lit("** · "), "severity", F.when(F.size("paths") > 0, F.concat(F.lit("\n\n"), listed)).otherwise(F.lit("")), F.lit("\n"))
    return findings.select("scan_id", "headline", text.alias("text"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """``scan_id, severity, rank, n``, the most severe with the greatest rank."""
    return findings.groupBy("scan_id", "severity").agg(F.count("*").alias("n")).select("scan_id", "severity", T.severity_rank(F.col("severity")).alias("rank"), "n")
