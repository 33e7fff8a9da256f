"""Queries on diagrams, reports, tours, workspaces and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import export, tour, tree
from codestrata.plans.codebase import TREE_SQL, Scans
from codestrata.plans.snapshots import PLAIN
from codestrata.session import stage
from codestrata.streaming import changes
from codestrata.tables import table


def diagram_d2(spark, d):
    s = Scans(spark, d)
    return export.d2(*export.diagram_parts(s.files, s.edges, s.groups))


def diagram_mermaid(spark, d):
    s = Scans(spark, d)
    return export.mermaid(*export.diagram_parts(s.files, s.edges, s.groups))


def markdown_report(spark, d):
    s = Scans(spark, d)
    return export.report(s.files, s.edges, stage(s.history), stage(s.findings), tree.missing_targets(s.files))


def reading_tour(spark, d):
    s = Scans(spark, d)
    return tour.tour(s.files, s.edges, s.entries, s.history)


def workspace_files(spark, d):
    s = Scans(spark, d)
    members = s.table("repo_info").select("scan_id", F.concat_ws("@", "repo", F.col("scan_id").cast("string")).alias("member"))
    return tour.workspace_files(s.files, members)


def change_bursts(spark, d):
    found = changes.bursts(table(spark, d, "source_files"), "scan_id", "walked_at", "rel_path", gap="10 minutes")
    return found.select("scan_id", F.size("paths").alias("paths"), "started")


def daily_changes(spark, d):
    return changes.windowed_counts(table(spark, d, "commits"), "scan_id", "ingested_at")


QUERIES = {"diagram_d2": diagram_d2, "diagram_mermaid": diagram_mermaid, "markdown_report": markdown_report, "reading_tour": reading_tour, "workspace_files": workspace_files, "change_bursts": change_bursts, "daily_changes": daily_changes}
SQL = {
    "workspace_files": f"WITH {TREE_SQL}, m AS (SELECT scan_id, concat_ws('@', repo, CAST(scan_id AS VARCHAR)) AS member FROM repo_info) SELECT row_number() OVER (ORDER BY member, member || '/' || path) - 1 AS file_no, member, member || '/' || path AS path FROM t JOIN m USING (scan_id)",
    "daily_changes": "SELECT scan_id, date_trunc('day', ingested_at) AS started, count(*) AS changes FROM commits WHERE ingested_at IS NOT NULL GROUP BY ALL",
}
