"""Diagrams and reports as lines of text, one set per scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators.graph import degrees, module_edges
from codestrata.operators.running import row_numbers


def diagram_parts(files: DataFrame, edges: DataFrame, groups: DataFrame, max_nodes: int = 120) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Module nodes (``scan_id, ident, label, files, cyclic``), edges between them (``scan_id, a, b, n``) and the number of nodes left out.

    The ``max_nodes`` largest modules of a scan are shown, by size and ident; edges need both ends shown.
    """
    cyclic = groups.select("scan_id", F.col("node").alias("path"), F.lit(1).alias("c"))
    sized = files.join(cyclic, ["scan_id", "path"], "left").groupBy("scan_id", "module").agg(F.count("*").alias("files"), F.count("c").alias("cyclic"))
    named = sized.select("scan_id", "module", T.diagram_ident(F.col("module")).alias("ident"), F.when(F.col("module") == "", "(root)").otherwise(F.col("module")).alias("label"), "files", "cyclic")
    order = Window.partitionBy("scan_id").orderBy(F.desc("files"), "ident")
    placed = named.withColumn("rank", F.row_number().over(order))
    nodes = placed.where(F.col("rank") <= max_nodes)
    left_out = placed.groupBy("scan_id").agg(F.greatest(F.count("*") - max_nodes, F.lit(0)).alias("left_out"))
    end = lambda side, out: nodes.select("scan_id", F.col("module").alias(side), F.col("ident").alias(out))
    shown = module_edges(edges, files).join(end("src_module", "a"), ["scan_id", "src_module"]).join(end("dst_module", "b"), ["scan_id", "dst_module"]).select("scan_id", "a", "b", F.col("edges").alias("n"))
    return nodes.drop("rank", "module"), shown, left_out


def _lines(parts: list[tuple[int, DataFrame, Column, list[Column]]]) -> DataFrame:
    """``scan_id, part, sort, line`` of several sections; rows of a section are sorted by its keys."""
    rows = [df.select("scan_id", F.lit(part).alias("part"), F.array(*[k.cast("string") for k in keys]).alias("sort"), line.alias("line")) for part, df, line, keys in parts]
    return reduce(DataFrame.unionByName, rows)


def numbered(lines: DataFrame) -> DataFrame:
    """``scan_id, line_no, line`` in writing order."""
    placed = row_numbers(lines, ["scan_id"], [F.col("part"), F.col("sort"), F.col("line")], "line_no")
    return placed.select("scan_id", "line_no", "line")


def d2(nodes: DataFrame, edges: DataFrame, left_out: DataFrame) -> DataFrame:
    """``scan_id, line_no, line`` of a D2 diagram."""
    box = F.concat(F.col("ident"), F.lit(': "'), F.col("label"), F.when(F.col("cyclic") > 0, '" { style.stroke: "#f87171" }').otherwise('"'))
    arrow = F.concat(F.col("a"), F.lit(" -> "), F.col("b"), F.when(F.col("n") > 1, F.concat(F.lit(": "), F.col("n").cast("string"))).otherwise(""))
    scans = nodes.select("scan_id").distinct()
    more = left_out.where("left_out > 0")
    return numbered(_lines([(0, scans, F.lit("direction: right"), []), (1, nodes, box, [F.col("ident")]), (2, edges, arrow, [F.col("a"), F.col("b")]), (3, more, F.format_string("# %d more nodes omitted", "left_out"), [])]))


def mermaid(nodes: DataFrame, edges: DataFrame, left_out: DataFrame) -> DataFrame:
    """``scan_id, line_no, line`` of a Mermaid diagram."""
    box = F.format_string('  %s["%s"]', "ident", "label")
    arrow = F.when(F.col("n") > 1, F.format_string("  %s -->|%d| %s", "a", "n", "b")).otherwise(F.format_string("  %s --> %s", "a", "b"))
    scans = nodes.select("scan_id").distinct()
    rings = nodes.where("cyclic > 0")
    more = left_out.where("left_out > 0")
    return numbered(_lines([
        (0, scans, F.lit("graph LR"), []), (1, nodes, box, [F.col("ident")]), (2, edges, arrow, [F.col("a"), F.col("b")]),
        (3, rings, F.format_string("  style %s stroke:#f87171,stroke-width:2px", "ident"), [F.col("ident")]), (4, more, F.format_string("  %%%% %d more nodes omitted", "left_out"), [])]))


def report(files: DataFrame, edges: DataFrame, history: DataFrame, findings: DataFrame, missing: DataFrame, top: int = 15) -> DataFrame:
    """``scan_id, line_no, line`` of a Markdown report: totals, findings, the most depended upon and most changed files, and imports without a file."""
    zero = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    sums = files.groupBy("scan_id").agg(F.count("*").alias("files"), F.count_distinct("module").alias("modules"), F.sum("loc").alias("loc"))
    for df, name in ((edges, "edges"), (findings, "findings"), (missing, "missing")):
        sums = sums.join(zero(df, name), "scan_id", "left")
    sums = sums.fillna(0)
    first = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id").orderBy(*keys))).where(F.col("rank") <= top)
    used = first(degrees(files, edges).where("fan_in > 0"), F.desc("fan_in"), F.col("path")).join(files.select("scan_id", "path", "loc"), ["scan_id", "path"]).join(history.select("scan_id", "path", "commits"), ["scan_id", "path"], "left")
    churn = first(history, F.desc("commits"), F.col("path"))
    place = F.lpad(F.col("rank").cast("string"), 6, "0")
    row = lambda label, c: (F.format_string(f"| {label} | %d |", c))
    scans = sums.select("scan_id")
    parts = [(0, scans, F.format_string("# Scan %s", F.col("scan_id").cast("string")), []), (1, scans, F.lit("| | |\n|---|---|"), [])]
    parts += [(2 + i, sums, row(label, c), []) for i, (label, c) in enumerate((("Files", "files"), ("Modules", "modules"), ("Dependencies", "edges"), ("Lines of code", "loc"), ("Findings", "findings"), ("Unresolved imports", "missing")))]
    parts += [
        (10, sums, F.when(F.col("findings") > 0, F.lit("## Findings")).otherwise(F.lit("## Findings\nNothing to report.")), []),
        (11, findings, F.format_string("- **%s** %s", "severity", "headline"), [F.lpad((10 - T.severity_rank(F.col("severity"))).cast("string"), 2, "0"), F.col("headline")]),
        (12, scans, F.lit("## Most depended upon\n| File | Dependents | Lines | Commits |\n|---|---:|---:|---:|"), []),
        (13, used, F.format_string("| `%s` | %d | %d | %d |", "path", "fan_in", "loc", F.coalesce("commits", F.lit(0))), [place]),
        (14, scans, F.lit("## Churn hotspots\n| File | Commits | Authors | Owner |\n|---|---:|---:|---|"), []),
        (15, churn, F.format_string("| `%s` | %d | %d | %s (%.0f%%) |", "path", "commits", "authors", F.coalesce("top_author", F.lit("?")), F.col("top_author_share").cast("double") * 100), [place]),
        (16, sums.where("missing > 0"), F.lit("## Unresolved imports\n| File | Import |\n|---|---|"), []),
        (17, missing, F.format_string("| `%s` | `%s` |", "src", "dst"), [F.col("src"), F.col("dst")])]
    return numbered(_lines(parts))


def write_text(lines: DataFrame, folder: str) -> None:
    """One folder of text per scan, its lines in order; scans are written by different tasks."""
    lines.repartition("scan_id").sortWithinPartitions("scan_id", "line_no").select("scan_id", "line").write.partitionBy("scan_id").text(folder)


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON object in ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
