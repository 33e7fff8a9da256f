"""Queries on source text: imports, definitions, resolution and calls."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.paths import file_name, plain_path
from codestrata.operators import imports as op
from codestrata.operators import resolve as rs
from codestrata.plans.snapshots import PLAIN
from codestrata.session import spread, stage
from codestrata.tables import table


class Sources:
    """The parsed tables that queries start from, made when first asked for."""

    def __init__(self, spark, d):
        self.raw = table(spark, d, "source_files")

    @functools.cached_property
    def files(self):
        return op.sources(spread(self.raw.select("file_id", "scan_id", "rel_path", "content")))

    @functools.cached_property
    def lines(self):
        return op.code_lines(self.files)

    @functools.cached_property
    def statements(self):
        return stage(op.import_statements(self.files))

    @functools.cached_property
    def paths(self):
        return self.raw.where("rel_path is not null").select("scan_id", plain_path(F.col("rel_path")).alias("path"))

    @functools.cached_property
    def texts(self):
        """The manifests among the source files."""
        path = plain_path(F.col("rel_path"))
        return self.raw.where("content is not null").where(file_name(path).rlike(r"^(tsconfig(\..*)?\.json|package\.json|go\.mod|Cargo\.toml)$")).select("scan_id", path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))

    @functools.cached_property
    def resolved(self):
        return rs.resolve(self.statements, self.paths, rs.project_of(self.texts, self.paths, self.statements))


def source_edges(spark, d):
    s = Sources(spark, d)
    s.__dict__["files"] = stage(s.files)
    return rs.source_edges(s.statements, stage(s.resolved), stage(op.exports(s.files)))


QUERIES = {
    "import_statements": lambda spark, d: op.import_statements(Sources(spark, d).files).select("file_id", "kind", "specifier", "line"),
    "file_exports": lambda spark, d: op.exports(Sources(spark, d).files).select("file_id", "name", "specifier", "line"),
    "definitions": lambda spark, d: op.definitions(Sources(spark, d).lines).select("file_id", "line", "kind", "name", "exported"),
    "resolved_imports": lambda spark, d: Sources(spark, d).resolved.select("file_id", "specifier", F.array_join("names", ",").alias("names"), "outcome", "target").distinct(),
    "import_outcomes": lambda spark, d: Sources(spark, d).resolved.groupBy("outcome").agg(F.count("*").alias("imports")),
    "source_edges": source_edges,
    "symbol_edges": lambda spark, d: op.symbol_edges(stage(Sources(spark, d).lines)),
    "external_packages": lambda spark, d: Sources(spark, d).resolved.where("outcome = 'External'").groupBy("target").agg(F.count("*").alias("imports")).orderBy(F.desc("imports"), "target").limit(50),
}


SQL = {}
