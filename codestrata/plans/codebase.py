"""Queries on the scans' trees, graphs, history and findings, each with its oracle SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.globs import any_glob
from codestrata.functions.paths import extension, lead_dirs, plain_path
from codestrata.operators import findings as fd
from codestrata.operators import graph, history, timeline, tree
from codestrata.operators.cycles import cycle_groups
from codestrata.operators.snapshots import complete_snapshots, snapshot_rows
from codestrata.plans.snapshots import PLAIN, ROWS_SQL
from codestrata.session import spread, stage
from codestrata.tables import table

#: The layers and rules that the layering queries use.
LAYERS = [fd.Layer("ui", ("src/ui/**", "app/views/**")), fd.Layer("domain", ("src/core/**", "app/models/**", "crates/core/**")), fd.Layer("data", ("src/store/**", "internal/db/**"))]
RULES = ["ui -> domain", "domain -> data", "ui -> nowhere"]


class Scans:
    """The tables that queries start from, made when first asked for and kept for one query."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def table(self, name):
        return table(self.spark, self.d, name)

    @functools.cached_property
    def files(self):
        return stage(tree.latest_files(self.table("snapshots"), self.table("snapshot_files")))

    @functools.cached_property
    def edges(self):
        return tree.import_edges(self.files)

    @functools.cached_property
    def clean(self):
        return history.clean_commits(self.table("commits"))

    @functools.cached_property
    def history(self):
        return history.file_history(self.clean)

    @functools.cached_property
    def fan(self):
        return graph.degrees(self.files, self.edges)

    @functools.cached_property
    def groups(self):
        return stage(cycle_groups(self.edges.select(F.col("scan_id").alias("graph"), "src", "dst")).withColumnRenamed("graph", "scan_id"))

    @functools.cached_property
    def entries(self):
        return self.files.where(T.is_entry_name(F.col("path"))).select("scan_id", "path")

    @functools.cached_property
    def order(self):
        return stage(graph.ordered(graph.levels(self.files, self.edges, self.groups)))

    @functools.cached_property
    def rows(self):
        return snapshot_rows(self.table("snapshots"), self.table("snapshot_files"))[1]

    @functools.cached_property
    def ends(self):
        """The first and the last tree of every scan."""
        kept = stage(self.rows.where("idx = 1 or idx = last_idx").select("scan_id", "path", "idx", "last_idx", F.coalesce("loc", F.lit(0)).alias("loc"), "depends_on"))
        return kept.where("idx = 1"), kept.where("idx = last_idx")

    @functools.cached_property
    def findings(self):
        """Every detector over every scan."""
        self.__dict__["edges"], self.__dict__["clean"] = stage(self.edges), stage(self.clean)
        past, fan = stage(self.history), stage(self.fan)
        return fd.combine([
            fd.case_mismatches(self.files), fd.cycles(self.groups, graph.shortest_cycles(self.edges, self.groups)), fd.god_files(self.files, fan, past),
            fd.orphan_files(self.files, graph.orphans(self.files, self.edges, self.entries)), fd.unstable_interfaces(self.files, fan, past),
            fd.layering_violations(self.edges, LAYERS, RULES), fd.bus_factors(self.files, fan, past), fd.distant_couplings(self.files, self.edges, history.cochange(self.clean))])


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _shown(findings):
    return _round(findings, "score").withColumn("paths", F.concat_ws(",", "paths"))


def q_fan_in_out(s):
    return s.fan


def q_module_edges(s):
    return graph.module_edges(s.edges, s.files)


def q_modules(s):
    return tree.modules(s.files)


def q_path_rollup(s):
    return tree.path_rollup(s.files)


def q_language_counts(s):
    return tree.language_counts(s.files)


def q_missing_targets(s):
    return tree.missing_targets(s.files)


def q_percentile_rank(s):
    return _round(history.percentile(s.files.select("scan_id", "path", "loc"), "loc", "p"), "p")


def q_tangle_members(s):
    return s.groups


def q_shortest_cycle(s):
    return graph.shortest_cycles(s.edges, s.groups).withColumn("chain", F.concat_ws(" > ", "chain"))


def q_impact(s):
    fan = s.fan
    top = fan.groupBy("scan_id").agg(F.min_by("path", F.struct(-F.col("fan_in"), "path")).alias("path"))
    return graph.impact(stage(s.edges), stage(top))


def q_dependencies_of(s):
    top = s.fan.groupBy("scan_id").agg(F.min_by("path", F.struct(-F.col("fan_out"), "path")).alias("seed"))
    return graph.reach(stage(s.edges), stage(top)).select("scan_id", "seed", "path")


def q_orphans(s):
    return graph.orphans(s.files, s.edges, s.entries)


def q_dependency_levels(s):
    return graph.levels(s.files, s.edges, s.groups)


def q_module_bands(s):
    return graph.module_bands(s.order, s.files)


def q_back_edges(s):
    return graph.back_edges(s.order, s.edges)


def q_file_history(s):
    return _round(s.history, "top_author_share")


def q_repo_history(s):
    return history.repo_history(s.clean)


def q_recent_history(s):
    return history.repo_history(history.clean_commits(s.table("commits"), window_days=90))


def q_cochange_pairs(s):
    return _round(history.cochange(s.clean), "confidence")


def q_top_authors(s):
    touched = s.history.where("top_author is not null")
    return touched.groupBy("scan_id").agg(F.count_distinct("top_author").alias("top_authors"))


def q_god_file(s):
    return _shown(fd.god_files(s.files, s.fan, s.history))


def q_unstable_interface(s):
    return _shown(fd.unstable_interfaces(s.files, s.fan, s.history))


def q_bus_factor(s):
    return _shown(fd.bus_factors(s.files, s.fan, s.history))


def q_layer_violations(s):
    return _shown(fd.layering_violations(s.edges, LAYERS, RULES))


def q_distant_coupling(s):
    return _shown(fd.distant_couplings(s.files, s.edges, history.cochange(s.clean)))


def q_orphan_findings(s):
    return _shown(fd.orphan_files(s.files, graph.orphans(s.files, s.edges, s.entries)))


def q_cycle_findings(s):
    return _shown(fd.cycles(s.groups, graph.shortest_cycles(s.edges, s.groups)))


def q_findings_ranked(s):
    return _shown(fd.ranked(fd.capped(s.findings)))


def q_finding_counts(s):
    found = stage(s.findings)
    return fd.counts(found, fd.accept(found, below="Medium"))


def q_node_heat(s):
    return fd.heat(s.files, s.findings)


def q_baseline_states(s):
    found = stage(fd.with_ids(s.findings))
    old = fd.accept(found.where("score < 0.71")).unionByName(fd.accept(found.limit(0)))
    return fd.compare_baseline(found.where("kind <> 'Orphan'"), old).select("scan_id", "state", "headline")


def q_findings_page(s):
    return _shown(fd.page(s.findings, severity="Medium", skip=2, take=5))


def q_top_depended(s):
    fan = s.fan.where("fan_in > 0")
    return fan.orderBy(F.desc("fan_in"), "path", "scan_id").limit(15).select("scan_id", "path", "fan_in")


def q_top_churn(s):
    return s.history.orderBy(F.desc("commits"), "path", "scan_id").limit(15).select("scan_id", "path", "commits")


def q_totals_summary(s):
    sums = s.files.groupBy("scan_id").agg(F.count("*").alias("files"), F.count_distinct("module").alias("modules"), F.sum("loc").alias("loc"))
    return sums.join(s.edges.groupBy("scan_id").agg(F.count("*").alias("edges")), "scan_id", "left").join(tree.missing_targets(s.files).groupBy("scan_id").agg(F.count("*").alias("missing")), "scan_id", "left").fillna(0, ["edges", "missing"])


def q_layer_candidates(s):
    dirs = s.files.select(lead_dirs(F.col("path")).alias("dirs")).where("dirs is not null")
    return dirs.groupBy("dirs").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "dirs").limit(40)


def q_diagram_nodes(s):
    return tree.modules(s.files).select("scan_id", T.diagram_ident(F.col("module")).alias("ident"), "files", F.round(T.node_radius(F.col("loc")), 6).alias("radius"))


def q_snapshot_totals(s):
    return timeline.totals(s.rows)


def q_timeline_sample(s):
    return timeline.sampled(complete_snapshots(s.table("snapshots"), s.table("snapshot_files")))


def q_compare_refs(s):
    return timeline.compare_refs(*s.ends)


def q_cycles_introduced(s):
    base, head = s.ends
    return timeline.cycle_changes(tree.import_edges(base), tree.import_edges(head))


def q_asof_snapshot(s):
    commits = s.clean.select("scan_id", "id", F.col("commit_time").alias("at"))
    snaps = complete_snapshots(s.table("snapshots"), s.table("snapshot_files")).select("scan_id", F.col("snap_time").alias("at"), "idx")
    return timeline.as_of(commits, snaps, "scan_id", "at", "idx")


def q_walk_outcome(s):
    return tree.walk_outcome(s.table("source_files"), any_glob(["*/**", "s*"]), any_glob(["**/*_pb2.py", "static/**", "tools/**"]), max_bytes=4096)


def q_skipped_reasons(s):
    return s.table("skipped_files").groupBy("repo", F.col("reason.tag").alias("tag")).agg(F.count("*").alias("files"), F.sum("reason.bytes").alias("bytes"))


def q_loc_count(s):
    src = spread(s.table("source_files").where("content is not null").select("file_id", "rel_path", "content"))
    body = F.make_valid_utf8(F.col("content").cast("string"))
    return src.select("file_id", T.loc(body, T.language_of(extension(plain_path(F.col("rel_path"))))).alias("loc"), T.total_lines(body).alias("total_lines"))


def q_case_fold_match(s):
    """Paths of skipped files that a source file of the scan has in the same letters, whatever their case, less the extension."""
    stem = lambda c: F.lower(F.regexp_replace(plain_path(F.col(c)), r"\.[^./]*$", ""))
    seen = s.table("source_files").where("rel_path is not null").groupBy("scan_id", stem("rel_path").alias("key")).agg(F.min("file_id").alias("source_id"))
    return s.table("skipped_files").where("rel_path is not null").select("file_id", "scan_id", stem("rel_path").alias("key")).join(seen, ["scan_id", "key"]).select("file_id", "source_id")


CLEAN_SQL = f"""
c0 AS (SELECT scan_id, id, commit_time, author, files FROM commits WHERE id IS NOT NULL AND scan_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY scan_id, id ORDER BY ingested_at DESC NULLS LAST, commit_time DESC NULLS LAST, author DESC NULLS LAST, files DESC NULLS LAST) = 1),
clean AS (SELECT scan_id, id, commit_time, author, list_sort(list_distinct(list_transform(list_filter(coalesce(files, []), lambda x: x IS NOT NULL), lambda x: {PLAIN.format('x')}))) AS files FROM c0),
touched AS (SELECT scan_id, id, commit_time, author, unnest(files) AS path FROM clean),
hist0 AS (SELECT scan_id, path, count(*) AS commits, min(commit_time) AS first_touched, max(commit_time) AS last_touched, count(DISTINCT author) AS authors FROM touched GROUP BY ALL),
by_author AS (SELECT scan_id, path, author AS top_author, count(*) AS n FROM touched WHERE author IS NOT NULL GROUP BY ALL),
tops AS (SELECT * FROM by_author QUALIFY row_number() OVER (PARTITION BY scan_id, path ORDER BY n DESC, top_author) = 1),
hist AS (SELECT h.*, t.top_author, CAST(coalesce(t.n, 0) / h.commits AS FLOAT) AS top_author_share FROM hist0 h LEFT JOIN tops t USING (scan_id, path)),
kept AS (SELECT * FROM clean WHERE len(files) BETWEEN 1 AND 50),
item AS (SELECT scan_id, id, unnest(files) AS path FROM kept),
changes AS (SELECT scan_id, path, count(*) AS n FROM item GROUP BY ALL),
pair AS (SELECT x.scan_id, x.path AS a, y.path AS b, count(*) AS together FROM item x JOIN item y ON x.scan_id = y.scan_id AND x.id = y.id AND x.path < y.path GROUP BY ALL HAVING count(*) >= 5),
co AS (SELECT p.scan_id, p.a, p.b, p.together, CAST(p.together / least(ca.n, cb.n) AS FLOAT) AS confidence
       FROM pair p JOIN changes ca ON ca.scan_id = p.scan_id AND ca.path = p.a JOIN changes cb ON cb.scan_id = p.scan_id AND cb.path = p.b
       WHERE CAST(p.together / least(ca.n, cb.n) AS FLOAT) >= CAST(0.4 AS FLOAT)
       QUALIFY row_number() OVER (PARTITION BY p.scan_id ORDER BY CAST(p.together / least(ca.n, cb.n) AS FLOAT) DESC, p.together DESC, p.a, p.b) <= 500)
"""
LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{v}'" for e, v in T.LANGUAGES.items()) + " END"
TREE_SQL = f"""{ROWS_SQL},
fin AS (SELECT scan_id, max(idx) AS idx FROM n GROUP BY 1),
t AS (SELECT scan_id, path, regexp_replace(path, '/?[^/]*$', '') AS module, coalesce(loc, 0) AS loc, coalesce(bytes, 0) AS bytes, depends_on,
             lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]+)$', 1)) AS ext FROM r JOIN fin USING (scan_id, idx)),
said AS (SELECT DISTINCT scan_id, path AS src, d AS dst FROM (SELECT scan_id, path, unnest(depends_on) AS d FROM t) WHERE d IS NOT NULL),
e AS (SELECT s.* FROM said s SEMI JOIN (SELECT scan_id, path AS dst FROM t) USING (scan_id, dst) WHERE src <> dst),
fan AS (SELECT scan_id, path, (SELECT count(*) FROM e WHERE e.scan_id = t.scan_id AND e.dst = t.path) AS fan_in, (SELECT count(*) FROM e WHERE e.scan_id = t.scan_id AND e.src = t.path) AS fan_out FROM t)
"""
# the name "said" stands in ROWS_SQL too
TREE_SQL = TREE_SQL.replace("said AS (SELECT DISTINCT", "imports AS (SELECT DISTINCT").replace("FROM said s SEMI", "FROM imports s SEMI")
REACH_SQL = """reach(scan_id, a, b) AS (SELECT scan_id, src, dst FROM e UNION SELECT x.scan_id, x.a, y.dst FROM reach x JOIN e y ON y.scan_id = x.scan_id AND y.src = x.b),
member AS (SELECT x.scan_id, x.a AS node, min(x.b) AS component, count(DISTINCT x.b) AS size FROM reach x JOIN reach y ON x.scan_id = y.scan_id AND x.a = y.b AND x.b = y.a GROUP BY ALL HAVING count(DISTINCT x.b) > 1)"""
ENTRY = r"(regexp_matches(path, '(^|/)(main\.rs|lib\.rs|build\.rs|main\.tsx|main\.ts|App\.tsx)$') OR regexp_matches(path, '(^|(^|/)src/)index\.(ts|tsx|js|jsx)$'))"
DEADLY = r"""NOT (regexp_matches(regexp_extract(path, '[^/]*$'), '\.d\.ts$|\.config\.|\.mjs$|\.cjs$') OR regexp_matches(path, '\.test\.|\.spec\.|/tests/|/test/|/examples/|/benches/|__tests__')
 OR (path NOT LIKE '%/%' AND path LIKE '%.js'))"""
SEVERE = "CASE WHEN score >= CAST(0.95 AS FLOAT) THEN 'Critical' WHEN score >= CAST(0.85 AS FLOAT) THEN 'High' WHEN score >= CAST(0.65 AS FLOAT) THEN 'Medium' WHEN score >= CAST(0.4 AS FLOAT) THEN 'Low' ELSE 'Info' END"
MEASURED_SQL = """big AS (SELECT scan_id FROM t GROUP BY 1 HAVING count(*) >= 5),
m AS (SELECT t.scan_id, t.path, t.loc, fan.fan_in, h.commits, coalesce(h.commits, 0) AS churn FROM t SEMI JOIN big USING (scan_id) JOIN fan USING (scan_id, path) LEFT JOIN hist h USING (scan_id, path)),
p AS (SELECT *, CAST((rank() OVER (PARTITION BY scan_id ORDER BY loc) - 1) / count(*) OVER (PARTITION BY scan_id) AS FLOAT) AS p_loc,
             CAST((rank() OVER (PARTITION BY scan_id ORDER BY fan_in) - 1) / count(*) OVER (PARTITION BY scan_id) AS FLOAT) AS p_fan,
             CAST((rank() OVER (PARTITION BY scan_id ORDER BY churn) - 1) / count(*) OVER (PARTITION BY scan_id) AS FLOAT) AS p_churn FROM m)"""
LAYER_SQL = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{any_glob(list(layer.globs))}') THEN '{layer.name}'" for layer in LAYERS) + " END"

GOD_SQL = f"""g AS (SELECT *, CAST(p_loc * p_fan * CASE WHEN scan_id IN (SELECT scan_id FROM hist) THEN p_churn ELSE CAST(0.6 AS FLOAT) END AS FLOAT) AS score FROM p),
god AS (SELECT scan_id, 'God file' AS kind, {SEVERE} AS severity, score, path || ' is ' || loc || ' lines with ' || fan_in || ' dependents' AS headline, path AS paths FROM g WHERE score >= CAST(0.4 AS FLOAT) AND loc >= 200)"""
UNSTABLE_SQL = f"""pc AS (SELECT scan_id, path, CAST((rank() OVER (PARTITION BY scan_id ORDER BY churn) - 1) / count(*) OVER (PARTITION BY scan_id) AS FLOAT) AS p_churn2 FROM m WHERE commits IS NOT NULL),
u AS (SELECT p.*, CAST(p_fan * p_churn2 AS FLOAT) AS score FROM p JOIN pc USING (scan_id, path) WHERE fan_in >= 3 AND churn >= 3),
unstable AS (SELECT scan_id, 'Unstable interface' AS kind, {SEVERE} AS severity, score, path || ' has ' || fan_in || ' dependents and changed ' || churn || ' times' AS headline, path AS paths FROM u WHERE score >= CAST(0.6 AS FLOAT))"""
BUS_SQL = """bus AS (SELECT h.scan_id, 'Bus factor' AS kind, 'Medium' AS severity, CAST(least(least(CAST(fan_in AS FLOAT) / CAST(20 AS FLOAT), 1.0) * 0.5 + 0.4, 1.0) AS FLOAT) AS score,
  path || ' has ' || fan_in || ' dependents and one author (' || top_author || ')' AS headline, path AS paths
  FROM hist h JOIN fan USING (scan_id, path) WHERE authors = 1 AND h.commits >= 5 AND fan_in >= 5 AND h.scan_id IN (SELECT scan_id FROM hist WHERE top_author IS NOT NULL GROUP BY 1 HAVING count(DISTINCT top_author) >= 2))"""
LAYERED_SQL = f"""lay AS (SELECT *, {LAYER_SQL.format('src')} AS la, {LAYER_SQL.format('dst')} AS lb FROM e),
layered AS (SELECT scan_id, 'Layering violation' AS kind, 'High' AS severity, CAST(0.88 AS FLOAT) AS score, la || ' → ' || lb || ': ' || src || ' imports ' || dst AS headline, src || ',' || dst AS paths
  FROM lay WHERE la IS NOT NULL AND lb IS NOT NULL AND la <> lb AND (la, lb) NOT IN (('ui', 'domain'), ('domain', 'data')))"""
DISTANT_SQL = """distant AS (SELECT co.scan_id, 'Distant coupling' AS kind, 'Medium' AS severity, CAST(least(confidence, CAST(1 AS FLOAT)) * CAST(0.8 AS FLOAT) AS FLOAT) AS score,
  a || ' and ' || b || ' change together ' || CAST(CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% of the time but are unrelated in code' AS headline, a || ',' || b AS paths
  FROM co JOIN t ta ON ta.scan_id = co.scan_id AND ta.path = a JOIN t tb ON tb.scan_id = co.scan_id AND tb.path = b
  WHERE confidence >= CAST(0.6 AS FLOAT) AND ta.module <> tb.module AND NOT EXISTS (SELECT 1 FROM e WHERE e.scan_id = co.scan_id AND ((src = a AND dst = b) OR (src = b AND dst = a))))"""
ORPHAN_SQL = f"""orphan AS (SELECT scan_id, 'Orphan' AS kind, 'Low' AS severity, CAST(0.45 AS FLOAT) AS score, path || ' is never imported (' || loc || ' lines)' AS headline, path AS paths
  FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scan_id = t.scan_id AND e.dst = t.path) AND NOT {ENTRY} AND {DEADLY})"""
CASE_SQL = """folded AS (SELECT scan_id, lower(path) AS key, min(path) AS actual FROM t GROUP BY ALL),
cased AS (SELECT i.scan_id, 'Case mismatch' AS kind, 'High' AS severity, CAST(0.86 AS FLOAT) AS score, src || ' imports "' || dst || '" but the file is ' || actual AS headline, src AS paths
  FROM imports i JOIN folded f ON f.scan_id = i.scan_id AND f.key = lower(i.dst) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.scan_id = i.scan_id AND t.path = i.dst))"""
CHAIN_SQL = """inner_e AS (SELECT e.scan_id, a.component, e.src, e.dst FROM e JOIN member a ON a.scan_id = e.scan_id AND a.node = e.src JOIN member b ON b.scan_id = e.scan_id AND b.node = e.dst AND b.component = a.component),
walk(scan_id, component, node, path, len) AS (
  SELECT DISTINCT scan_id, component, component, [component], 0 FROM member
  UNION ALL
  SELECT w.scan_id, w.component, i.dst, list_append(w.path, i.dst), w.len + 1 FROM walk w JOIN inner_e i ON i.scan_id = w.scan_id AND i.component = w.component AND i.src = w.node
  WHERE NOT (w.len > 0 AND w.node = w.component) AND (i.dst = w.component OR NOT list_contains(w.path, i.dst)) AND w.len < 9),
chain AS (SELECT scan_id, component, path FROM walk WHERE len > 0 AND node = component QUALIFY row_number() OVER (PARTITION BY scan_id, component ORDER BY len, path) = 1)"""
CYCLE_SQL = """cyc AS (SELECT m.scan_id, 'Import cycle' AS kind, CASE WHEN size >= 6 THEN 'High' WHEN size >= 3 THEN 'Medium' ELSE 'Low' END AS severity,
  CAST(greatest(least(CAST(CAST(size AS FLOAT) - CAST(2 AS FLOAT) AS DOUBLE) / CAST(10 AS FLOAT), 1.0), 0.0) * 0.5 + 0.5 AS FLOAT) AS score,
  'Cycle across ' || size || ' files: ' || array_to_string(any_value(c.path), ' → ') AS headline, string_agg(node, ',' ORDER BY node) AS paths
  FROM member m JOIN chain c USING (scan_id, component) GROUP BY m.scan_id, component, size)"""
ALL_SQL = f"""WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, {CHAIN_SQL}, {CYCLE_SQL}, {CLEAN_SQL}, {MEASURED_SQL}, {GOD_SQL}, {UNSTABLE_SQL}, {BUS_SQL}, {LAYERED_SQL}, {DISTANT_SQL}, {ORPHAN_SQL}, {CASE_SQL},
found AS (SELECT * FROM cyc UNION ALL SELECT * FROM god UNION ALL SELECT * FROM unstable UNION ALL SELECT * FROM bus UNION ALL SELECT * FROM layered UNION ALL SELECT * FROM distant UNION ALL SELECT * FROM orphan UNION ALL SELECT * FROM cased),
rated AS (SELECT *, list_position(['Info', 'Low', 'Medium', 'High', 'Critical'], severity) AS sev FROM found)"""
SHOWN = "scan_id, kind, severity, round(CAST(score AS DOUBLE), 6) AS score, headline, paths"


def _tree(select: str) -> str:
    return f"WITH {TREE_SQL} {select}"


def _hist(select: str) -> str:
    return f"WITH {CLEAN_SQL} {select}"


SQL = {
    "fan_in_out": _tree("SELECT * FROM fan"),
    "module_edges": _tree("SELECT e.scan_id, a.module AS src_module, b.module AS dst_module, count(*) AS edges FROM e JOIN t a ON a.scan_id = e.scan_id AND a.path = e.src JOIN t b ON b.scan_id = e.scan_id AND b.path = e.dst WHERE a.module <> b.module GROUP BY ALL"),
    "modules": _tree("SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY module) - 1 AS module_id FROM (SELECT scan_id, module, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM t GROUP BY scan_id, module)"),
    "path_rollup": _tree("""SELECT scan_id, dir, count(*) AS files, CAST(sum(greatest(loc, 1)) AS BIGINT) AS size FROM (SELECT scan_id, loc, unnest(list_distinct(list_concat([''], CASE WHEN module = '' THEN [] ELSE
        list_transform(range(1, len(string_split(module, '/')) + 1), lambda k: array_to_string(list_slice(string_split(module, '/'), 1, k), '/')) END))) AS dir FROM t) GROUP BY ALL"""),
    "language_counts": _tree(f"SELECT scan_id, {LANG} AS language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM t GROUP BY ALL"),
    "missing_targets": _tree("SELECT * FROM imports i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.scan_id = i.scan_id AND t.path = i.dst)"),
    "percentile_rank": _tree("SELECT scan_id, path, loc, round(CAST(CAST((rank() OVER (PARTITION BY scan_id ORDER BY loc) - 1) / count(*) OVER (PARTITION BY scan_id) AS FLOAT) AS DOUBLE), 6) AS p FROM t"),
    "tangle_members": f"WITH RECURSIVE {TREE_SQL}, {REACH_SQL} SELECT scan_id, node, component, size FROM member",
    "shortest_cycle": f"WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, {CHAIN_SQL} SELECT scan_id, component, array_to_string(path, ' > ') AS chain FROM chain",
    "impact": f"WITH RECURSIVE {TREE_SQL}, seed AS (SELECT scan_id, path FROM fan QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY fan_in DESC, path) = 1), back(scan_id, path) AS (SELECT scan_id, path FROM seed UNION SELECT e.scan_id, e.src FROM back b JOIN e ON e.scan_id = b.scan_id AND e.dst = b.path) SELECT * FROM back WHERE (scan_id, path) NOT IN (SELECT (scan_id, path) FROM seed)",
    "dependencies_of": f"WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, seed AS (SELECT scan_id, path FROM fan QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY fan_out DESC, path) = 1) SELECT scan_id, a AS seed, b AS path FROM reach WHERE a <> b AND (scan_id, a) IN (SELECT (scan_id, path) FROM seed)",
    "orphans": _tree(f"SELECT scan_id, path FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scan_id = t.scan_id AND e.dst = t.path) AND NOT {ENTRY}"),
    "file_history": _hist("SELECT scan_id, path, commits, first_touched, last_touched, authors, top_author, round(CAST(top_author_share AS DOUBLE), 6) AS top_author_share FROM hist"),
    "repo_history": _hist("SELECT scan_id, count(*) AS total_commits, CAST(sum((len(files) > 0)::INT) AS BIGINT) AS with_files, max(commit_time) AS head_time FROM clean GROUP BY 1"),
    "recent_history": _hist("SELECT scan_id, count(*) AS total_commits, CAST(sum((len(files) > 0)::INT) AS BIGINT) AS with_files, max(commit_time) AS head_time FROM clean c JOIN (SELECT scan_id, max(commit_time) AS hi FROM clean GROUP BY 1) USING (scan_id) WHERE commit_time >= hi - 90 * 86400 GROUP BY 1"),
    "cochange_pairs": _hist("SELECT scan_id, a, b, together, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM co"),
    "top_authors": _hist("SELECT scan_id, count(DISTINCT top_author) AS top_authors FROM hist WHERE top_author IS NOT NULL GROUP BY 1"),
    "god_file": f"WITH {TREE_SQL}, {CLEAN_SQL}, {MEASURED_SQL}, {GOD_SQL} SELECT {SHOWN} FROM god",
    "unstable_interface": f"WITH {TREE_SQL}, {CLEAN_SQL}, {MEASURED_SQL}, {UNSTABLE_SQL} SELECT {SHOWN} FROM unstable",
    "bus_factor": f"WITH {TREE_SQL}, {CLEAN_SQL}, {BUS_SQL} SELECT {SHOWN} FROM bus",
    "layer_violations": f"WITH {TREE_SQL}, {LAYERED_SQL} SELECT {SHOWN} FROM layered",
    "distant_coupling": f"WITH {TREE_SQL}, {CLEAN_SQL}, {DISTANT_SQL} SELECT {SHOWN} FROM distant",
    "orphan_findings": f"WITH {TREE_SQL}, {ORPHAN_SQL} SELECT {SHOWN} FROM orphan",
    "cycle_findings": f"WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, {CHAIN_SQL}, {CYCLE_SQL} SELECT {SHOWN} FROM cyc",
    "findings_ranked": f"{ALL_SQL}, cap AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY scan_id, kind ORDER BY sev DESC, score DESC, headline) <= 100) SELECT {SHOWN}, row_number() OVER (PARTITION BY scan_id ORDER BY sev DESC, score DESC, headline) AS position FROM cap",
    "finding_counts": f"{ALL_SQL} SELECT scan_id, kind, count(*) AS n FROM rated WHERE sev >= 3 GROUP BY ALL",
    "node_heat": f"{ALL_SQL}, hot AS (SELECT scan_id, unnest(string_split(paths, ',')) AS path, [0.1, 0.35, 0.6, 0.85, 1.0][sev] AS h FROM rated) SELECT t.scan_id, t.path, CAST(coalesce(max(h), 0) AS DOUBLE) AS heat FROM t LEFT JOIN hot USING (scan_id, path) GROUP BY ALL",
    "baseline_states": f"""{ALL_SQL} SELECT scan_id, CASE WHEN score < 0.71 THEN CASE WHEN kind = 'Orphan' THEN 'fixed' ELSE 'accepted' END ELSE 'fresh' END AS state, headline FROM rated WHERE kind <> 'Orphan' OR score < 0.71""",
    "findings_page": f"{ALL_SQL} SELECT * FROM (SELECT {SHOWN}, row_number() OVER (PARTITION BY scan_id ORDER BY sev DESC, score DESC, headline) AS position FROM (SELECT *, score AS s2 FROM rated WHERE severity = 'Medium')) WHERE position > 2 AND position <= 7",
    "top_depended": _tree("SELECT scan_id, path, fan_in FROM fan WHERE fan_in > 0 ORDER BY fan_in DESC, path, scan_id LIMIT 15"),
    "top_churn": _hist("SELECT scan_id, path, commits FROM hist ORDER BY commits DESC, path, scan_id LIMIT 15"),
    "totals_summary": _tree("""SELECT scan_id, count(*) AS files, count(DISTINCT module) AS modules, CAST(sum(loc) AS BIGINT) AS loc, coalesce(any_value(ne), 0) AS edges, coalesce(any_value(nm), 0) AS missing FROM t
        LEFT JOIN (SELECT scan_id, count(*) AS ne FROM e GROUP BY 1) USING (scan_id)
        LEFT JOIN (SELECT scan_id, count(*) AS nm FROM imports i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.scan_id = i.scan_id AND t.path = i.dst) GROUP BY 1) USING (scan_id) GROUP BY 1"""),
    "layer_candidates": _tree("SELECT array_to_string(list_slice(string_split(module, '/'), 1, 2), '/') AS dirs, count(*) AS files FROM t WHERE module <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"),
    "diagram_nodes": _tree("SELECT scan_id, CASE WHEN module = '' THEN 'root' WHEN regexp_matches(module, '^[0-9]') THEN 'n' || regexp_replace(module, '[^A-Za-z0-9]', '_', 'g') ELSE regexp_replace(module, '[^A-Za-z0-9]', '_', 'g') END AS ident, count(*) AS files, round(3 + 0.6 * sqrt(sum(loc)), 6) AS radius FROM t GROUP BY scan_id, module"),
    "snapshot_totals": f"WITH {ROWS_SQL} SELECT scan_id, idx, count(*) AS file_count, CAST(sum(coalesce(loc, 0)) AS BIGINT) AS total_loc, CAST(sum(coalesce(len(depends_on), 0)) AS BIGINT) AS edge_count FROM r GROUP BY ALL",
    "compare_refs": f"""WITH {ROWS_SQL}, fin AS (SELECT scan_id, max(idx) AS idx FROM n GROUP BY 1), b AS (SELECT scan_id, path, coalesce(loc, 0) AS loc FROM r WHERE idx = 1), h AS (SELECT scan_id, path, coalesce(loc, 0) AS loc FROM r JOIN fin USING (scan_id, idx))
        SELECT * FROM (SELECT scan_id, path, CASE WHEN b.loc IS NULL THEN 'added' WHEN h.loc IS NULL THEN 'removed' WHEN h.loc > b.loc THEN 'grown' WHEN h.loc < b.loc THEN 'shrunk' END AS change, CAST(h.loc - b.loc AS BIGINT) AS delta FROM b FULL JOIN h USING (scan_id, path)) WHERE change IS NOT NULL""",
    "asof_snapshot": f"WITH {ROWS_SQL}, {CLEAN_SQL.replace('kept AS', 'kept0 AS').split('kept0 AS')[0].rstrip().rstrip(',')} SELECT c.scan_id, c.id, c.commit_time AS at, (SELECT max(idx) FROM n WHERE n.scan_id = c.scan_id AND n.snap_time <= c.commit_time) AS idx FROM clean c",
    "skipped_reasons": "SELECT repo, reason.tag AS tag, count(*) AS files, CAST(sum(reason.bytes) AS BIGINT) AS bytes FROM skipped_files GROUP BY ALL",
    "case_fold_match": f"""WITH s AS (SELECT scan_id, lower(regexp_replace({PLAIN.format('rel_path')}, '\\.[^./]*$', '')) AS key, min(file_id) AS source_id FROM source_files WHERE rel_path IS NOT NULL GROUP BY ALL)
        SELECT k.file_id, s.source_id FROM (SELECT file_id, scan_id, lower(regexp_replace({PLAIN.format('rel_path')}, '\\.[^./]*$', '')) AS key FROM skipped_files WHERE rel_path IS NOT NULL) k JOIN s USING (scan_id, key)""",
}


def _query(call):
    return lambda spark, d: call(Scans(spark, d))


QUERIES = {name[2:]: _query(call) for name, call in list(globals().items()) if name.startswith("q_")}
