"""Queries on single files, searches and views, with their oracle SQL, and SQL for queries of other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import details as op
from codestrata.operators import findings as fd
from codestrata.operators import tree
from codestrata.plans.codebase import ALL_SQL, CLEAN_SQL, REACH_SQL, TREE_SQL, LANG, Scans
from codestrata.plans.codebase import LAYERS, LAYER_SQL, RULES
from codestrata.plans.snapshots import PLAIN, ROWS_SQL
from codestrata.session import stage


def _top(s):
    """The most imported file of each scan."""
    return s.fan.groupBy("scan_id").agg(F.min_by("path", F.struct(-F.col("fan_in"), "path")).alias("path"))


def node_neighbours(s):
    return op.neighbours(s.edges, stage(_top(s)))


def node_detail(s):
    found = stage(s.findings)
    return op.node_detail(s.files, s.fan, s.history, found, tree.missing_targets(s.files), stage(_top(s)))


def file_lookup(s):
    return op.find_files(s.files, s.files.select("scan_id", F.substring_index("path", "/", -1).alias("asked")))


def palette_search(s):
    return op.search(s.fan, "LINK")


def view_filter(s):
    return op.view(s.files, s.fan, min_loc=100, part="src/")


def view_orphans(s):
    return op.view(s.files, s.fan, orphans_only=True)


def layering_changes(s):
    """Layering findings that came and went between the first and the last tree of a scan."""
    base, head = (fd.layering_violations(tree.import_edges(t), LAYERS, RULES) for t in s.ends)
    return op.headline_changes(base, head)


def bus_factor_from_two(s):
    """The bus factor detector from two commits and one dependent on."""
    found = fd.bus_factors(s.files, s.fan, s.history, min_commits=2, min_dependents=1)
    return found.withColumn("score", F.round(F.col("score").cast("double"), 6)).withColumn("paths", F.concat_ws(",", "paths"))


def names_in_any_case(s):
    """Files of the last trees whose paths differ in letter case only between scans of one repository, and how often each is so."""
    spelled = s.files.join(s.table("repo_info").select("scan_id", "repo"), "scan_id").groupBy("repo", F.lower("path").alias("key")).agg(F.count_distinct("path").alias("spellings"), F.count("*").alias("files"))
    return spelled.where("files > 1").groupBy("spellings").agg(F.count("*").alias("paths"), F.sum("files").alias("files"))


def finding_sections(s):
    return op.finding_markdown(s.findings)


def severity_counts(s):
    return op.severity_counts(s.findings)


def _query(call):
    return lambda spark, d: call(Scans(spark, d))


QUERIES = {c.__name__: _query(c) for c in (node_neighbours, node_detail, file_lookup, palette_search, view_filter, view_orphans, layering_changes, bus_factor_from_two, names_in_any_case, finding_sections, severity_counts)}

TOP_SQL = "top AS (SELECT scan_id, path FROM fan QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY fan_in DESC, path) = 1)"
UNITS_SQL = """unit AS (SELECT t.scan_id, t.path, coalesce(m.component, t.path) AS unit FROM t LEFT JOIN member m ON m.scan_id = t.scan_id AND m.node = t.path),
ue AS (SELECT DISTINCT e.scan_id, a.unit AS a, b.unit AS b FROM e JOIN unit a ON a.scan_id = e.scan_id AND a.path = e.src JOIN unit b ON b.scan_id = e.scan_id AND b.path = e.dst WHERE a.unit <> b.unit),
climb(scan_id, unit, level) AS (SELECT DISTINCT scan_id, unit, 0 FROM unit UNION SELECT c.scan_id, ue.a, c.level + 1 FROM climb c JOIN ue ON ue.scan_id = c.scan_id AND ue.b = c.unit),
lev AS (SELECT u.scan_id, u.path, max(c.level) AS level FROM unit u JOIN climb c USING (scan_id, unit) GROUP BY ALL),
ord AS (SELECT scan_id, path, row_number() OVER (PARTITION BY scan_id ORDER BY level, path) - 1 AS position FROM lev)"""
ENDS_SQL = f"""{ROWS_SQL}, fin AS (SELECT scan_id, max(idx) AS idx FROM n GROUP BY 1),
trees AS (SELECT 'old' AS side, scan_id, path, depends_on FROM r WHERE idx = 1 UNION ALL SELECT 'new', scan_id, path, depends_on FROM r JOIN fin USING (scan_id, idx)),
be AS (SELECT DISTINCT side, scan_id, path AS src, d AS dst FROM (SELECT side, scan_id, path, unnest(depends_on) AS d FROM trees) x WHERE d <> path AND EXISTS (SELECT 1 FROM trees y WHERE y.side = x.side AND y.scan_id = x.scan_id AND y.path = x.d))"""
# lines are folded one by one: a struct of the line, the lines counted so far, and whether a block comment is open
SPACE = "' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
LOC_SQL = f"""SELECT file_id, CAST(list_reduce(list_prepend({{'s': '', 'n': 0, 'o': false}}, list_transform(string_split(body, chr(10)), lambda l: {{'s': ltrim(l, {SPACE}), 'n': 0, 'o': false}})),
  lambda a, b: CASE WHEN a.o THEN {{'s': '', 'n': a.n, 'o': NOT contains(b.s, '*/')}} WHEN starts_with(b.s, '/*') THEN {{'s': '', 'n': a.n, 'o': NOT contains(substr(b.s, 2), '*/')}}
    WHEN b.s = '' OR starts_with(b.s, mark) THEN {{'s': '', 'n': a.n, 'o': false}} ELSE {{'s': '', 'n': a.n + 1, 'o': false}} END).n AS INT) AS loc,
  CAST(length(body) - length(replace(body, chr(10), '')) + CASE WHEN body = '' OR ends_with(body, chr(10)) THEN 0 ELSE 1 END AS INT) AS total_lines
FROM (SELECT file_id, decode(content) AS body, CASE WHEN regexp_matches(lower(rel_path), '\\.pyi?$') THEN '#' ELSE '//' END AS mark FROM source_files WHERE content IS NOT NULL)"""
IN_SKIPPED = "len(list_intersect(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), [" + ", ".join(f"'{d}'" for d in T.SKIP_DIRS) + "])) > 0"
BASE_NAME = "regexp_extract(path, '[^/]*$')"
SQL = {
    "node_neighbours": f"WITH {TREE_SQL}, {TOP_SQL} SELECT e.scan_id, src AS path, 'imports' AS relation, dst AS other FROM e JOIN top ON top.scan_id = e.scan_id AND top.path = e.src UNION SELECT e.scan_id, dst, 'imported by', src FROM e JOIN top ON top.scan_id = e.scan_id AND top.path = e.dst",
    "node_detail": f"""{ALL_SQL}, {TOP_SQL} SELECT t.scan_id, t.path, t.module, {LANG} AS language, t.loc, f.fan_in, f.fan_out, coalesce(h.commits, 0) AS commits, h.top_author,
      (SELECT count(*) FROM rated x WHERE x.scan_id = t.scan_id AND list_contains(string_split(x.paths, ','), t.path)) AS findings,
      (SELECT count(*) FROM imports i WHERE i.scan_id = t.scan_id AND i.src = t.path AND NOT EXISTS (SELECT 1 FROM t y WHERE y.scan_id = i.scan_id AND y.path = i.dst)) AS unresolved
      FROM t JOIN top USING (scan_id, path) JOIN fan f USING (scan_id, path) LEFT JOIN hist h USING (scan_id, path)""",
    "file_lookup": f"""WITH {TREE_SQL}, a AS (SELECT DISTINCT scan_id, {BASE_NAME} AS asked FROM t), hit AS (SELECT a.scan_id, asked, path, row_number() OVER (PARTITION BY a.scan_id, asked ORDER BY path) AS k, path = asked AS same FROM a JOIN t ON t.scan_id = a.scan_id AND (path = asked OR ends_with(path, '/' || asked)))
      SELECT scan_id, asked, CASE WHEN bool_or(same) THEN asked ELSE min(path) END AS path, CASE WHEN bool_or(same) THEN 1 ELSE count(*) END AS hits, CASE WHEN NOT bool_or(same) THEN min(path) FILTER (WHERE k = 2) END AS also FROM hit GROUP BY scan_id, asked""",
    "palette_search": f"WITH {TREE_SQL} SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY fan_in DESC, path) AS place, path, fan_in FROM fan WHERE path ILIKE '%link%' QUALIFY place <= 60",
    "view_filter": f"WITH {TREE_SQL} SELECT scan_id, path, loc, fan_in FROM t JOIN fan USING (scan_id, path) WHERE loc >= 100 AND path ILIKE '%src/%'",
    "view_orphans": f"WITH {TREE_SQL} SELECT scan_id, path, loc, fan_in FROM t JOIN fan USING (scan_id, path) WHERE fan_in = 0",
    "layering_changes": f"""WITH {ENDS_SQL}, lay AS (SELECT *, {LAYER_SQL.format('src')} AS la, {LAYER_SQL.format('dst')} AS lb FROM be),
      v AS (SELECT side, scan_id, la || ' → ' || lb || ': ' || src || ' imports ' || dst AS headline FROM lay WHERE la IS NOT NULL AND lb IS NOT NULL AND la <> lb AND (la, lb) NOT IN (('ui', 'domain'), ('domain', 'data')))
      SELECT scan_id, headline, 'High' AS severity, CASE side WHEN 'new' THEN 'new' ELSE 'fixed' END AS change FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.side <> v.side AND w.scan_id = v.scan_id AND w.headline = v.headline)""",
    "bus_factor_from_two": f"""WITH {TREE_SQL}, {CLEAN_SQL} SELECT scan_id, kind, severity, round(CAST(score AS DOUBLE), 6) AS score, headline, paths FROM (
      SELECT h.scan_id, 'Bus factor' AS kind, 'Medium' AS severity, CAST(least(least(CAST(fan_in AS FLOAT) / CAST(20 AS FLOAT), 1.0) * 0.5 + 0.4, 1.0) AS FLOAT) AS score, path || ' has ' || fan_in || ' dependents and one author (' || top_author || ')' AS headline, path AS paths
      FROM hist h JOIN fan USING (scan_id, path) WHERE authors = 1 AND h.commits >= 2 AND fan_in >= 1 AND h.scan_id IN (SELECT scan_id FROM hist WHERE top_author IS NOT NULL GROUP BY 1 HAVING count(DISTINCT top_author) >= 2))""",
    "names_in_any_case": f"WITH {TREE_SQL} SELECT spellings, count(*) AS paths, CAST(sum(files) AS BIGINT) AS files FROM (SELECT repo, lower(path) AS key, count(DISTINCT path) AS spellings, count(*) AS files FROM t JOIN repo_info USING (scan_id) GROUP BY ALL HAVING count(*) > 1) GROUP BY 1",
    "finding_sections": f"""{ALL_SQL} SELECT scan_id, headline, '### ' || headline || chr(10) || chr(10) || '**' || kind || '** · ' || severity || CASE WHEN paths = '' THEN '' ELSE chr(10) || chr(10) || array_to_string(list_transform(string_split(paths, ','), lambda p: '- `' || p || '`'), chr(10)) END || chr(10) AS text FROM rated""",
    "severity_counts": f"{ALL_SQL} SELECT scan_id, severity, sev AS rank, count(*) AS n FROM rated GROUP BY ALL",
    "dependency_levels": f"WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, {UNITS_SQL} SELECT scan_id, path, level FROM lev",
    "back_edges": f"WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, {UNITS_SQL} SELECT e.scan_id, src, dst FROM e JOIN ord a ON a.scan_id = e.scan_id AND a.path = e.src JOIN ord b ON b.scan_id = e.scan_id AND b.path = e.dst WHERE b.position > a.position",
    "module_bands": f"""WITH RECURSIVE {TREE_SQL}, {REACH_SQL}, {UNITS_SQL}, isle AS (SELECT scan_id, module, position, position - row_number() OVER (PARTITION BY scan_id, module ORDER BY position) AS g FROM ord JOIN t USING (scan_id, path))
      SELECT scan_id, module, min(position) AS start, count(*) AS length FROM isle GROUP BY scan_id, module, g""",
    "cycles_introduced": f"""WITH RECURSIVE {ENDS_SQL}, rc(side, scan_id, a, b) AS (SELECT * FROM be UNION SELECT x.side, x.scan_id, x.a, y.dst FROM rc x JOIN be y ON y.side = x.side AND y.scan_id = x.scan_id AND y.src = x.b),
      g AS (SELECT DISTINCT side, scan_id, members FROM (SELECT x.side, x.scan_id, x.a, list_sort(list(DISTINCT x.b)) AS members FROM rc x JOIN rc y ON x.side = y.side AND x.scan_id = y.scan_id AND x.a = y.b AND x.b = y.a GROUP BY ALL) WHERE len(members) > 1)
      SELECT scan_id, members[1] AS component, len(members) AS size, CASE side WHEN 'new' THEN 'introduced' ELSE 'resolved' END AS change FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.side <> g.side AND h.scan_id = g.scan_id AND h.members = g.members)""",
    "loc_count": LOC_SQL,
    "timeline_sample": f"""WITH {ROWS_SQL}, p AS (SELECT scan_id, commit_id, snap_time, idx, row_number() OVER w AS pos, max(snap_time) OVER s AS hi, min(snap_time) OVER s AS lo, count(*) OVER s AS total FROM n
        WINDOW w AS (PARTITION BY scan_id ORDER BY snap_time DESC, idx DESC), s AS (PARTITION BY scan_id)),
      q AS (SELECT *, least(6, total) AS want, pos = min(pos) OVER (PARTITION BY scan_id, round((hi - snap_time) / greatest(hi - lo, 1)::DOUBLE * 5)) AS newest FROM p),
      c AS (SELECT *, count(*) FILTER (WHERE newest) OVER (PARTITION BY scan_id) AS chosen FROM q),
      x AS (SELECT *, NOT newest AND chosen < want AND list_contains(list_transform(range(0, want), lambda k: CAST(floor(k * greatest(total / want::DOUBLE, 1.0)) AS BIGINT) + 1), pos) AS extra FROM c),
      y AS (SELECT *, count(*) FILTER (WHERE extra) OVER (PARTITION BY scan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM x)
      SELECT scan_id, commit_id, snap_time, idx, CASE WHEN hi - lo < 172800 THEN strftime(make_timestamp(snap_time * 1000000), '%H:%M') WHEN hi - lo < 6480000 THEN strftime(make_timestamp(snap_time * 1000000), '%m-%d') ELSE strftime(make_timestamp(snap_time * 1000000), '%Y-%m') END AS label FROM y WHERE newest OR (extra AND k <= want - chosen)""",
    "walk_outcome": f"""SELECT file_id, path, CASE WHEN {IN_SKIPPED} THEN 'SkippedDir' WHEN {BASE_NAME} IN ({", ".join(f"'{m}'" for m in T.MANIFESTS)}) OR regexp_matches({BASE_NAME}, '^tsconfig.*\\.json$') THEN 'Manifest'
      WHEN NOT regexp_matches(lower(path), '\\.(tsx?|[mc]ts|jsx?|[mc]js|rs|pyi?|go)$') THEN 'NoSource' WHEN NOT (path LIKE '%/%' OR path LIKE 's%') THEN 'NotIncluded' WHEN ends_with(path, '_pb2.py') OR path LIKE 'static/%' OR path LIKE 'tools/%' THEN 'Excluded'
      WHEN coalesce(bytes, octet_length(content), 0) > 4096 THEN 'TooLarge' WHEN regexp_matches(hex(content), '^([0-9A-F]{{2}})*?00') THEN 'Binary' ELSE 'Source' END AS outcome
      FROM (SELECT file_id, {PLAIN.format('rel_path')} AS path, bytes, content FROM source_files WHERE rel_path IS NOT NULL)""",
    "change_bursts": f"""WITH c AS (SELECT scan_id, walked_at, {PLAIN.format('rel_path')} AS path FROM source_files WHERE rel_path IS NOT NULL AND walked_at IS NOT NULL),
      k AS (SELECT * FROM c WHERE NOT ({IN_SKIPPED.replace("regexp_replace(path, '/?[^/]*$', '')", "path")}) AND NOT regexp_matches({BASE_NAME}, '~$|^\\.#|\\.tmp$') AND ({BASE_NAME} IN ({", ".join(f"'{m}'" for m in T.MANIFESTS)}) OR regexp_matches(lower({BASE_NAME}), '\\.(tsx?|[mc]ts|jsx?|[mc]js|rs|pyi?|go)$|^tsconfig.*\\.json$'))),
      s AS (SELECT *, CASE WHEN walked_at - lag(walked_at) OVER (PARTITION BY scan_id ORDER BY walked_at) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS turn FROM k),
      b AS (SELECT *, sum(turn) OVER (PARTITION BY scan_id ORDER BY walked_at ROWS UNBOUNDED PRECEDING) AS burst FROM s) SELECT scan_id, CAST(count(DISTINCT path) AS INT) AS paths, min(walked_at) AS started FROM b GROUP BY scan_id, burst""",
}
