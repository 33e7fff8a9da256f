"""Queries on snapshot deliveries."""

from __future__ import annotations

from codestrata.operators import snapshots as op
from codestrata.tables import table


def _two(spark, d):
    return table(spark, d, "snapshots"), table(spark, d, "snapshot_files")


def p1_found(spark, d):
    return op.snapshot_diff(*_two(spark, d))


def p1_grown(spark, d):
    return op.grown_files(*_two(spark, d))


PLAIN = r"regexp_replace(regexp_replace(replace({}, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"

#: Numbered complete snapshots and their rows, as DuckDB SQL.
ROWS_SQL = f"""
f AS (SELECT scan_id, commit_id, delivery_no, {PLAIN.format('path')} AS path, lower(blob) AS blob, bytes, loc, depends_on, read_at
      FROM snapshot_files WHERE path IS NOT NULL),
held AS (SELECT scan_id, commit_id, delivery_no, count(DISTINCT path) AS held FROM f GROUP BY ALL),
said AS (SELECT scan_id, commit_id, delivery_no, max(file_count) AS file_count, min(snap_time) AS snap_time FROM snapshots GROUP BY ALL),
whole AS (SELECT s.* FROM said s LEFT JOIN held h USING (scan_id, commit_id, delivery_no) WHERE coalesce(h.held, 0) = s.file_count),
latest AS (SELECT scan_id, commit_id, max(delivery_no) AS delivery_no, arg_max(snap_time, delivery_no) AS snap_time FROM whole GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY snap_time, commit_id) AS idx FROM latest),
r AS (SELECT scan_id, commit_id, idx, path, blob, bytes, loc, depends_on FROM f JOIN n USING (scan_id, commit_id, delivery_no)
      QUALIFY row_number() OVER (PARTITION BY scan_id, idx, path ORDER BY read_at DESC NULLS LAST, blob DESC NULLS LAST, bytes DESC NULLS LAST, loc DESC NULLS LAST) = 1)
"""

SQL = {
    "p1_found": f"""
WITH RECURSIVE {ROWS_SQL},
pairs AS (SELECT a.scan_id, a.commit_id, a.idx FROM n a WHERE a.idx > 1),
later AS (SELECT * FROM r WHERE idx > 1),
plain AS (
  SELECT l.scan_id, l.commit_id, l.path, CASE WHEN e.path IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM later l LEFT JOIN r e ON e.scan_id = l.scan_id AND e.idx = l.idx - 1 AND e.path = l.path
  WHERE e.path IS NULL OR e.blob IS DISTINCT FROM l.blob
  UNION ALL
  SELECT p.scan_id, p.commit_id, e.path, 'removed' FROM r e JOIN pairs p ON p.scan_id = e.scan_id AND p.idx = e.idx + 1
  WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.scan_id = e.scan_id AND x.idx = p.idx AND x.path = e.path)),
edge AS (SELECT DISTINCT scan_id, idx, path AS a, d AS b FROM (SELECT scan_id, idx, path, unnest(depends_on) AS d FROM r) WHERE d IS NOT NULL AND d <> path),
reach(scan_id, idx, a, b) AS (
  SELECT * FROM edge
  UNION
  SELECT reach.scan_id, reach.idx, reach.a, e.b FROM reach JOIN edge e ON e.scan_id = reach.scan_id AND e.idx = reach.idx AND e.a = reach.b),
grp AS (SELECT x.scan_id, x.idx, x.a AS path, list_sort(list(DISTINCT x.b)) AS members
        FROM reach x JOIN reach y ON x.scan_id = y.scan_id AND x.idx = y.idx AND x.a = y.b AND x.b = y.a GROUP BY ALL),
cyc AS (SELECT g.scan_id, p.commit_id, g.path, 'cycle' AS change FROM grp g JOIN pairs p USING (scan_id, idx)
        WHERE len(g.members) > 1
          AND NOT EXISTS (SELECT 1 FROM grp o WHERE o.scan_id = g.scan_id AND o.idx = g.idx - 1 AND o.path = g.path AND o.members = g.members))
SELECT scan_id, commit_id, path, change FROM plain UNION ALL SELECT * FROM cyc
""",
    "p1_grown": f"""
WITH {ROWS_SQL}
SELECT l.scan_id, l.commit_id, l.path, CAST(l.loc - e.loc AS BIGINT) AS delta
FROM r l JOIN r e ON e.scan_id = l.scan_id AND e.idx = l.idx - 1 AND e.path = l.path WHERE l.loc <> e.loc
""",
}
QUERIES = {"p1_found": p1_found, "p1_grown": p1_grown}
