"""p1 and its parts on small fixtures."""

import datetime as dt

import pytest

from codestrata.operators import snapshots as op
from codestrata.operators.cycles import components_of, cycle_groups

FILES = "scan_id long, repo string, commit_id string, delivery_no int, path string, blob string, bytes long, loc int, depends_on array<string>, read_at timestamp, extra int"
SNAPS = "scan_id long, repo string, commit_id string, snap_time long, label string, file_count int, total_loc long, edge_count int, delivery_no int, delivered_at timestamp, path string"
T0 = dt.datetime(2024, 1, 1)


def snap(scan, commit, time, count, delivery=1):
    return (scan, "r", commit, time, None, count, None, None, delivery, T0, "clash")


def row(scan, commit, path, blob, deps=None, delivery=1, loc=10, at=T0):
    return (scan, "r", commit, delivery, path, blob, 1, loc, deps, at, 0)


def diff(spark, snaps, rows):
    out = op.snapshot_diff(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(rows, FILES)).collect()
    return sorted((r.scan_id, r.commit_id, r.path, r.change) for r in out)


def test_added_removed_changed_and_readded(spark):
    snaps = [snap(1, "c1", 1, 2), snap(1, "c2", 2, 2), snap(1, "c3", 3, 2)]
    rows = [row(1, "c1", "a", "aa"), row(1, "c1", "b", "bb"), row(1, "c2", "a", "AA"), row(1, "c2", "c", "cc"), row(1, "c3", "./b", "bb"), row(1, "c3", "a", "zz")]
    assert diff(spark, snaps, rows) == [(1, "c2", "b", "removed"), (1, "c2", "c", "added"), (1, "c3", "a", "changed"), (1, "c3", "b", "added"), (1, "c3", "c", "removed")]


def test_latest_complete_delivery_counts_and_incomplete_snapshots_are_left_out(spark):
    snaps = [snap(1, "c1", 1, 1, 1), snap(1, "c1", 1, 1, 2), snap(1, "c2", 2, 2), snap(1, "c3", 3, 1), snap(1, "c3", 3, 1)]
    rows = [row(1, "c1", "a", "old", delivery=1), row(1, "c1", "a", "new", delivery=2), row(1, "c2", "a", "x"), row(1, "c3", "a", "old"), row(1, "c3", ".\\a", "old"), row(1, "c3", None, "q")]
    assert diff(spark, snaps, rows) == [(1, "c3", "a", "changed")]


def test_new_cycles_by_members(spark):
    snaps = [snap(1, c, i, 3) for i, c in enumerate(("c1", "c2", "c3"))]
    two, three = {"a": ["b"], "b": ["a"], "c": None}, {"a": ["b"], "b": ["c"], "c": ["a", "gone", None]}
    rows = [row(1, c, p, p, d) for c, g in (("c1", two), ("c2", two), ("c3", three)) for p, d in g.items()]
    assert diff(spark, snaps, rows) == [(1, "c3", p, "cycle") for p in "abc"]


def test_nulls_and_empty_tables(spark):
    snaps = [snap(1, "c1", 1, None), snap(2, "d1", 1, 1), snap(2, "d2", 2, 1), snap(None, None, None, None)]
    rows = [row(2, "d1", "a", None), row(2, "d2", "a", "x"), (None,) * 11]
    assert diff(spark, snaps, rows) == [(2, "d2", "a", "changed")]
    assert diff(spark, [], []) == []


def test_grown(spark):
    snaps = [snap(1, "c1", 1, 2), snap(1, "c2", 2, 2)]
    rows = [row(1, "c1", "a", "a", loc=10), row(1, "c1", "b", "b", loc=None), row(1, "c2", "a", "a", loc=4), row(1, "c2", "b", "b", loc=5)]
    out = op.grown_files(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(rows, FILES)).collect()
    assert [(r.path, r.delta) for r in out] == [("a", -6)]


GRAPHS = {
    "two": ([("0", "1"), ("1", "0")], [["0", "1"]]),
    "tail": ([("0", "1"), ("1", "0"), ("2", "0"), ("3", "2")], [["0", "1"]]),
    "pair of cycles": ([("0", "1"), ("1", "0"), ("2", "3"), ("3", "2"), ("1", "2")], [["0", "1"], ["2", "3"]]),
    "six": ([("0", "1"), ("1", "0"), ("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("5", "1")], [list("012345")]),
    "chain": ([("0", "1"), ("1", "2"), ("0", "0")], []),
}


@pytest.mark.parametrize("task_edges", [100, 0])
def test_cycle_groups_in_task_and_distributed_agree(spark, task_edges):
    edges = [(name, a, b) for name, (pairs, _) in GRAPHS.items() for a, b in pairs] + [("two", None, "1"), ("two", "0", "1")]
    got = {}
    for r in cycle_groups(spark.createDataFrame(edges, "graph string, src string, dst string"), task_edges).collect():
        got.setdefault((r.graph, r.component), []).append(r.node)
    want = {(name, m[0]): m for name, (_, groups) in GRAPHS.items() for m in groups}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_long_chain_and_ring():
    n = 20_000
    assert components_of([str(i) for i in range(n)], [str(i + 1) for i in range(n)]) == []
    ring = components_of([str(i) for i in range(n)], [str((i + 1) % n) for i in range(n)])
    assert [len(r) for r in ring] == [n]
