"""The driver's contract, and that the core stands without the training-data subpackage."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_oracles_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert all(callable(q) for q in queries.values())


def test_core_imports_without_llm():
    script = "import sys; sys.modules['codestrata.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and not any(q.startswith('p2_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", script], cwd=ROOT, check=True)


def test_only_the_subpackage_imports_itself():
    for file in (ROOT / "codestrata").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "codestrata.llm" not in file.read_text(), file


def test_one_query_end_to_end(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists() or importlib.util.find_spec("duckdb") is None:
        return
    import duckdb

    duck = duckdb.connect()
    for table in ("snapshots", "snapshot_files", "commits"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name in ("p1_found", "module_edges", "cochange_pairs"):
        df = entry.queries()[name](spark, str(folder))
        rel = duck.sql(entry.oracle_sql()[name])
        order = sorted(df.columns)
        assert sorted(rel.columns) == order
        want = sorted(repr([r[rel.columns.index(c)] for c in order]) for r in rel.fetchall())
        assert sorted(repr([r[c] for c in order]) for r in df.collect()) == want
