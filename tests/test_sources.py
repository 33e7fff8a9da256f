"""Trees, version control, settings, the content cache and change streams."""

import datetime as dt
import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.operators.findings import Layer
from codestrata.sources import git, settings, tree
from codestrata.streaming import changes


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=Ada", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    run("init", "-b", "main")
    for i in range(3):
        (root / "hot.ts").write_text(f"export const x = {i};\n")
        if i == 0:
            (root / "cold.ts").write_text("1\n")
        run("add", "-A")
        run("commit", "-m", f"c{i}")
    run("checkout", "-b", "side")
    (root / "side.txt").write_text("s")
    run("add", "-A")
    run("commit", "-m", "side")
    run("checkout", "main")
    run("merge", "--no-ff", "side", "-m", "merge")
    return root


def test_history_of_a_repository(spark, repo):
    rows = git.commits(spark, str(repo)).collect()
    touched = [f for r in rows for f in r.files]
    assert (touched.count("hot.ts"), touched.count("cold.ts"), touched.count("side.txt")) == (3, 1, 2)
    assert git.commits(spark, str(repo), max_commits=2).count() == 2
    assert {(r.path, bytes(r.content)) for r in git.files_at(spark, str(repo), "HEAD~1", lambda p: p.endswith(".ts")).collect()} == {("hot.ts", b"export const x = 2;\n"), ("cold.ts", b"1\n")}
    assert [(r.name, r.current) for r in git.branches(spark, str(repo)).collect()] == [("main", True), ("side", False)]
    info = git.repo_info(spark, str(repo)).collect()[0]
    assert info.branch == "main" and len(info.head) == 7 and info.is_git and not info.has_config


def test_tree(spark, repo, tmp_path):
    (repo / ".gitignore").write_text("gen/\n")
    for path, data in {"gen/x.ts": b"1", "src/__init__.py": b"", "src/b.ts": b"\0\1", "src/big.js": b"x" * 50, "src/a.test.ts": b"2", "package.json": b"{}", "node_modules/m/i.js": b"3"}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_bytes(data)
    out = {r.path: (r.outcome, r.content is not None) for r in tree.scan_tree(spark, str(repo), exclude=["**/*.test.ts"], cap=40).collect()}
    assert out == {"hot.ts": ("Source", True), "cold.ts": ("Source", True), "side.txt": ("NoSource", False), "src/__init__.py": ("Source", True), "src/b.ts": ("Binary", False), "src/big.js": ("TooLarge", False), "src/a.test.ts": ("Excluded", False), "package.json": ("Manifest", True), ".gitignore": ("NoSource", False)}
    plain = tmp_path / "plain"
    (plain / "dist").mkdir(parents=True)
    (plain / "a.py").write_text("x")
    (plain / "dist/b.py").write_text("x")
    assert [r.path for r in tree.scan_tree(spark, str(plain)).collect()] == ["a.py"]


def test_cache_parses_each_content_once(spark, tmp_path):
    seen = []

    def parse(misses):
        seen.append(misses.count())
        return misses.select("hash", F.length("content").alias("n"))

    files = spark.createDataFrame([(b"a",), (b"bb",), (b"a",), (None,)], "content binary")
    folder = str(tmp_path / "cache")
    assert sorted(r.n for r in tree.content_cache(files, folder, 2, parse).collect()) == [1, 2]
    more = files.unionByName(spark.createDataFrame([(b"ccc",)], "content binary"))
    assert sorted(r.n for r in tree.content_cache(more, folder, 2, parse).collect()) == [1, 2, 3] and seen == [2, 1]
    with pytest.raises(ValueError, match="newer"):
        tree.content_cache(files, folder, 1, parse)


def test_settings_and_baseline(spark, tmp_path):
    path = str(tmp_path / "s.toml")
    assert settings.load_settings(path) == settings.Settings()
    wanted = settings.Settings(["src/**"], [], ["a.ts"], [Layer("ui", ("ui/**",)), Layer("db", ("db/**",))], ["ui -> db", "ui -> x"])
    settings.save_settings(path, wanted)
    assert settings.load_settings(path) == wanted and wanted.invalid_rules() == ["ui -> x"]
    (tmp_path / "bad.toml").write_text("colour = 1\n")
    with pytest.raises(ValueError, match="colour"):
        settings.load_settings(str(tmp_path / "bad.toml"))
    base = spark.createDataFrame([(1, "b", "k", "Low", "h", ["p"], None), (1, "a", "k", "Low", "h2", [], "n")], settings.BASELINE_SCHEMA)
    file = str(tmp_path / "b.json")
    assert settings.load_baseline(spark, file) is None
    settings.save_baseline(file, base)
    assert [tuple(r) for r in settings.load_baseline(spark, file).collect()] == sorted((tuple(r) for r in base.collect()), key=lambda r: r[1])


def test_bursts_in_batch_and_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "a.ts"), (1, t + dt.timedelta(milliseconds=300), "./b.ts"), (1, t + dt.timedelta(milliseconds=500), "a.ts"), (1, t + dt.timedelta(milliseconds=100), "x.tmp"), (1, t + dt.timedelta(milliseconds=200), "node_modules/q.js"), (1, t + dt.timedelta(seconds=5), "c.py"), (1, None, "d.py"), (1, t + dt.timedelta(hours=1), "z.go")]
    df = spark.createDataFrame(rows, "k int, at timestamp, path string")
    batch = sorted(r.paths for r in changes.bursts(df, "k", "at", "path").collect())
    assert batch == [["a.ts", "b.ts"], ["c.py"], ["z.go"]]
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = changes.bursts(stream, "k", "at", "path").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.paths for r in spark.table("bursts").collect()) == batch[:2]  # the last burst is still open
    met = []
    changes.on_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "path", lambda b, n: met.extend(r.path for r in b.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(met) == ["a.ts", "b.ts", "c.py", "d.py", "z.go"]
    assert changes.windowed_counts(df, "k", "at").collect()[0].changes == 7
