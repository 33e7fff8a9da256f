"""Graph, history, findings, timeline, imports and export operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths as P
from codestrata.functions import text as T
from codestrata.functions.globs import glob_regex
from codestrata.operators import export, findings, graph, history, imports, resolve, timeline, tour, tree
from codestrata.operators.cycles import cycle_groups
from codestrata.operators.running import running


def files(spark, *rows):
    return spark.createDataFrame([(1, p, p.rpartition("/")[0], loc, None) for p, loc in rows], "scan_id long, path string, module string, loc int, depends_on array<string>")


def edges(spark, *pairs):
    return spark.createDataFrame([(1, a, b) for a, b in pairs], "scan_id long, src string, dst string")


def groups_of(es):
    return cycle_groups(es.select(F.col("scan_id").alias("graph"), "src", "dst")).withColumnRenamed("graph", "scan_id")


def paths_of(df):
    return sorted(r.path for r in df.collect())


def test_degrees_module_edges_and_orphans(spark):
    fs, es = files(spark, ("m/0.ts", 1), ("m/1.ts", 1), ("n/2.ts", 1)), edges(spark, ("m/0.ts", "m/1.ts"), ("m/0.ts", "n/2.ts"), ("m/1.ts", "n/2.ts"))
    got = {r.path: (r.fan_in, r.fan_out) for r in graph.degrees(fs, es).collect()}
    assert got == {"m/0.ts": (0, 2), "m/1.ts": (1, 1), "n/2.ts": (2, 0)}
    assert [(r.src_module, r.dst_module, r.edges) for r in graph.module_edges(es, fs).collect()] == [("m", "n", 2)]
    assert paths_of(graph.orphans(fs, es, fs.limit(0))) == ["m/0.ts"]
    assert paths_of(graph.orphans(fs, es, fs.where("path = 'm/0.ts'"))) == []


def test_impact_and_reach_end_on_cycles(spark):
    es = edges(spark, ("0", "1"), ("1", "0"), ("2", "0"), ("3", "2"))
    assert paths_of(graph.impact(es, es.select("scan_id", F.lit("0").alias("path")))) == ["1", "2", "3"]
    seeds = spark.createDataFrame([(1, "3"), (1, "0")], "scan_id long, seed string")
    assert sorted((r.seed, r.path) for r in graph.reach(es, seeds).collect()) == [("0", "1"), ("3", "0"), ("3", "1"), ("3", "2")]
    assert graph.impact(es.limit(0), es.select("scan_id", F.lit("0").alias("path"))).count() == 0


def test_shortest_cycles_and_levels(spark):
    es = edges(spark, ("0", "1"), ("1", "0"), ("1", "2"), ("2", "3"), ("3", "1"), ("7", "8"), ("8", "9"), ("9", "7"), ("5", "0"))
    groups = groups_of(es)
    assert sorted(r.chain for r in graph.shortest_cycles(es, groups).collect()) == [["0", "1", "0"], ["7", "8", "9", "7"]]
    fs = files(spark, *[(p, 1) for p in "01235789"])
    levels = {r.path: r.level for r in graph.levels(fs, es, groups).collect()}
    assert levels == {"0": 0, "1": 0, "2": 0, "3": 0, "7": 0, "8": 0, "9": 0, "5": 1}
    assert graph.back_edges(graph.ordered(graph.levels(fs, es, groups)), es).where("src = '5'").count() == 0


COMMITS = "id string, scan_id long, commit_time long, author string, files array<string>, ingested_at timestamp"


def commits(spark, *rows):
    return spark.createDataFrame([(f"c{i}", 1, i, a, fs, dt.datetime(2024, 1, 1)) for i, (a, fs) in enumerate(rows)], COMMITS)


def test_history_and_coupling(spark):
    clean = history.clean_commits(commits(spark, *[("Ada", ["hot", "./hot"])] * 3, ("Grace", ["hot", None]), (None, []), ("B", None)))
    (row,) = history.file_history(clean).collect()
    assert (row.path, row.commits, row.authors, row.top_author, row.top_author_share) == ("hot", 4, 2, "Ada", 0.75)
    assert history.repo_history(clean).collect()[0].total_commits == 6
    pairs = lambda rows, **k: [(r.a, r.b, r.together, round(r.confidence, 6)) for r in history.cochange(history.clean_commits(commits(spark, *rows)), **k).collect()]
    assert pairs([("x", ["z", "a"])] * 4, min_support=2) == [("a", "z", 4, 1.0)]
    assert pairs([("x", ["a", "b"])] * 2 + [("x", ["b"])] * 8, min_support=2) == [("a", "b", 2, 1.0)]
    assert pairs([("x", ["a", "b"])]) == []
    wide = [("x", [f"f{i}" for i in range(200)])] * 6
    assert pairs(wide) == [] and pairs(wide + [("x", ["a", "b"])] * 5) == [("a", "b", 5, 1.0)]
    assert len(pairs([("x", [f"p{i}", f"q{i}"]) for i in range(15)] * 3, min_support=3, limit=10)) == 10


def test_percentile_is_the_share_below(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, 4)], "scan_id long, v int")
    assert sorted((r.v, round(r.p, 6)) for r in history.percentile(df, "v", "p").collect()) == [(1, 0.0), (2, 0.2), (3, 0.4), (4, 0.6), (4, 0.6)]


def test_running_sums_and_minima(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(5)
    sums = {(r.g, r.k): r.s for r in running(df, ["g"], [F.col("k")], "v", "s").collect()}
    lows = {(r.g, r.k): r.s for r in running(df, ["g"], [F.desc("k")], "v", "s", how="min").collect()}
    for g, k, _ in rows:
        assert sums[g, k] == sum(v for h, j, v in rows if h == g and j <= k)
        assert lows[g, k] == min(v for h, j, v in rows if h == g and j >= k)


def test_findings(spark):
    fs = files(spark, ("lib/god.ts", 600), *[(f"u/{i}.ts", 20 + i) for i in range(12)], ("src/x.test.ts", 5))
    es = edges(spark, *[(f"u/{i}.ts", "lib/god.ts") for i in range(12)])
    past = spark.createDataFrame([(1, "lib/god.ts", 90, 1, "Ada")] + [(1, f"u/{i}.ts", 1, 1, "Grace") for i in range(12)], "scan_id long, path string, commits long, authors long, top_author string")
    fan = graph.degrees(fs, es)
    (god,) = findings.god_files(fs, fan, past).collect()
    assert god.headline == "lib/god.ts is 600 lines with 12 dependents" and god.severity in ("Medium", "High", "Critical")
    assert [r.headline for r in findings.bus_factors(fs, fan, past).collect()] == ["lib/god.ts has 12 dependents and one author (Ada)"]
    assert findings.bus_factors(fs, fan, past.withColumn("top_author", F.lit("Ada"))).count() == 0
    assert len(findings.unstable_interfaces(fs, fan, past).collect()) == 1
    dead = findings.orphan_files(fs, graph.orphans(fs, es, fs.limit(0)))
    assert "src/x.test.ts" not in {p for r in dead.collect() for p in r.paths} and dead.count() == 12
    pairs = spark.createDataFrame([(1, "lib/god.ts", "u/1.ts", 9, 0.9), (1, "u/1.ts", "u/2.ts", 9, 0.9), (1, "src/x.test.ts", "u/1.ts", 14, 0.93)], "scan_id long, a string, b string, together long, confidence float")
    assert [r.headline for r in findings.distant_couplings(fs, es, pairs).collect()] == ["src/x.test.ts and u/1.ts change together 93% of the time but are unrelated in code"]
    layers = [findings.Layer("u", ("u/**",)), findings.Layer("lib", ("lib/**",))]
    assert findings.layering_violations(es, layers, ["u -> lib"]).count() == 0 and findings.layering_violations(es, layers, ["u -> x", "bad"]).count() == 12
    assert findings.parse_rules(["u -> lib", "x", "u -> y"], layers) == ([("u", "lib")], ["x", "u -> y"])
    every = findings.combine([dead, findings.god_files(fs, fan, past)])
    assert findings.capped(every, 5).where("kind = 'Orphan'").count() == 5
    assert not findings.gate(every, fail_on="Medium") and findings.gate(every, fail_on_cycle=True)
    moved = every.withColumn("headline", F.regexp_replace("headline", "600", "777"))
    assert findings.with_ids(every).select("id").exceptAll(findings.with_ids(moved).select("id")).count() == 0
    base = findings.accept(every, below="Medium", note="later")
    states = {r.state: r["count"] for r in findings.compare_baseline(findings.with_ids(every.where("kind <> 'Orphan' or headline like 'u/1%'")), base).groupBy("state").count().collect()}
    assert states == {"fresh": 1, "accepted": 3, "fixed": 9}
    assert findings.prune(base, every.where("headline like 'u/1%'")).count() == 3 and findings.drop_entries(base, "U/1.").count() == 11
    assert findings.counts(every, base).collect()[0].n == 1
    assert {r.path: r.heat for r in findings.heat(fs, every).collect()}["src/x.test.ts"] == 0.0


def test_cycle_finding_and_case_mismatch(spark):
    es = edges(spark, *[(f"{i}", f"{(i + 1) % 8}") for i in range(8)])
    groups = groups_of(es)
    (f,) = findings.cycles(groups, graph.shortest_cycles(es, groups)).collect()
    assert f.severity == "High" and round(f.score, 4) == 0.8 and f.headline.startswith("Cycle across 8 files: 0 → 1")
    rows = spark.createDataFrame([(1, "a.ts", ["B.ts", "gone"]), (1, "b.ts", None)], "scan_id long, path string, depends_on array<string>")
    assert [r.headline for r in findings.case_mismatches(rows).collect()] == ['a.ts imports "B.ts" but the file is b.ts']
    assert [(r.src, r.dst) for r in tree.missing_targets(rows).collect() if r.dst == "gone"] == [("a.ts", "gone")]


def test_compare_and_timeline(spark):
    base = files(spark, ("kept", 100), ("gone", 20), ("grew", 10), ("shrank", 90))
    head = files(spark, ("kept", 100), ("new", 5), ("grew", 60), ("shrank", 40))
    got = {r.path: (r.change, r.delta) for r in timeline.compare_refs(base, head).collect()}
    assert got == {"gone": ("removed", None), "new": ("added", None), "grew": ("grown", 50), "shrank": ("shrunk", -50)}
    changes = timeline.cycle_changes(edges(spark, ("a", "b"), ("b", "a")), edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"))).collect()
    assert [(r.component, r.change) for r in changes] == [("c", "introduced")]
    snaps = spark.createDataFrame([(1, f"s{i}", i * 86_400 * 40, i + 1) for i in range(20)] + [(2, "t", 5, 1)], "scan_id long, commit_id string, snap_time long, idx int")
    kept = timeline.sampled(snaps, 6).collect()
    assert len([r for r in kept if r.scan_id == 1]) == 6 and {r.label for r in kept if r.scan_id == 2} == {"00:00"}
    asks = spark.createDataFrame([(1, 5, "x"), (1, 0, "y"), (2, 9, "z")], "g int, at int, name string")
    marks = spark.createDataFrame([(1, 1, 10), (1, 5, 11), (1, 5, 12), (1, 6, 13)], "g int, at int, v int")
    assert sorted((r.name, r.v) for r in timeline.as_of(asks, marks, "g", "at", "v").collect() if r.v) == [("x", 12)]


def test_lines_of_code_equal_the_rule(spark):
    def rule(language, text):
        mark, block, n = "#" if language == "Python" else "//", False, 0
        for line in text.split("\n"):
            t = line.strip()
            if block:
                block = "*/" not in t
            elif t.startswith("/*"):
                block = "*/" not in t
            elif t and not t.startswith(mark):
                n += 1
        return n

    rng = random.Random(7)
    rows = [(rng.choice(["Python", "Go"]), "\n".join("".join(rng.choices(["/*", "*/", "//", "#", "x", " ", "\t", "*"], k=rng.randint(0, 4))) for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    rows += [("Go", "/*" + "x\n" * 50_000), ("Go", ""), (None, "a\n\nb")]
    df = spark.createDataFrame(rows, "l string, t string")
    for r in df.select("l", "t", T.loc(F.col("t"), F.col("l")).alias("n"), T.total_lines(F.col("t")).alias("k")).collect():
        assert r.n == rule(r.l, r.t) and r.k == len(r.t.split("\n")) - (r.t.endswith("\n") or r.t == "")


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**", "src/a/b.ts", "lib/a.ts"), ("**/*.test.ts", "a.test.ts", "a.ts"), ("*.ts", "a/b.ts", "a.js"), ("a?[bc].{js,ts}", "axb.ts", "axd.ts"), ("[!a]x", "bx", "ax")])
def test_globs(glob, yes, no):
    import re

    assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no)


def test_path_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    assert one(P.plain_path(F.lit(".\\a//b"))) == "a/b" and one(P.plain_path(F.lit("././x"))) == "x" and one(P.plain_path(F.lit(None).cast("string"))) is None
    assert one(P.join_relative(F.lit("a/b"), F.lit("../../../c/./d"))) == "c/d"
    assert one(P.path_prefixes(F.lit("a/b/c.ts"))) == ["", "a", "a/b"] and one(P.lead_dirs(F.lit("x.ts"))) is None and one(P.lead_dirs(F.lit("a/b/c/x.ts"))) == "a/b"
    assert one(T.package_name(F.lit("@a/b/c"))) == "@a/b" and one(T.diagram_ident(F.lit("9a/b"))) == "n9a_b" and one(T.is_asset(F.lit("x.svg?raw"))) and not one(T.windows_safe(F.lit("con.txt")))


SRC = "file_id long, scan_id long, rel_path string, content binary"


def test_imports_definitions_calls_and_resolution(spark):
    sources = {
        "src/a.ts": "// import './no'\nimport { x, y as z } from './b';\nimport type { T } from '../lib/c'\nexport * from './D';\nconst s = \"import q from './s'\";\nconst m = await import('./b');\nimport React from 'react';\nexport function run() { helper(1) }\n",
        "src/b.ts": "export const x = 1\nexport function helper(n) {\n  return run2(n)\n}\n", "lib/c/index.ts": "", "src/d.ts": "", "pk/m.py": "from .n import thing\nimport os, sys as s\n# import no\ndef f():\n    pass\n", "pk/n.py": "class _C: pass\n",
        "go/main.go": 'package a\nimport (\n\t"fmt"\n\t"store"\n)\nfunc Main() {}\n', "store/s.go": "package store\n", "store/a_test.go": "package store\n", "src/lib.rs": "mod auth;\npub use crate::auth::{A, B};\nuse std::io;\nfn g() {}\n", "src/auth.rs": "pub struct A;\n"}
    raw = spark.createDataFrame([(i, 1, p, t.encode()) for i, (p, t) in enumerate(sources.items())] + [(99, 1, None, b"x"), (98, 1, "q.py", None)], SRC)
    src = imports.sources(raw)
    said = imports.import_statements(src)
    by_path = {}
    for r in said.collect():
        by_path.setdefault(r.path, []).append((r.kind, r.specifier))
    assert sorted(by_path["src/a.ts"]) == [("dynamic", "./b"), ("reExport", "./D"), ("static", "./b"), ("static", "react"), ("type", "../lib/c")]
    assert sorted(by_path["pk/m.py"]) == [("static", ".n"), ("static", "os"), ("static", "sys")] and sorted(by_path["go/main.go"]) == [("static", "fmt"), ("static", "store")]
    paths = raw.where("rel_path is not null").select("scan_id", F.col("rel_path").alias("path"))
    texts = paths.limit(0).withColumn("content", F.lit(""))
    out = {(list(sources)[r.file_id], r.specifier): (r.outcome, r.target) for r in resolve.resolve(said, paths, resolve.project_of(texts, paths, said)).collect()}
    assert out["src/a.ts", "./b"] == ("Resolved", "src/b.ts") and out["src/a.ts", "../lib/c"] == ("Resolved", "lib/c/index.ts") and out["src/a.ts", "./D"] == ("CaseMismatch", "src/d.ts") and out["src/a.ts", "react"] == ("External", "react")
    assert out["pk/m.py", ".n"] == ("Resolved", "pk/n.py") and out["pk/m.py", "os"] == ("External", "os") and out["go/main.go", "store"] == ("External", "store") and out["src/lib.rs", "crate::auth::A"] == ("FileNotInModuleTree", None) and out["src/lib.rs", "auth"] == ("Resolved", "src/auth.rs")
    lines = imports.code_lines(src)
    named = {(r.name, r.exported) for r in imports.definitions(lines).collect()}
    assert {("run", True), ("helper", True), ("f", True), ("_C", False), ("Main", True), ("A", True), ("g", False)} <= named
    assert [(r.owner, r.target) for r in imports.symbol_edges(lines).collect()] == [("run", "helper")]
    long = spark.createDataFrame([(1, 1, "a.js", ('x = "' + "\\\"a" * 200_000 + '";\n/*' + "*" * 100_000 + "*/\nimport './z'\n").encode())], SRC)
    assert [r.specifier for r in imports.import_statements(imports.sources(long)).collect()] == ["./z"]


def test_exports_and_tour(spark):
    fs, es = files(spark, ("m/main.ts", 30), ("m/b.ts", 40), ("n/c.ts", 50), ("n/d.ts", 26)), edges(spark, ("m/main.ts", "m/b.ts"), ("m/b.ts", "n/c.ts"), ("n/d.ts", "n/c.ts"), ("n/c.ts", "n/d.ts"))
    groups = groups_of(es)
    parts = export.diagram_parts(fs, es, groups)
    text = [r.line for r in export.d2(*parts).orderBy("line_no").collect()]
    assert text[0] == "direction: right" and 'm: "m"' in text and "m -> n" in text
    assert [r.line for r in export.mermaid(*export.diagram_parts(fs, es, groups, max_nodes=1)).orderBy("line_no").collect()][-1] == "  %% 1 more nodes omitted"
    past = spark.createDataFrame([(1, "n/c.ts", 9, 1, "Ada", 0.5)], "scan_id long, path string, commits long, authors long, top_author string, top_author_share float")
    found = findings.combine([findings.orphan_files(fs, graph.orphans(fs, es, fs.limit(0)))])
    lines = [r.line for r in export.report(fs, es, past, found, tree.missing_targets(fs)).orderBy("line_no").collect()]
    assert lines[0] == "# Scan 1" and "| Files | 4 |" in lines and "| `n/c.ts` | 9 | 1 | Ada (50%) |" in lines
    stops = [r.path for r in tour.tour(fs, es, fs.where("path = 'm/main.ts'").select("scan_id", "path"), past).orderBy("stop").collect()]
    assert stops[:2] == ["m/main.ts", "n/c.ts"]
    links = tour.workspace_links(spark.createDataFrame([(2, "app.ts", "@acme/ui"), (2, "app.ts", "x")], "scan_id long, src string, package string"), spark.createDataFrame([(1, "@acme/ui"), (1, "x"), (3, "x")], "scan_id long, package string"), fs, es)
    assert [(r.src, r.dst) for r in links.collect()] == [("app.ts", "n/c.ts")]
    aliases = spark.createDataFrame([(1, "tsconfig.json", "@/*", 0, "@/", "", True, ["m/*"]), (1, "tsconfig.json", "~/*", 1, "~/", "", True, ["gone/*"]), (1, "tsconfig.json", "#b", 2, "#b", "", False, ["m/b.ts"])], "scan_id long, source string, pattern string, pos int, prefix string, suffix string, wild boolean, targets array<string>")
    audit = tour.alias_audit(aliases, spark.createDataFrame([(1, "@/b"), (1, "@/b"), (1, "#bc")], "scan_id long, specifier string"), fs)
    assert {(r.pattern, r.used_by, r.resolves) for r in audit.collect()} == {("@/*", 1, True), ("~/*", 0, False), ("#b", 0, True)}
    assert {(r.headline, r.severity) for r in findings.path_aliases(audit).collect()} == {('tsconfig.json maps "~/*" to gone/*, which does not exist', "High"), ('tsconfig.json declares "#b" and nothing imports through it', "Info")}
    said = spark.createDataFrame([(1, "a.ts", 3, "tsserver", "./x", "b.ts"), (1, "a.ts", 4, "tsserver", "./y", None)], "scan_id long, src string, line int, server string, specifier string, dst string")
    assert [(r.headline, r.paths) for r in findings.resolver_disagreements(said).collect()] == [('a.ts:3 — tsserver resolves "./x" to b.ts', ["a.ts", "b.ts"])]
    assert not findings.gate(found, unresolved=fs, max_unresolved=3) and findings.gate(found, unresolved=fs, max_unresolved=4)
    fixed, odd = tour.repair(spark.createDataFrame([(1, "a", "./x")], "scan_id long, src string, specifier string"), es, spark.createDataFrame([(1, "a", "./x", "b"), (1, "a", "./y", "c"), (1, "a", "./z", "a")], "scan_id long, src string, specifier string, dst string"))
    assert [r.dst for r in fixed.collect()] == ["b"] and [r.dst for r in odd.collect()] == ["c"]


def test_module_bands_are_runs(spark):
    rng = random.Random(3)
    names = [f"{rng.choice('ab')}/{i:03}" for i in range(60)]
    fs = files(spark, *[(n, 1) for n in names])
    order = spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "scan_id long, path string, position long")
    want, last = [], None
    for i, n in enumerate(names):
        if n[0] == last:
            want[-1][2] += 1
        else:
            want.append([n[0], i, 1])
        last = n[0]
    assert sorted([r.module, r.start, r.length] for r in graph.module_bands(order, fs).collect()) == sorted(want)


LONG = "scan_id long, src string, dst string"


def test_long_chain_and_large_ring(spark):
    chain = spark.range(60_000).selectExpr("1L AS scan_id", "lpad(id, 6, '0') AS src", "lpad(id + 1, 6, '0') AS dst")
    ring = spark.range(10_000).selectExpr("2L AS scan_id", "lpad(id, 6, '0') AS src", "lpad((id + 1) % 10000, 6, '0') AS dst")
    es = chain.unionByName(ring)
    seeds = spark.createDataFrame([(1, "059990"), (2, "000005")], "scan_id long, path string")
    assert dict(graph.impact(es, seeds).groupBy("scan_id").count().collect()) == {1: 59_990, 2: 9_999}
    fs = es.selectExpr("scan_id", "src AS path").union(es.selectExpr("scan_id", "dst")).distinct()
    groups = groups_of(es)
    assert groups.groupBy("scan_id", "component").count().collect() == [(2, "000000", 10_000)]
    top = graph.levels(fs, es, groups).groupBy("scan_id").agg(F.max("level").alias("top")).collect()
    assert {r.scan_id: r.top for r in top} == {1: 60_000, 2: 0}
    assert [len(r.chain) for r in graph.shortest_cycles(es, groups).collect()] == [10_001]


def test_graphs_too_large_for_a_task_agree(spark):
    rng = random.Random(4)
    rows = [(s, f"{rng.randrange(30):02}", f"{rng.randrange(30):02}") for s in (1, 2) for _ in range(45)]
    es = spark.createDataFrame([r for r in set(rows) if r[1] != r[2]], LONG)
    fs = es.selectExpr("scan_id", "src AS path").union(es.selectExpr("scan_id", "dst")).distinct()
    groups = groups_of(es)
    seeds = fs.selectExpr("scan_id", "path AS seed").where("seed < '05'")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    for both in (lambda n: graph.reach(es, seeds, task_edges=n), lambda n: graph.impact(es, seeds.selectExpr("scan_id", "seed AS path"), task_edges=n), lambda n: graph.levels(fs, es, groups, task_edges=n).select("scan_id", "path", "level"), lambda n: graph.shortest_cycles(es, groups, task_edges=n).select("scan_id", "component", "chain")):
        assert rows_of(both(0)) == rows_of(both(1000))


def test_file_lookup_broadcasts_no_tails(spark):
    from codestrata.operators import details
    from codestrata.session import stage

    fs = stage(files(spark, ("a/x.ts", 1), ("b/x.ts", 1), ("c/x.ts", 1), ("y.ts", 1), ("a/y.ts", 1), ("b/z.ts", 1)))
    asked = spark.createDataFrame([(1, a) for a in ("x.ts", "y.ts", "z.ts", "b/x.ts", "none.ts", "x.ts")] + [(None, "x.ts")], "scan_id long, asked string")
    found = details.find_files(fs, asked)
    assert {(r.scan_id, r.asked): (r.path, r.hits, r.also) for r in found.collect()} == {
        (1, "x.ts"): ("a/x.ts", 3, "b/x.ts"), (1, "y.ts"): ("y.ts", 1, None), (1, "z.ts"): ("b/z.ts", 1, None), (1, "b/x.ts"): ("b/x.ts", 1, None), (1, "none.ts"): (None, 0, None), (None, "x.ts"): (None, 0, None)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
