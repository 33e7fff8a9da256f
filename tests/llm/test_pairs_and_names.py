"""p3 and p4 against brute force and small fixtures."""

import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np

from codestrata.llm import cooccurrence as co
from codestrata.llm import names

COMMITS = "id string, scan_id long, repo string, commit_time long, author string, files array<string>, ingested_at timestamp, space string, n int"
T0 = dt.datetime(2024, 1, 1)


def commit(i, scan, files, author="A", at=0):
    return (i, scan, "r", 1, author, files, T0 + dt.timedelta(seconds=at), "clash", 0)


def test_tail_equals_convolution():
    rng = np.random.default_rng(0)
    q, m, t = rng.random((30, 3)) * [0.001, 0.05, 0.5], rng.integers(1, 30, (30, 3)).astype(float), rng.integers(1, 25, 30)
    for row in range(30):
        pmf = np.ones(1)
        for a, b in zip(q[row], m[row]):
            for _ in range(int(b)):
                pmf = np.convolve(pmf, [1 - a, a])
        assert np.isclose(co.tail(q, m, t)[row], pmf[t[row] :].sum(), rtol=1e-8, atol=1e-300)


def test_null_keeps_degrees_and_sizes():
    k, n, s, m = [1, 4, 15], [60, 12, 3], [1, 3, 9], [40, 10, 9]
    s_total, k_total = sum(a * b for a, b in zip(s, m)), sum(a * b for a, b in zip(k, n))
    assert k_total >= s_total
    m[0] += k_total - s_total  # both sides hold as many incidences
    x, y = co.fit_null(k, n, s, m)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ m, k, rtol=1e-5) and np.allclose(p.T @ n, s, rtol=1e-5)


def test_counts_q_values_and_edges(spark):
    rng = random.Random(2)
    baskets = [["x", "y", *rng.sample([f"f{i}" for i in range(30)], 3)] for _ in range(12)] + [rng.sample([f"f{i}" for i in range(30)], 4) for _ in range(80)]
    rows = [commit(f"c{i}", 1, b) for i, b in enumerate(baskets)]
    rows += [commit("c0", 1, ["old"], at=-5), commit("c1", 1, baskets[1]), commit("e1", 1, None), commit("e2", 1, []), commit("e3", 1, [None, "./x", "x"]), commit("w", 1, [f"w{i}" for i in range(51)]), commit(None, 1, ["x", "y"]), commit("c9", None, ["x"])]
    got = {(r.a, r.b): r for r in co.coupled_paths(spark.createDataFrame(rows, COMMITS)).collect()}
    kept = [set(b) for b in baskets] + [{"x"}]
    want = Counter(p for b in kept for p in itertools.combinations(sorted(b), 2))
    assert {p: r.together for p, r in got.items()} == want
    degree = Counter(i for b in kept for i in b)
    assert all((r.count_a, r.count_b, r.n) == (degree[a], degree[b], len(kept)) for (a, b), r in got.items())
    assert got["x", "y"].q_value < 1e-3 and got["x", "y"].lift > 3
    assert sum(r.q_value < 0.05 for p, r in got.items() if p != ("x", "y")) <= 2
    order = sorted(got.values(), key=lambda r: r.p_value)
    assert all(a.q_value <= b.q_value + 1e-12 for a, b in zip(order, order[1:]))
    tests = len(degree) * (len(degree) - 1) / 2
    ps = [r.p_value for r in order]
    brute = [min(min(1.0, ps[j] * tests / sum(p <= ps[j] * (1 + 1e-12) for p in ps)) for j in range(i, len(ps))) for i in range(0, len(ps), 25)]
    assert np.allclose([order[i].q_value for i in range(0, len(ps), 25)], brute, rtol=1e-6)
    assert co.coupled_paths(spark.createDataFrame([], COMMITS)).count() == 0


def test_name_parts():
    same = ["Jürgen Pelpésgard", "Jurgen Pelpesgard", "PELPÉSGARD, Jürgen", "juergen.pelpesgard", "Jürgen K. Pelpésgard", "Jürgen\u00a0Pelpésgard <j@x.y>"]
    assert len({names.parse(s) for s in same}) == 1
    assert names.parse("The Stonewick Research Team") == names.parse("Stonewick Research, Inc.")
    for nobody in ("", " ", "unknown", "(no author)", "root", None):
        assert names.parse(nobody) is None
    assert names.near("kenji", "kejni") and names.near("abc", "abcd") and not names.near("abc", "abde") and not names.near("abcd", "acbe")


def test_entities(spark):
    spelled = {"Robert Veltüvard": 12, "Rob Veltüvard": 3, "R. Veltüvard": 2, "VELTÜVARD, R.": 1, "Robert Vetüvard": 4, "rveltuevard": 1, "Robert V.": 1, "Susan Veltüvard": 9, "S Veltüvard": 2, "Robert Zangelquist": 5, "Kenji Ulavowitz": 4, "Katherine Ulavowitz": 4, "K. Ulavowitz": 2, "unknown": 9, "": 3}
    rows = [commit(f"{i}-{j}", 1, None, a) for i, (a, n) in enumerate(spelled.items()) for j in range(n)] + [commit("z", 2, None, "Rob Veltüvard"), commit("y", 1, None, None), commit("q", None, None, "X Y")]
    df = spark.createDataFrame(rows, COMMITS)
    groups = {}
    for r in names.name_entities(df, "scan_id", "author").collect():
        groups.setdefault((r["space"], r.entity), set()).add(r.name)
    found = sorted(map(sorted, (g for (s, _), g in groups.items() if s == 1)))
    robert = sorted(["Robert Veltüvard", "Rob Veltüvard", "R. Veltüvard", "VELTÜVARD, R.", "Robert Vetüvard", "rveltuevard"])
    assert any(set(robert) <= set(g) for g in found) and sorted(["Susan Veltüvard", "S Veltüvard"]) in found
    assert ["K. Ulavowitz"] in found  # two equally likely owners
    assert not any("unknown" in g or "" in g for g in found)
    pairs = {(r.name_a, r.name_b) for r in names.author_names(df).collect()}
    assert ("S Veltüvard", "Susan Veltüvard") in pairs and all(a < b for a, b in pairs)
    assert names.author_names(spark.createDataFrame([], COMMITS)).count() == 0


def test_tail_by_terms_and_by_transform_agree():
    rng = np.random.default_rng(1)
    q, m = rng.random((200, 6)) * np.array([1e-6, 1e-3, 0.01, 0.05, 0.2, 0.6]), rng.integers(0, 200, (200, 6)).astype(float)
    for t in (rng.integers(1, 6, 200), rng.integers(1, 200, 200), np.full(200, 150)):
        t = np.minimum(t, m.sum(1).astype(int)).clip(1)
        assert np.allclose(co.tail(q, m, t), co._by_transform(q, m, t), rtol=1e-7, atol=1e-290)


def test_tail_of_large_counts_needs_no_long_transform():
    # a binomial of a million trials at two deviations
    got = co._by_transform(np.array([[0.5]]), np.array([[1e6]]), np.array([501_000]))[0]
    assert abs(got - 0.022796) < 2e-4


def test_found_pairs_pass_the_null_and_keep_the_rule(spark, tmp_path, monkeypatch):
    from codestrata.llm import plans

    rows = [commit(f"{s}-{i}", s, ["a", "b"] if i < 5 else [f"x{i}", "y", f"z{i % 7}"]) for s in (1, 2) for i in range(40)] + [commit("0", 1, ["p", "q"] * 30 + [str(i) for i in range(60)]), commit("1", None, ["a", "b"])]
    spark.createDataFrame(rows, COMMITS).write.parquet(str(tmp_path / "commits.parquet"))
    judged, whole = [], co.surprise
    monkeypatch.setattr(co, "surprise", lambda *args: judged.append(whole(*args)) or judged[-1])
    found = plans.p3_found(spark, str(tmp_path)).collect()
    duck = __import__("duckdb").connect()
    duck.sql(f"CREATE VIEW commits AS SELECT * FROM '{tmp_path}/commits.parquet/*.parquet'")
    assert found and sorted(map(tuple, found)) == sorted(duck.sql(plans.oracle_sql()["p3_found"]).fetchall())
    assert len(judged) == 1 and judged[0].where("p_value is null or q_value is null or expected <= 0").count() == 0 and judged[0].count() >= len(found)
