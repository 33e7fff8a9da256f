"""Ranked findings: detectors, their union, caps, baselines and the views on them.

A finding is ``scan_id, kind, severity, score`` (FLOAT) ``, headline, paths`` (array). Headlines are fixed formats, as
fingerprints are made of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.globs import any_glob
from codestrata.operators.history import percentile
from codestrata.operators.running import row_numbers

# Labels of the kinds.
CYCLE, GOD, ORPHAN, UNSTABLE, LAYERS, BUS, DISTANT, CASE, RESOLVER, ALIAS = (
    "Import cycle", "God file", "Orphan", "Unstable interface", "Layering violation", "Bus factor", "Distant coupling", "Case mismatch", "Resolver disagreement", "Path alias")


@dataclass(frozen=True)
class Layer:
    """A layer and the globs of its paths."""

    name: str
    globs: tuple[str, ...]


def _f(value: float) -> Column:
    return F.lit(value).cast("float")


def _finding(df: DataFrame, kind: str, severity: Column, score: Column, headline: Column, *paths: str) -> DataFrame:
    return df.select("scan_id", F.lit(kind).alias("kind"), severity.alias("severity"), score.cast("float").alias("score"), headline.alias("headline"), F.array(*paths).alias("paths"))


def cycles(groups: DataFrame, chains: DataFrame) -> DataFrame:
    """One finding per cycle group (``scan_id, node, component, size``) with its shortest chain."""
    members = groups.groupBy("scan_id", "component", "size").agg(F.array_sort(F.collect_list("node")).alias("paths"))
    told = members.join(chains, ["scan_id", "component"])
    n = F.col("size")
    severity = F.when(n >= 6, "High").when(n >= 3, "Medium").otherwise("Low")
    score = F.greatest(F.least((n.cast("float") - _f(2)) / _f(10), F.lit(1.0)), F.lit(0.0)) * 0.5 + 0.5
    headline = F.concat(F.lit("Cycle across "), n.cast("string"), F.lit(" files: "), F.concat_ws(" → ", "chain"))
    return told.select("scan_id", F.lit(CYCLE).alias("kind"), severity.alias("severity"), score.cast("float").alias("score"), headline.alias("headline"), "paths")


def _measured(files: DataFrame, fan: DataFrame, history: DataFrame) -> DataFrame:
    """Files of scans with five or more files, with fan-in, commits (0 without history) and whether the scan has any history."""
    big = files.groupBy("scan_id").agg(F.count("*").alias("n")).where("n >= 5").select("scan_id")
    told = history.select("scan_id").distinct().withColumn("has_history", F.lit(True))
    joined = files.select("scan_id", "path", "module", "loc").join(big, "scan_id", "left_semi").join(fan.select("scan_id", "path", "fan_in"), ["scan_id", "path"])
    joined = joined.join(history.select("scan_id", "path", "commits"), ["scan_id", "path"], "left").join(told, "scan_id", "left")
    return joined.withColumn("churn", F.coalesce("commits", F.lit(0))).withColumn("has_history", F.coalesce("has_history", F.lit(False)))


def god_files(files: DataFrame, fan: DataFrame, history: DataFrame) -> DataFrame:
    """Files that are large, widely used and often changed: product of three percentiles of 0.4 or more, from 200 lines on."""
    m = percentile(percentile(percentile(_measured(files, fan, history), "loc", "p_loc"), "fan_in", "p_fan"), "churn", "p_churn")
    term = F.when(F.col("has_history"), F.col("p_churn")).otherwise(_f(0.6))
    scored = m.withColumn("score", (F.col("p_loc") * F.col("p_fan") * term).cast("float")).where((F.col("score") >= _f(0.4)) & (F.col("loc") >= 200))
    headline = F.format_string("%s is %d lines with %d dependents", "path", "loc", "fan_in")
    return _finding(scored, GOD, T.severity_for(F.col("score")), F.col("score"), headline, "path")


def unstable_interfaces(files: DataFrame, fan: DataFrame, history: DataFrame) -> DataFrame:
    """Files with three or more dependents and commits whose percentiles of both multiply to 0.6 or more.

    The population of the churn percentile is the scan's files that have history.
    """
    m = _measured(files, fan, history)
    churned = percentile(m.where("commits is not null"), "churn", "p_churn").select("scan_id", "path", "p_churn")
    scored = percentile(m, "fan_in", "p_fan").join(churned, ["scan_id", "path"]).where("fan_in >= 3 and churn >= 3").withColumn("score", (F.col("p_fan") * F.col("p_churn")).cast("float")).where(F.col("score") >= _f(0.6))
    headline = F.format_string("%s has %d dependents and changed %d times", "path", "fan_in", "churn")
    return _finding(scored, UNSTABLE, T.severity_for(F.col("score")), F.col("score"), headline, "path")


def bus_factors(files: DataFrame, fan: DataFrame, history: DataFrame, min_commits: int = 5, min_dependents: int = 5) -> DataFrame:
    """Files of one author with ``min_commits`` and ``min_dependents`` or more, in scans with two or more top authors."""
    several = history.where("top_author is not null").groupBy("scan_id").agg(F.count_distinct("top_author").alias("n")).where("n >= 2").select("scan_id")
    sole = history.where((F.col("authors") == 1) & (F.col("commits") >= min_commits)).join(several, "scan_id", "left_semi").join(fan.select("scan_id", "path", "fan_in"), ["scan_id", "path"]).where(F.col("fan_in") >= min_dependents).join(files.select("scan_id", "path"), ["scan_id", "path"], "left_semi")
    score = F.least(F.least((F.col("fan_in").cast("float") / _f(20)), F.lit(1.0)) * 0.5 + 0.4, F.lit(1.0))
    headline = F.format_string("%s has %d dependents and one author (%s)", "path", "fan_in", "top_author")
    return _finding(sole, BUS, F.lit("Medium"), score, headline, "path")


def orphan_files(files: DataFrame, free: DataFrame) -> DataFrame:
    """Files that nothing imports (``free``: ``scan_id, path``) and that may be dead."""
    dead = files.join(free, ["scan_id", "path"], "left_semi").where(T.can_be_dead(F.col("path")))
    return _finding(dead, ORPHAN, F.lit("Low"), F.lit(0.45), F.format_string("%s is never imported (%d lines)", "path", "loc"), "path")


def layer_of(path: Column, layers: list[Layer]) -> Column:
    """First declared layer one of whose globs matches; null for none."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(path.rlike(any_glob(list(layer.globs))), F.lit(layer.name)) for layer in layers])


def parse_rules(rules: list[str], layers: list[Layer]) -> tuple[list[tuple[str, str]], list[str]]:
    """Allowed pairs of ``"a -> b"`` rules, and the rules that are malformed or name no declared layer."""
    known, good, bad = {layer.name for layer in layers}, [], []
    for rule in rules:
        left, arrow, right = (part.strip() for part in rule.partition("->"))
        (good if arrow and left in known and right in known else bad).append((left, right) if arrow and left in known and right in known else rule)
    return good, bad


def layering_violations(edges: DataFrame, layers: list[Layer], rules: list[str]) -> DataFrame:
    """Imports between different layers that no rule allows; rules are not transitive."""
    allowed, _ = parse_rules(rules, layers)
    layered = edges.withColumn("a", layer_of(F.col("src"), layers)).withColumn("b", layer_of(F.col("dst"), layers)).where("a is not null and b is not null and a <> b")
    permitted = F.struct("a", "b").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in allowed]) if allowed else F.lit(False)
    return _finding(layered.where(~permitted), LAYERS, F.lit("High"), F.lit(0.88), F.format_string("%s → %s: %s imports %s", "a", "b", "src", "dst"), "src", "dst")


def distant_couplings(files: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that change together (confidence 0.6 or more), lie in different modules and import each other in neither direction."""
    at = lambda end: files.select("scan_id", F.col("path").alias(end), F.col("module").alias(f"m_{end}"))
    near = pairs.where(F.col("confidence") >= _f(0.6)).join(at("a"), ["scan_id", "a"]).join(at("b"), ["scan_id", "b"]).where("m_a <> m_b")
    either = edges.select("scan_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    apart = near.join(either, ["scan_id", "a", "b"], "left_anti")
    headline = F.format_string("%s and %s change together %.0f%% of the time but are unrelated in code", "a", "b", F.col("confidence").cast("double") * 100)
    return _finding(apart, DISTANT, F.lit("Medium"), F.least("confidence", _f(1)) * _f(0.8), headline, "a", "b")


def case_mismatches(files: DataFrame) -> DataFrame:
    """Imports whose target exists only in other letter case; of several such files the least path."""
    absent = files.select("scan_id", F.col("path").alias("src"), F.explode("depends_on").alias("dst")).distinct().join(files.select("scan_id", F.col("path").alias("dst")), ["scan_id", "dst"], "left_anti")
    folded = files.groupBy("scan_id", F.lower("path").alias("key")).agg(F.min("path").alias("actual"))
    met = absent.withColumn("key", F.lower("dst")).join(folded, ["scan_id", "key"])
    return _finding(met, CASE, F.lit("High"), F.lit(0.86), F.format_string("%s imports \"%s\" but the file is %s", "src", "dst", "actual"), "src")


def resolver_disagreements(disagreements: DataFrame) -> DataFrame:
    """Imports that a language server takes elsewhere (``scan_id, src, line, server, specifier, dst``), both files known."""
    known = disagreements.where("src is not null and dst is not null")
    headline = F.format_string("%s:%d — %s resolves \"%s\" to %s", "src", "line", "server", "specifier", "dst")
    return _finding(known, RESOLVER, F.lit("High"), F.lit(0.88), headline, "src", "dst")


def path_aliases(audit: DataFrame) -> DataFrame:
    """Aliases that lead nowhere, and ones that nothing uses (``scan_id, source, pattern, target, used_by, resolves``, see :func:`codestrata.operators.tour.alias_audit`); no file bears them."""
    odd = audit.where("not resolves or used_by = 0")
    broken = ~F.col("resolves")
    headline = F.when(broken, F.format_string("%s maps \"%s\" to %s, which does not exist", "source", "pattern", F.coalesce("target", F.lit("nothing")))).otherwise(F.format_string("%s declares \"%s\" and nothing imports through it", "source", "pattern"))
    told = odd.select("scan_id", F.lit(ALIAS).alias("kind"), F.when(broken, "High").otherwise("Info").alias("severity"), F.when(broken, 0.87).otherwise(0.2).cast("float").alias("score"), headline.alias("headline"))
    return told.withColumn("paths", F.array().cast("array<string>"))


def combine(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def capped(findings: DataFrame, max_per_kind: int = 100) -> DataFrame:
    """The first ``max_per_kind`` findings of each kind of a scan, by severity, score and headline; the cap is the reference's report."""
    order = Window.partitionBy("scan_id", "kind").orderBy(T.severity_rank(F.col("severity")).desc(), F.desc("score"), "headline")
    return findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_per_kind).drop("rank")


def ranked(findings: DataFrame) -> DataFrame:
    """With ``position``: the place of each finding in its scan's report."""
    return row_numbers(findings, ["scan_id"], [T.severity_rank(F.col("severity")).desc(), F.desc("score"), F.col("headline")], "position")


def fingerprint() -> Column:
    """16 hex digits that stay when only numbers of a headline move: kind, sorted paths and the headline without digits."""
    plain = F.trim(F.translate("headline", "0123456789", ""))
    return F.substring(F.sha2(F.concat_ws("\u0000", F.col("kind"), F.concat_ws("\u0000", F.array_sort("paths")), plain), 256), 1, 16)


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumn("id", fingerprint())


def compare_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``scan_id, id, state, headline``: fresh findings, accepted ones, and baseline entries that are fixed. Both sides have ``scan_id, id, headline``."""
    now = findings.select("scan_id", "id", "headline").dropDuplicates(["scan_id", "id"])
    base = baseline.select("scan_id", "id", F.col("headline").alias("old")).dropDuplicates(["scan_id", "id"])
    both = now.join(base, ["scan_id", "id"], "full_outer")
    state = F.when(F.col("old").isNull(), "fresh").when(F.col("headline").isNull(), "fixed").otherwise("accepted")
    return both.select("scan_id", "id", state.alias("state"), F.coalesce("headline", "old").alias("headline"))


def accept(findings: DataFrame, below: str | None = None, note: str | None = None) -> DataFrame:
    """A baseline (``scan_id, id, kind, severity, headline, paths, note``) of all findings, or of those less severe than ``below``."""
    kept = findings if below is None else findings.where(T.severity_rank(F.col("severity")) < T.SEVERITIES.index(below) + 1)
    return with_ids(kept).select("scan_id", "id", "kind", "severity", "headline", "paths", F.lit(note).cast("string").alias("note")).dropDuplicates(["scan_id", "id"])


def drop_entries(baseline: DataFrame, part: str) -> DataFrame:
    """Without the entries whose headline holds ``part``, in any letter case."""
    return baseline.where(~F.contains(F.lower("headline"), F.lit(part.lower())))


def prune(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """Without the entries that no finding bears any more."""
    return baseline.join(with_ids(findings).select("scan_id", "id"), ["scan_id", "id"], "left_semi")


def counts(findings: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """``scan_id, kind, n``, accepted entries left out."""
    open_ones = findings if accepted is None else with_ids(findings).join(accepted.select("scan_id", "id"), ["scan_id", "id"], "left_anti")
    return open_ones.groupBy("scan_id", "kind").agg(F.count("*").alias("n"))


def heat(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``scan_id, path, heat``: the hottest finding that names a file, else 0."""
    hot = findings.select("scan_id", F.explode("paths").alias("path"), T.heat_of(F.col("severity")).alias("h")).groupBy("scan_id", "path").agg(F.max("h").alias("heat"))
    return files.select("scan_id", "path").join(hot, ["scan_id", "path"], "left").select("scan_id", "path", F.coalesce("heat", F.lit(0.0)).alias("heat"))


def page(findings: DataFrame, kinds: list[str] | None = None, severity: str | None = None, skip: int = 0, take: int = 50) -> DataFrame:
    """One page of each scan's report after the filters; ``take`` is held within 1 and 500."""
    take = max(1, min(500, take))
    kept = findings if kinds is None else findings.where(F.col("kind").isin(*kinds))
    kept = kept if severity is None else kept.where(F.col("severity") == severity)
    return ranked(kept).where((F.col("position") > skip) & (F.col("position") <= skip + take))


def gate(findings: DataFrame, fail_on: str | None = None, fail_on_cycle: bool = False, unresolved: DataFrame | None = None, max_unresolved: int | None = None) -> bool:
    """Whether a check passes: no finding as severe as ``fail_on``, no cycle if that is asked, no more than ``max_unresolved`` rows of ``unresolved``."""
    if max_unresolved is not None and unresolved is not None and unresolved.limit(max_unresolved + 1).count() > max_unresolved:
        return False
    bad = F.lit(False)
    if fail_on is not None:
        bad = bad | (T.severity_rank(F.col("severity")) >= T.SEVERITIES.index(fail_on) + 1)
    if fail_on_cycle:
        bad = bad | (F.col("kind") == CYCLE)
    return findings.where(bad).limit(1).count() == 0
