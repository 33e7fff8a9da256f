"""A reading order for newcomers, and the union of several repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.graph import degrees, reach
from codestrata.operators.running import running
from codestrata.session import cut


def tour(files: DataFrame, edges: DataFrame, entries: DataFrame, history: DataFrame, max_stops: int = 8, min_loc: int = 25) -> DataFrame:
    """``scan_id, stop, path, unlocks``: up to two entry points, then greedily the file that explains most.

    A file's worth is 3 for each uncovered file that depends on it, plus the root of its lines, plus 1.5 times the root
    of its commits; ties go to the least path. A stop covers the file and what it imports. All scans take their next
    stop in the same round, so there are at most ``max_stops`` rounds. Scans left with fewer than three stops are filled
    up by lines times one more than the dependents. ``unlocks`` of entry points is the number of files that they reach, of
    fillers that of their dependents.
    """
    name = F.substring_index("path", "/", -1)
    rank = F.when(name.isin("main.rs", "main.ts", "main.tsx"), 0).when(name.isin("App.tsx", "app.tsx"), 1).when(name == "lib.rs", 2).otherwise(3)
    fan = degrees(files, edges).select("scan_id", "path", "fan_in")
    known = cut(files.select("scan_id", "path", "loc").join(history.select("scan_id", "path", "commits"), ["scan_id", "path"], "left").join(fan, ["scan_id", "path"]).fillna(0, ["commits"]))
    edges = cut(edges.select("scan_id", "src", "dst"))
    order = Window.partitionBy("scan_id").orderBy(rank, F.desc("loc"), "path")
    first = known.join(entries, ["scan_id", "path"], "left_semi").withColumn("stop", F.row_number().over(order)).where("stop <= 2 and loc >= 2")
    begin = cut(first.select("scan_id", "stop", "path"))
    opened = reach(edges, begin.select("scan_id", F.col("path").alias("seed"))).groupBy("scan_id", F.col("seed").alias("path")).agg(F.count("*").alias("unlocks"))
    stops = [cut(begin.join(opened, ["scan_id", "path"], "left").select("scan_id", "stop", "path", F.coalesce("unlocks", F.lit(0)).alias("unlocks")))]
    covered = [stops[0].select("scan_id", "path"), edges.join(stops[0].select("scan_id", F.col("path").alias("src")), ["scan_id", "src"], "left_semi").select("scan_id", F.col("dst").alias("path"))]
    for turn in range(max_stops):
        seen = reduce(DataFrame.unionByName, covered).distinct()
        open_files = known.join(seen, ["scan_id", "path"], "left_anti")
        fresh = edges.join(open_files.select("scan_id", F.col("path").alias("src")), ["scan_id", "src"], "left_semi").groupBy("scan_id", F.col("dst").alias("path")).agg(F.count("*").alias("fresh"))
        worth = open_files.where(F.col("loc") >= min_loc).join(fresh, ["scan_id", "path"])
        score = F.col("fresh") * 3.0 + F.sqrt("loc") + F.sqrt("commits") * 1.5
        taken = reduce(DataFrame.unionByName, stops).groupBy("scan_id").agg(F.count("*").alias("taken"))
        best = worth.groupBy("scan_id").agg(F.min(F.struct(-score, "path", "fresh")).alias("b")).join(taken, "scan_id", "left").where(F.coalesce("taken", F.lit(0)) < max_stops)
        new = cut(best.select("scan_id", F.lit(3 + turn).alias("stop"), F.col("b.path").alias("path"), F.col("b.fresh").alias("unlocks")))
        if not new.limit(1).count():
            break
        stops.append(new)
        covered += [new.select("scan_id", "path"), edges.join(new.select("scan_id", F.col("path").alias("src")), ["scan_id", "src"], "left_semi").select("scan_id", F.col("dst").alias("path"))]
    chosen = cut(reduce(DataFrame.unionByName, stops))
    few = known.select("scan_id").distinct().join(chosen.groupBy("scan_id").agg(F.count("*").alias("taken")), "scan_id", "left").fillna(0, ["taken"]).where("taken < 3")
    rest = known.join(few, "scan_id").join(chosen.select("scan_id", "path"), ["scan_id", "path"], "left_anti").where("loc > 0")
    heavy = Window.partitionBy("scan_id").orderBy(F.desc(F.col("loc") * (1 + F.col("fan_in"))), "path")
    fill = rest.withColumn("at", F.row_number().over(heavy)).where(F.col("at") <= max_stops - F.col("taken")).select("scan_id", (F.col("at") + 100).alias("stop"), "path", F.col("fan_in").alias("unlocks"))
    whole = chosen.unionByName(fill)
    return whole.select("scan_id", F.row_number().over(Window.partitionBy("scan_id").orderBy("stop")).alias("stop"), "path", F.col("unlocks").cast("long").alias("unlocks"))


def workspace_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """``file_no, member, path``: the files of several repositories as one tree below their names, numbered by name and path over all of them.

    ``members`` has ``scan_id, member``. The numbers come from a distributed running count.
    """
    named = files.join(members, "scan_id").select("member", F.concat("member", F.lit("/"), "path").alias("path"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    return running(named, ["all"], [F.col("member"), F.col("path")], "one", "n").select((F.col("n") - 1).alias("file_no"), "member", "path")


def workspace_links(externals: DataFrame, published: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """``scan_id, src, target_scan, dst``: imports of a package that exactly one other member publishes, to that member's most used file.

    ``externals`` has ``scan_id, src, package``; ``published`` has ``scan_id, package``.
    """
    owner = published.distinct().groupBy("package").agg(F.count("*").alias("n"), F.min("scan_id").alias("target_scan")).where("n = 1")
    face = degrees(files, edges).groupBy(F.col("scan_id").alias("target_scan")).agg(F.min_by("path", F.struct(-F.col("fan_in"), "path")).alias("dst"))
    return externals.join(owner, "package").where("scan_id <> target_scan").join(face, "target_scan").select("scan_id", "src", "target_scan", "dst").distinct()


def repair(unresolved: DataFrame, edges: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that a language server's answers add, told apart: repairs of imports that had failed, and disagreements with ones that had not.

    All have ``scan_id, src, specifier``; answers add ``dst``. Answers of the file itself and of known edges add nothing.
    """
    new = answers.where("src <> dst").join(edges.select("scan_id", "src", "dst"), ["scan_id", "src", "dst"], "left_anti").dropDuplicates(["scan_id", "src", "dst"])
    failed = unresolved.select("scan_id", "src", "specifier").distinct()
    return new.join(failed, ["scan_id", "src", "specifier"], "left_semi"), new.join(failed, ["scan_id", "src", "specifier"], "left_anti")


def alias_audit(aliases: DataFrame, specifiers: DataFrame, paths: DataFrame) -> DataFrame:
    """``scan_id, source, pattern, target, used_by, resolves`` of path aliases (:func:`codestrata.operators.projects.path_aliases`): how many different imports use one, and whether a target exists.

    ``specifiers`` has ``scan_id, specifier``. An alias is met by the prefixes of a specifier, by an equal join; a target
    exists when its part before ``*`` is a file (with or without an ending) or a folder of ``paths``.
    """
    cuts = F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda n: F.substr("specifier", F.lit(1), n))
    asked = specifiers.select("scan_id", "specifier").distinct().select("scan_id", "specifier", F.explode(cuts).alias("prefix"))
    fits = F.when(F.col("wild"), F.endswith("specifier", F.col("suffix")) & (F.length("prefix") + F.length("suffix") <= F.length("specifier"))).otherwise(F.col("prefix") == F.col("specifier"))
    key = ["scan_id", "source", "pattern"]
    used = asked.join(aliases, ["scan_id", "prefix"]).where(fits).groupBy(*key).agg(F.count_distinct("specifier").alias("used_by"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    there = paths.select("scan_id", F.explode(F.array_distinct(F.concat(above, F.array(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(""))))).alias("stem")).distinct().withColumn("there", F.lit(True))
    stems = aliases.select(*key, F.explode("targets").alias("t")).select(*key, F.regexp_replace(F.substring_index("t", "*", 1), "/$", "").alias("stem"))
    found = stems.join(there, ["scan_id", "stem"], "left").groupBy(*key).agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("resolves"))
    told = aliases.select(*key, F.get("targets", F.lit(0)).alias("target")).join(found, key).join(used, key, "left")
    return told.select(*key, "target", F.coalesce("used_by", F.lit(0)).alias("used_by"), "resolves")
