"""Series of snapshots: sampling, totals, comparison of two revisions, and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators.cycles import cycle_groups
from codestrata.operators.running import running


def sampled(numbered: DataFrame, steps: int = 6) -> DataFrame:
    """``scan_id, commit_id, snap_time, idx, label``: about ``steps`` snapshots of a scan, spread over its time.

    Of each time bucket the newest snapshot is taken; if that gives too few, more are taken at even strides from the
    newest on. Labels are clock, day or month by the span of the scan.
    """
    newest_first = Window.partitionBy("scan_id").orderBy(F.desc("snap_time"), F.desc("idx"))
    whole = Window.partitionBy("scan_id")
    rows = numbered.select("scan_id", "commit_id", "snap_time", "idx", F.row_number().over(newest_first).alias("pos"), F.max("snap_time").over(whole).alias("hi"), F.min("snap_time").over(whole).alias("lo"), F.count("*").over(whole).alias("n"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    bucketed = rows.withColumn("bucket", F.round((F.col("hi") - F.col("snap_time")) / span * (steps - 1)))
    first = bucketed.withColumn("in_bucket", F.row_number().over(Window.partitionBy("scan_id", "bucket").orderBy("pos")) == 1)
    counted = first.withColumn("chosen", F.sum(F.col("in_bucket").cast("int")).over(whole)).withColumn("want", F.least(F.lit(steps), F.col("n")))
    strides = F.transform(F.sequence(F.lit(0), F.col("want").cast("int") - 1), lambda k: F.floor(k * F.greatest(F.col("n") / F.col("want"), F.lit(1.0))).cast("int") + 1)
    extra = ~F.col("in_bucket") & (F.col("chosen") < F.col("want")) & F.array_contains(strides, F.col("pos").cast("int"))
    filled = counted.withColumn("extra", extra.cast("int")).withColumn("extra_rank", F.sum("extra").over(newest_first))
    kept = filled.where(F.col("in_bucket") | ((F.col("extra") == 1) & (F.col("extra_rank") <= F.col("want") - F.col("chosen"))))
    return kept.select("scan_id", "commit_id", "snap_time", "idx", T.time_label(F.col("snap_time"), F.col("hi") - F.col("lo")).alias("label"))


def totals(rows: DataFrame) -> DataFrame:
    """``scan_id, idx, file_count, total_loc, edge_count``; edges are imports as written."""
    size = F.greatest(F.size(F.coalesce("depends_on", F.array().cast("array<string>"))), F.lit(0))
    return rows.groupBy("scan_id", "idx").agg(F.count("*").alias("file_count"), F.sum(F.coalesce("loc", F.lit(0)).cast("long")).alias("total_loc"), F.sum(size).alias("edge_count"))


def compare_refs(base: DataFrame, head: DataFrame) -> DataFrame:
    """``scan_id, path, change, delta``: added, removed, grown and shrunk files between two trees (``scan_id, path, loc``)."""
    both = base.select("scan_id", "path", F.col("loc").alias("old")).join(head.select("scan_id", "path", F.col("loc").alias("new")), ["scan_id", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") > F.col("old"), "grown").when(F.col("new") < F.col("old"), "shrunk")
    delta = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.col("new") - F.col("old"))
    return both.select("scan_id", "path", change.alias("change"), delta.cast("long").alias("delta")).where("change is not null")


def cycle_changes(base_edges: DataFrame, head_edges: DataFrame) -> DataFrame:
    """``scan_id, component, size, change``: cycle groups introduced or resolved between two trees, compared by their members."""
    def sets(edges: DataFrame) -> DataFrame:
        groups = cycle_groups(edges.select(F.col("scan_id").alias("graph"), "src", "dst"))
        # a group is known by its size and the sum of two independent hashes of its members, so no group is gathered
        mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(38,0)"))
        return groups.groupBy(F.col("graph").alias("scan_id"), "component", "size").agg(mark(1).alias("m1"), mark(2).alias("m2"))

    old, new = sets(base_edges), sets(head_edges)
    key = ["scan_id", "component", "size", "m1", "m2"]
    came = new.join(old, key, "left_anti").withColumn("change", F.lit("introduced"))
    went = old.join(new, key, "left_anti").withColumn("change", F.lit("resolved"))
    return came.unionByName(went).select("scan_id", "component", "size", "change")


def as_of(events: DataFrame, states: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """``events`` with the ``value`` of the last state of the same group at or before them; null before the first.

    Both sides are put in one order and a running count of the states numbers them; an event's count is the number of
    its state, so the rest is an equal join and a hot group is spread over tasks. Of states at one time the greatest
    value holds. Null times and groups of states are no states.
    """
    marks = states.where(F.col(group).isNotNull() & F.col(at).isNotNull()).select(F.col(group), F.col(at), F.lit(1).cast("long").alias("_state"), F.col(value).alias("_value"), F.lit(None).cast(events.schema.simpleString()).alias("_row"))
    asks = events.select(F.col(group), F.col(at), F.lit(0).cast("long").alias("_state"), F.lit(None).cast(states.schema[value].dataType).alias("_value"), F.struct(*events.columns).alias("_row"))
    counted = running(asks.unionByName(marks), [group], [F.col(at), F.col("_state").desc(), F.col("_value")], "_state", "_count")
    known = counted.where("_state = 1").select(F.col(group), "_count", F.col("_value").alias("_last"))
    return counted.where("_state = 0").drop("_value").join(known, [group, "_count"], "left").select("_row.*", F.col("_last").alias(value))
