"""What changed between consecutive full snapshots.

Every snapshot of a scan gets its index in time. One window per path over that index then tells everything: a lagged
hash that differs is a change, a gap before a row is an addition, a gap after it is a removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import plain_path
from codestrata.operators.cycles import cycle_groups
from codestrata.session import bucketed, buckets, partitioned_by_some, stage

SNAP = ["scan_id", "commit_id"]
DELIVERY = [*SNAP, "delivery_no"]
#: A scan's paths are split into so many pieces, so that a scan of any size lies in many tasks.
PIECES = 16
BUCKET = ["scan_id", "piece"]


def complete_snapshots(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """``scan_id, commit_id, delivery_no, snap_time, idx, last_idx``: of each snapshot its latest complete delivery, numbered by time.

    A delivery is complete when its distinct plain paths number ``file_count``; a null ``file_count`` or key is never
    complete. Equal ``snap_time`` of two snapshots is settled by ``commit_id``.
    """
    paths = files.where("path is not null").select(*DELIVERY, plain_path(F.col("path")).alias("path")).distinct()
    return _numbered(snapshots, paths.groupBy(*DELIVERY).agg(F.count("*").alias("held")))


def _numbered(snapshots: DataFrame, held: DataFrame) -> DataFrame:
    said = snapshots.groupBy(*DELIVERY).agg(F.max("file_count").alias("file_count"), F.min("snap_time").alias("snap_time"))
    whole = said.join(held, DELIVERY, "left").where(F.coalesce("held", F.lit(0)) == F.col("file_count"))
    latest = whole.groupBy(*SNAP).agg(F.max("delivery_no").alias("delivery_no"), F.max_by("snap_time", "delivery_no").alias("snap_time"))
    order = Window.partitionBy("scan_id").orderBy("snap_time", "commit_id")
    numbered = latest.withColumn("idx", F.row_number().over(order))
    return numbered.withColumn("last_idx", F.max("idx").over(Window.partitionBy("scan_id")))


def snapshot_rows(snapshots: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered snapshots, and one row per snapshot and path (of repeats the one read last)."""
    numbered = stage(complete_snapshots(snapshots, files))
    kept = files.select(*DELIVERY, plain_path(F.col("path")).alias("path"), F.lower("blob").alias("blob"), "bytes", "loc", "depends_on", "read_at").where("path is not null")
    last = F.struct("read_at", "blob", "bytes", "loc", "depends_on")
    rows = kept.join(numbered.select(*DELIVERY, "idx", "last_idx"), DELIVERY).groupBy("scan_id", "path", "idx", "last_idx").agg(F.max(last).alias("v"))
    return numbered, rows.select("scan_id", "path", "idx", "last_idx", "v.blob", "v.bytes", "v.loc", "v.depends_on")


def delivered_rows(files: DataFrame, pieces: int = PIECES) -> DataFrame:
    """One row per delivery and path, as small as comparison needs it: the one shuffle of the whole table.

    Buckets hold a ``piece`` of a scan's paths each, so all rows of a path are together and a scan of any size is split
    over tasks. ``node`` is the 64-bit hash of the path and ``targets`` holds those of ``depends_on``: two paths of a
    scan share one with a chance of about 3 in 10^14 for a thousand paths. A blob of hex digits is kept as bytes, any other as
    text.
    """
    blob = F.lower("blob")
    is_hex = F.coalesce(blob.rlike("^([0-9a-f][0-9a-f])*$"), F.lit(False))
    targets = F.transform(F.filter("depends_on", lambda p: p.isNotNull()), lambda p: F.xxhash64(p))
    kept = files.where("path is not null").select(
        *DELIVERY, plain_path(F.col("path")).alias("path"), "read_at", F.when(is_hex, F.unhex(blob)).alias("digits"), F.when(~is_hex, blob).alias("words"), targets.alias("targets"))
    piece = F.pmod(F.xxhash64("path"), F.lit(pieces))
    one = (
        kept.repartition(buckets(files.sparkSession), "scan_id", piece).withColumn("piece", piece)
        .groupBy("scan_id", "piece", "path", "commit_id", "delivery_no").agg(F.max(F.struct("read_at", "digits", "words", "targets")).alias("v")))
    return bucketed(one.select("scan_id", "piece", "path", "commit_id", "delivery_no", "v.digits", "v.words", "v.targets"), *BUCKET)


def compared_rows(rows: DataFrame, numbered: DataFrame, pieces: int = PIECES) -> DataFrame:
    """The rows of the numbered snapshots with ``node, idx`` and the ``events`` that the window over their path tells."""
    known = numbered.select(*DELIVERY, "idx", (F.col("idx") == F.col("last_idx")).alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"))
    kept = rows.join(known.hint("shuffle_hash"), [*BUCKET, "commit_id", "delivery_no"])
    over = Window.partitionBy(*BUCKET, "path").orderBy("idx")
    lag = lambda c: F.lag(c).over(over)
    follows = F.col("before").eqNullSafe(F.col("idx") - 1)
    seen = kept.select(*BUCKET, "path", "targets", "idx", "last", "digits", "words", lag("idx").alias("before"), lag("digits").alias("old_digits"), lag("words").alias("old_words"), F.lead("idx").over(over).alias("after"))
    same = F.col("digits").eqNullSafe(F.col("old_digits")) & F.col("words").eqNullSafe(F.col("old_words"))
    came = F.when(~follows & (F.col("idx") > 1), F.struct(F.col("idx").alias("idx"), F.lit("added").alias("change")))
    differs = F.when(follows & ~same, F.struct(F.col("idx").alias("idx"), F.lit("changed").alias("change")))
    gone = F.when(~F.col("last") & ~F.col("after").eqNullSafe(F.col("idx") + 1), F.struct((F.col("idx") + 1).alias("idx"), F.lit("removed").alias("change")))
    events = F.filter(F.array(came, differs, gone), lambda e: e.isNotNull())
    with partitioned_by_some(rows.sparkSession):
        return bucketed(seen.select(*BUCKET, F.xxhash64("path").alias("node"), "path", "idx", "targets", events.alias("events")), *BUCKET)


def new_cycles(rows: DataFrame, pieces: int = PIECES) -> DataFrame:
    """``scan_id, idx, path``: the members of every cycle group that a snapshot has and the one before has not.

    A group of one snapshot lies inside a group of the scan's edges of all snapshots together, so these are found first,
    once per scan, and only their few edges are searched again snapshot by snapshot. Groups are compared member by
    member through the lagged window, so no group is gathered: a group is old when all its members were one group of
    the same size in the snapshot before.
    """
    linked = rows.where(F.size("targets") > 0)
    ever = stage(cycle_groups(linked.select(F.col("scan_id").alias("graph"), F.col("node").alias("src"), F.explode("targets").alias("dst"))))
    inside = linked.join(ever.select(F.col("graph").alias("scan_id"), F.pmod("node", F.lit(pieces)).alias("piece"), "node", F.col("component").alias("whole")), [*BUCKET, "node"])
    edges = inside.select(F.struct("scan_id", "idx", "whole").alias("graph"), F.col("node").alias("src"), F.explode("targets").alias("dst"))
    with partitioned_by_some(rows.sparkSession):
        groups = stage(cycle_groups(edges).select("graph.scan_id", "graph.idx", "node", "component", "size"))
    over = Window.partitionBy("scan_id", "node").orderBy("idx")
    near = F.lag("idx").over(over).eqNullSafe(F.col("idx") - 1)
    lagged = groups.select("*", F.when(near, F.lag("component").over(over)).alias("was"), F.when(near, F.lag("size").over(over)).alias("was_size"))
    state = lagged.groupBy("scan_id", "idx", "component").agg(
        F.bool_and(F.col("was").isNotNull() & (F.col("was_size") == F.col("size"))).alias("same_size"), (F.min("was") == F.max("was")).alias("one"))
    fresh = state.where(~(F.coalesce("same_size", F.lit(False)) & F.coalesce("one", F.lit(False))) & (F.col("idx") > 1)).select("scan_id", "idx", "component")
    members = groups.join(fresh, ["scan_id", "idx", "component"], "left_semi").select("scan_id", "idx", "node", F.pmod("node", F.lit(pieces)).alias("piece"))
    paths = rows.groupBy(*BUCKET, "node").agg(F.min("path").alias("path"))
    with partitioned_by_some(rows.sparkSession):
        return stage(members.join(paths, [*BUCKET, "node"]).select("scan_id", "idx", "path"))


def snapshot_diff(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Added, removed and changed paths and members of new cycle groups between consecutive snapshots of a scan.

    Out: ``scan_id, commit_id`` (of the later snapshot) ``, path, change``. Null paths are no files; null blobs are one
    blob; ``depends_on`` null means none; repeated rows count once (the one read last, of these the greatest blob and
    imports); snapshots without a complete delivery are left out; a scan with one snapshot, or empty tables, give no
    rows; extra columns are ignored.
    """
    delivered = delivered_rows(files)
    numbered = stage(_numbered(snapshots, delivered.groupBy(*DELIVERY).agg(F.count("*").alias("held"))))
    rows = compared_rows(delivered, numbered)
    changes = rows.select("scan_id", "path", F.explode("events").alias("e")).select("scan_id", "e.idx", "path", "e.change")
    cycles = new_cycles(rows).withColumn("change", F.lit("cycle"))
    named = numbered.select("scan_id", "idx", "commit_id")
    return changes.unionByName(cycles).join(named, ["scan_id", "idx"]).select("scan_id", "commit_id", "path", "change")


def grown_files(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """``scan_id, commit_id, path, delta`` of files whose ``loc`` differs between consecutive snapshots (positive: grown). Null ``loc`` is no measure."""
    numbered, rows = snapshot_rows(snapshots, files)
    over = Window.partitionBy("scan_id", "path").orderBy("idx")
    near = F.lag("idx").over(over).eqNullSafe(F.col("idx") - 1)
    sized = rows.select("scan_id", "idx", "path", F.when(near, F.col("loc") - F.lag("loc").over(over)).alias("delta"))
    named = numbered.select("scan_id", "idx", "commit_id")
    return sized.where("delta <> 0").join(named, ["scan_id", "idx"]).select("scan_id", "commit_id", "path", F.col("delta").cast("long").alias("delta"))
