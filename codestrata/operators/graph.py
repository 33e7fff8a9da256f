"""Operators on import graphs; every graph is one ``scan_id`` and all graphs are handled at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import small_graphs as small
from codestrata.operators.cycles import TASK_EDGES
from codestrata.operators.running import row_numbers, running
from codestrata.session import cut


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``scan_id, path, fan_in, fan_out``: distinct neighbours of every file."""
    ins = edges.groupBy("scan_id", F.col("dst").alias("path")).agg(F.count_distinct("src").alias("fan_in"))
    outs = edges.groupBy("scan_id", F.col("src").alias("path")).agg(F.count_distinct("dst").alias("fan_out"))
    joined = files.select("scan_id", "path").join(ins, ["scan_id", "path"], "left").join(outs, ["scan_id", "path"], "left")
    return joined.select("scan_id", "path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def with_modules(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with ``src_module`` and ``dst_module``."""
    at = files.select("scan_id", "path", "module")
    left = edges.join(at.select("scan_id", F.col("path").alias("src"), F.col("module").alias("src_module")), ["scan_id", "src"])
    return left.join(at.select("scan_id", F.col("path").alias("dst"), F.col("module").alias("dst_module")), ["scan_id", "dst"])


def module_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``scan_id, src_module, dst_module, edges`` between different modules."""
    return with_modules(edges, files).where("src_module <> dst_module").groupBy("scan_id", "src_module", "dst_module").agg(F.count("*").alias("edges"))


def _walk(front: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """All rows that ``front`` reaches by ``steps`` (``scan_id, path, next``), itself included.

    Breadth-first over all graphs at once: a round joins only the rows met in the round before, and each round's new
    rows are cut from their lineage into the shared folder.
    """
    fronts = [cut(front.select(*key, "path").distinct())]
    while fronts[-1].limit(1).count():
        new = fronts[-1].join(steps, ["scan_id", "path"]).select(*key, F.col("next").alias("path")).distinct()
        fronts.append(cut(new.join(reduce(DataFrame.unionByName, fronts), [*key, "path"], "left_anti")))
    return reduce(DataFrame.unionByName, fronts)


def reach(edges: DataFrame, seeds: DataFrame, backward: bool = False, task_edges: int = TASK_EDGES) -> DataFrame:
    """``scan_id, seed, path``: what each seed reaches in one step or more, the seed itself left out.

    Graphs of up to ``task_edges`` edges and seeds are walked inside tasks, larger ones round by round.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    turned = edges.select("scan_id", F.col(a).alias("src"), F.col(b).alias("dst"))
    graphs, large = small.by_size(turned, seeds.select("scan_id", F.col("seed").alias("node")), task_edges)
    near = small.solved(graphs, small.reach_each, "seed string, path string")
    if large is None:
        return near
    steps = turned.join(large, "scan_id", "left_semi").select("scan_id", F.col("src").alias("path"), F.col("dst").alias("next"))
    far = _walk(seeds.join(large, "scan_id", "left_semi").select("scan_id", "seed", F.col("seed").alias("path")), steps, ["scan_id", "seed"]).where("path <> seed")
    return near.unionByName(far.select("scan_id", "seed", "path"))


def impact(edges: DataFrame, seeds: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``scan_id, path``: files that depend on any of the ``seeds`` (``scan_id, path``), directly or not; seeds are left out."""
    turned = edges.select("scan_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    graphs, large = small.by_size(turned, seeds.select("scan_id", F.col("path").alias("node")), task_edges)
    near = small.solved(graphs, small.reach_all, "path string")
    if large is None:
        return near
    steps = turned.join(large, "scan_id", "left_semi").select("scan_id", F.col("src").alias("path"), F.col("dst").alias("next"))
    asked = seeds.join(large, "scan_id", "left_semi").select("scan_id", "path")
    return near.unionByName(_walk(asked, steps, ["scan_id"]).join(asked, ["scan_id", "path"], "left_anti").select("scan_id", "path"))


def orphans(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``scan_id, path`` of files that nothing imports and that are no entry points. A file without importers is reached only as an entry itself, so no traversal is needed."""
    free = files.select("scan_id", "path").join(edges.select("scan_id", F.col("dst").alias("path")), ["scan_id", "path"], "left_anti")
    return free.join(entries.select("scan_id", "path"), ["scan_id", "path"], "left_anti")


def shortest_cycles(edges: DataFrame, groups: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``scan_id, component, chain``: of each cycle group the shortest closed walk through its least member, the least in byte order of those.

    ``groups`` has ``scan_id, node, component, size``. Walks grow level by level inside their group, of the walks to a
    file only the least is kept, and a group stops when its walk is closed. Only edges inside groups are looked at.
    """
    members = groups.select("scan_id", F.col("node").alias("src"), "component").join(edges.select("scan_id", "src", "dst"), ["scan_id", "src"])
    held = members.join(groups.select("scan_id", F.col("node").alias("dst"), "component"), ["scan_id", "dst", "component"], "left_semi").select("scan_id", "src", "dst")
    graphs, large = small.by_size(held, groups.select("scan_id", "node").limit(0), task_edges)
    near = small.solved(graphs, small.least_cycles, "component string, chain array<string>")
    if large is None:
        return near
    return near.unionByName(_cycles_by_rounds(held.join(large, "scan_id", "left_semi"), groups.join(large, "scan_id", "left_semi")))


def _cycles_by_rounds(edges: DataFrame, groups: DataFrame) -> DataFrame:
    at = groups.select("scan_id", "node", "component")
    inside = cut(
        edges.join(at.select("scan_id", F.col("node").alias("src"), "component"), ["scan_id", "src"])
        .join(at.select("scan_id", F.col("node").alias("dst"), F.col("component").alias("c2")), ["scan_id", "dst"])
        .where("component = c2").select("scan_id", "component", "src", "dst"))
    front = groups.select("scan_id", "component").distinct().withColumn("at", F.col("component")).withColumn("walk", F.array("component"))
    met = cut(front.select("scan_id", "component", "at"))
    front, done = cut(front), None
    while front.limit(1).count():
        grown = front.join(inside.withColumnRenamed("src", "at"), ["scan_id", "component", "at"])
        walks = cut(grown.groupBy("scan_id", "component", "dst").agg(F.min(F.concat("walk", F.array("dst"))).alias("walk")))
        closed = walks.where("dst = component").select("scan_id", "component", F.col("walk").alias("chain"))
        done = closed if done is None else done.unionByName(closed)
        rest = walks.join(closed, ["scan_id", "component"], "left_anti").withColumnRenamed("dst", "at")
        front = cut(rest.join(met, ["scan_id", "component", "at"], "left_anti").select("scan_id", "component", "at", "walk"))
        met = cut(met.unionByName(front.select("scan_id", "component", "at")))
    return done if done is not None else groups.select("scan_id", "component", F.array("component").alias("chain")).limit(0)


def levels(files: DataFrame, edges: DataFrame, groups: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``scan_id, path, level``: dependencies lie on lower levels than what depends on them; the files of a cycle group share one.

    Cycle groups are taken as one node; then all nodes without open dependencies are peeled off, level by level.
    """
    graphs, large = small.by_size(edges, files.select("scan_id", F.col("path").alias("node")), task_edges)
    near = small.solved(graphs, small.levels_of, "path string, level int")
    if large is None:
        return near
    kept = lambda df: df.join(large, "scan_id", "left_semi")
    return near.unionByName(_levels_by_rounds(kept(files), kept(edges), kept(groups)))


def _levels_by_rounds(files: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    at = files.select("scan_id", "path").join(groups.select("scan_id", F.col("node").alias("path"), "component"), ["scan_id", "path"], "left").select("scan_id", "path", F.coalesce("component", "path").alias("unit"))
    at = cut(at)
    rest = edges.join(at.select("scan_id", F.col("path").alias("src"), F.col("unit").alias("a")), ["scan_id", "src"]).join(at.select("scan_id", F.col("path").alias("dst"), F.col("unit").alias("b")), ["scan_id", "dst"])
    rest = cut(rest.where("a <> b").select("scan_id", "a", "b").distinct())
    units = at.select("scan_id", "unit").distinct()
    placed, open_units, level = None, cut(units), 0
    while open_units.limit(1).count():
        blocked = rest.select("scan_id", F.col("a").alias("unit")).distinct()
        free = cut(open_units.join(blocked, ["scan_id", "unit"], "left_anti"))
        now = free.withColumn("level", F.lit(level))
        placed = now if placed is None else placed.unionByName(now)
        open_units = cut(open_units.join(free, ["scan_id", "unit"], "left_anti"))
        rest = cut(rest.join(free.withColumnRenamed("unit", "b"), ["scan_id", "b"], "left_anti").select("scan_id", "a", "b"))
        level += 1
    if placed is None:
        return at.select("scan_id", "path", F.lit(0).alias("level"))
    return at.join(placed, ["scan_id", "unit"]).select("scan_id", "path", "level")


def ordered(level_rows: DataFrame) -> DataFrame:
    """``scan_id, path, position``: a dependency order of the files of a scan, by level and path."""
    placed = row_numbers(level_rows.select("scan_id", "path", "level"), ["scan_id"], [F.col("level"), F.col("path")], "n")
    return placed.select("scan_id", "path", (F.col("n") - 1).alias("position"))


def module_bands(order: DataFrame, files: DataFrame) -> DataFrame:
    """``scan_id, module, start, length``: runs of files of one module along the order.

    Each file is joined to the one before it; where the module turns a new run begins, and a running count numbers the runs.
    """
    placed = order.join(files.select("scan_id", "path", "module"), ["scan_id", "path"]).select("scan_id", "position", "module")
    before = placed.select("scan_id", (F.col("position") + 1).alias("position"), F.col("module").alias("was"), F.lit(1).alias("has"))
    turns = placed.join(before, ["scan_id", "position"], "left").withColumn("turn", (F.col("has").isNull() | ~F.col("module").eqNullSafe(F.col("was"))).cast("long"))
    bands = running(turns.select("scan_id", "position", "module", "turn"), ["scan_id"], [F.col("position")], "turn", "band")
    return bands.groupBy("scan_id", "band", "module").agg(F.min("position").alias("start"), F.count("*").alias("length")).drop("band")


def back_edges(order: DataFrame, edges: DataFrame) -> DataFrame:
    """``scan_id, src, dst``: edges to a file that comes later in the order than the file that imports it."""
    at = lambda end: order.select("scan_id", F.col("path").alias(end), F.col("position").alias(f"{end}_at"))
    return edges.join(at("src"), ["scan_id", "src"]).join(at("dst"), ["scan_id", "dst"]).where("dst_at > src_at").select("scan_id", "src", "dst")
