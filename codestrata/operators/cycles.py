"""Strongly connected components ("cycle groups") of many graphs at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut, frame_stage, spread, stage

#: Graphs of up to so many edges are solved inside one task (about 30 MB of strings); larger ones by label propagation over DataFrames.
TASK_EDGES = 200_000


def components_of(src: Iterable, dst: Iterable) -> list[list]:
    """Components of two or more nodes of one small graph, by an iterative depth-first search with low links."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    found: list[list] = []
    index: dict = {}
    low: dict = {}
    open_nodes: list = []
    is_open: set = set()
    for root in out:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        open_nodes.append(root)
        is_open.add(root)
        trail = [(root, iter(out[root]))]
        while trail:
            node, rest = trail[-1]
            for nxt in rest:
                if nxt not in out:
                    continue  # a node without outgoing edges is on no cycle
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    open_nodes.append(nxt)
                    is_open.add(nxt)
                    trail.append((nxt, iter(out[nxt])))
                    break
                if nxt in is_open:
                    low[node] = min(low[node], index[nxt])
            else:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == index[node]:
                    at = open_nodes.index(node) if len(open_nodes) < 8 else len(open_nodes) - 1 - open_nodes[::-1].index(node)
                    members = open_nodes[at:]
                    del open_nodes[at:]
                    is_open.difference_update(members)
                    if len(members) > 1:
                        found.append(sorted(members))
    return found


@frame_stage
def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        graphs, nodes, groups, sizes = [], [], [], []
        for g, src, dst in zip(pdf["graph"], pdf["src"], pdf["dst"]):
            for members in components_of(src, dst):
                graphs += [g] * len(members)
                nodes += members
                groups += [members[0]] * len(members)
                sizes += [len(members)] * len(members)
        yield pd.DataFrame({"graph": graphs, "node": nodes, "component": groups, "size": sizes})


def _trim(edges: DataFrame, rounds: int) -> DataFrame:
    """Drop edges whose source has no incoming or whose target has no outgoing edge; such edges are on no cycle."""
    for _ in range(rounds):
        edges = edges.join(edges.select("graph", F.col("src").alias("dst")).distinct(), ["graph", "dst"], "left_semi")
        edges = edges.join(edges.select("graph", F.col("dst").alias("src")).distinct(), ["graph", "src"], "left_semi")
        edges = edges.select("graph", "src", "dst")
    return edges


def _spread_min(edges: DataFrame, labels: DataFrame, flip: bool) -> DataFrame:
    """Fixpoint: each node takes the least label that reaches it along the edges (against them with ``flip``)."""
    a, b = ("dst", "src") if flip else ("src", "dst")
    changed = 1
    while changed:
        offered = edges.select("graph", F.col(a).alias("node"), F.col(b).alias("to")).join(labels, ["graph", "node"]).groupBy("graph", F.col("to").alias("node")).agg(F.min("label").alias("offer"))
        joined = cut(labels.join(offered, ["graph", "node"], "left").select("graph", "node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        changed = joined.where("moved").limit(1).count()
        labels = joined.drop("moved")
    return labels


def large_components(edges: DataFrame) -> DataFrame:
    """Components by trimming, forward colours and backward reach inside each colour, for graphs too large for one task.

    In each round every node gets the least node that reaches it (its colour); the nodes of a colour that reach the
    colour's own node form one component, leave the graph, and the rest goes on. Same result as the in-task search.
    """
    done = None
    edges = cut(_trim(edges.select("graph", "src", "dst").where("src <> dst").distinct(), 2))
    while edges.limit(1).count():
        nodes = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread_min(edges, nodes.withColumn("label", F.col("node")), flip=False)
        inside = cut(
            edges.join(colours.select("graph", F.col("node").alias("src"), F.col("label").alias("c1")), ["graph", "src"])
            .join(colours.select("graph", F.col("node").alias("dst"), F.col("label").alias("c2")), ["graph", "dst"])
            .where("c1 = c2")
            .select("graph", "src", "dst", F.col("c1").alias("colour"))
        )
        reached = cut(colours.where("node = label").select("graph", "node"))
        new = reached
        while new.limit(1).count():
            back = inside.join(new.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi").select("graph", F.col("src").alias("node")).distinct()
            new = cut(back.join(reached, ["graph", "node"], "left_anti"))
            reached = cut(reached.unionByName(new))
        part = colours.join(reached, ["graph", "node"], "left_semi").select("graph", "node", F.col("label").alias("component"))
        done = part if done is None else done.unionByName(part)
        edges = edges.join(part.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_anti")
        edges = edges.join(part.select("graph", F.col("node").alias("dst")), ["graph", "dst"], "left_anti")
        edges = cut(_trim(edges.select("graph", "src", "dst"), 1))
    if done is None:
        return edges.select("graph", F.col("src").alias("node"), F.col("dst").alias("component"), F.lit(0).cast("long").alias("size"))
    sizes = done.groupBy("graph", "component").agg(F.count("*").alias("size"))
    return done.join(sizes, ["graph", "component"]).where("size > 1").select("graph", "node", "component", "size")


def cycle_groups(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Members of every component of two or more nodes.

    In: ``graph`` (any key), ``src``, ``dst`` (both of one type, text or whole numbers); nulls and self edges are ignored, repeats count once.
    Out: ``graph, node, component`` (least member) ``, size``. Empty input gives no rows.
    Graphs with more than ``task_edges`` edges are never gathered into one task.
    """
    kind, node = (edges.schema[c].dataType.simpleString() for c in ("graph", "src"))
    schema = f"graph {kind}, node {node}, component {node}, size long"
    clean = stage(edges.select("graph", "src", "dst").where("src <> dst").distinct())
    counts = clean.groupBy("graph").agg(F.count("*").alias("n"))
    big = cut(counts.where(F.col("n") > task_edges).select("graph"))
    small = clean
    if big.limit(1).count():
        small = clean.join(big, "graph", "left_anti")
    # graphs are small here, so they are spread by number before they are gathered
    gathered = spread(small, "graph", shuffled=True).groupBy("graph").agg(F.collect_list(F.struct("src", "dst")).alias("e")).select("graph", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    solved = gathered.mapInPandas(_solve, schema)
    if not big.limit(1).count():
        return solved
    return solved.unionByName(large_components(clean.join(big, "graph", "left_semi")))
