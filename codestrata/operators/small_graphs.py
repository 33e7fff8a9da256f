"""Graph work inside tasks: a scan's graph of bounded size is gathered into one row and walked there; larger ones are not gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.cycles import TASK_EDGES, components_of
from codestrata.session import cut, frame_stage, spread, stage

#: Result rows that a task hands on at once.
ROWS = 100_000


def by_size(edges: DataFrame, nodes: DataFrame, most: int = TASK_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """Each graph of up to ``most`` edges and nodes as one row ``scan_id, src, dst, nodes``, and the ``scan_id`` of larger ones (None if there are none).

    ``edges`` has ``scan_id, src, dst``, ``nodes`` has ``scan_id, node``.
    """
    empty = F.lit(None).cast("string")
    rows = stage(edges.select("scan_id", "src", "dst").distinct().unionByName(nodes.select("scan_id", F.col("node").alias("src"), empty.alias("dst")).distinct()))
    large = cut(rows.groupBy("scan_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("scan_id"))
    some = large.limit(1).count() > 0
    if some:
        rows = rows.join(large, "scan_id", "left_anti")
    gathered = spread(rows, "scan_id", shuffled=True).groupBy("scan_id").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    linked, alone = F.filter("e", lambda x: x["dst"].isNotNull()), F.filter("e", lambda x: x["dst"].isNull())
    return gathered.select("scan_id", F.transform(linked, lambda x: x["src"]).alias("src"), F.transform(linked, lambda x: x["dst"]).alias("dst"), F.transform(alone, lambda x: x["src"]).alias("nodes")), large if some else None


def solved(graphs: DataFrame, work: Callable[[list, list, list], Iterator[tuple]], columns: str) -> DataFrame:
    """Rows ``scan_id`` and ``columns`` that ``work(src, dst, nodes)`` yields for each graph."""
    kind = graphs.schema["scan_id"].dataType.simpleString()
    names = ["scan_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for scan, src, dst, nodes in zip(*(pdf[c] for c in ("scan_id", "src", "dst", "nodes"))):
                for row in work(list(src), list(dst), list(nodes)):
                    rows.append((scan, *row))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return graphs.mapInPandas(frame_stage(run), f"scan_id {kind}, {columns}")


def _steps(src: list, dst: list) -> dict:
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    return out


def reached(steps: dict, seeds: list) -> set:
    """Everything that the seeds lead to, themselves included."""
    seen, todo = set(seeds), list(seeds)
    while todo:
        for nxt in steps.get(todo.pop(), ()):
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return seen


def reach_each(src: list, dst: list, seeds: list) -> Iterator[tuple]:
    steps = _steps(src, dst)
    for seed in seeds:
        for node in reached(steps, [seed]):
            if node != seed:
                yield seed, node


def reach_all(src: list, dst: list, seeds: list) -> Iterator[tuple]:
    for node in reached(_steps(src, dst), seeds) - set(seeds):
        yield (node,)


def levels_of(src: list, dst: list, nodes: list) -> Iterator[tuple]:
    """``(node, level)``: one above the highest of what a node depends on; members of a cycle are one."""
    unit = {node: members[0] for members in components_of(src, dst) for node in members}
    waits: dict = {}
    back: dict = {}
    for a, b in {(unit.get(a, a), unit.get(b, b)) for a, b in zip(src, dst)}:
        if a != b:
            waits[a] = waits.get(a, 0) + 1
            back.setdefault(b, []).append(a)
    level = {u: 0 for u in {unit.get(n, n) for n in nodes} if u not in waits}
    todo = list(level)
    while todo:
        node = todo.pop()
        for above in back.get(node, ()):
            level[above] = max(level.get(above, 0), level[node] + 1)
            waits[above] -= 1
            if not waits[above]:
                todo.append(above)
    for node in nodes:
        yield node, level[unit.get(node, node)]


def least_cycles(src: list, dst: list, nodes: list) -> Iterator[tuple]:
    """``(component, chain)``: the shortest closed walk through the least member of each cycle group, the least of these."""
    steps = _steps(src, dst)
    for members in components_of(src, dst):
        inside, first = set(members), members[0]
        front, met, chain = {first: (first,)}, {first}, None
        while chain is None:
            walks: dict = {}
            for node, walk in front.items():
                for nxt in steps[node]:
                    if nxt in inside and (nxt not in walks or walk + (nxt,) < walks[nxt]):
                        walks[nxt] = walk + (nxt,)
            chain = walks.get(first)
            front = {node: walk for node, walk in walks.items() if node not in met}
            met.update(front)
        yield first, list(chain)
