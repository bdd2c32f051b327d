"""Graph traversal: neighbourhoods, rings, closures and shortest paths.

A frontier is a table of ids. While it is short it becomes a filter on the edges
or is broadcast; beyond a checked bound it is joined, so the same code serves one
person's friends and a frontier of millions. Long levels of loops of unknown
length are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gregaria.operators.relational import Few
from gregaria.sources.scratch import Scratch


def neighbours(edges: DataFrame, frontier: Few) -> DataFrame:
    """Distinct ``id`` one step from ``frontier`` along ``edges`` (``p1, p2``)."""
    return frontier.semi(edges, "p1").select(F.col("p2").alias("id")).distinct()


def first_step(edges: DataFrame, root: int) -> DataFrame:
    """Distinct neighbours of one vertex but itself; the filter reaches the scan."""
    return edges.where((F.col("p1") == root) & (F.col("p2") != root)).select(F.col("p2").alias("id")).distinct()


def multihop(edges: DataFrame, root: int, hops: int) -> DataFrame:
    """Distinct ``id`` reached by a walk of 1 to ``hops`` steps from ``root``, without it."""
    step = reached = first_step(edges, root)
    for hop in range(hops - 1):
        frontier = Few.of(step)
        step = neighbours(edges, frontier).where(F.col("id") != root)
        reached = (reached if hop else frontier.rows).unionByName(step)
    return reached.distinct() if hops > 1 else reached


def bfs_levels(edges: DataFrame, root: int, levels: int) -> DataFrame:
    """``id, level`` of the vertices within ``levels`` steps, ``root`` left out."""
    step = Few.of(first_step(edges, root))
    seen = step.rows.withColumn("level", F.lit(1))
    for level in range(2, levels + 1):
        fresh = neighbours(edges, step).where(F.col("id") != root).join(seen.select("id"), "id", "left_anti")
        step = Few.of(fresh) if level < levels else Few(fresh, None)
        seen = seen.unionByName(step.rows.withColumn("level", F.lit(level)))
    return seen


def ring(edges: DataFrame, root: int, distance: int) -> DataFrame:
    """``id`` of the vertices at exactly that distance."""
    return bfs_levels(edges, root, distance).where(F.col("level") == distance).select("id")


def descend(children: DataFrame, roots: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``id`` of ``roots`` and all below them along ``children`` (``parent, id``), up to ``max_hops`` levels; safe on circles."""
    scratch = Scratch(children.sparkSession, "descend")
    seen = level = scratch.write(roots.select("id").distinct(), "0")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        below = children.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct().join(seen, "id", "left_anti")
        level = scratch.write(below, str(hop))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


class _Search:
    """Breadth-first search from both ends, the smaller frontier first. Levels beyond the bound of ``Few`` are written."""

    def __init__(self, edges: DataFrame, a: int, b: int, max_hops: int | None):
        spark = edges.sparkSession
        self.edges, self.scratch = edges, Scratch(spark, "search")
        self.levels = {end: [Few.of(spark.range(1).select(F.lit(v).cast("bigint").alias("id")))] for end, v in (("from", a), ("to", b))}
        self.length = -1
        sizes = {"from": 1, "to": 1}
        hops = 0
        while max_hops is None or hops < max_hops:
            hops += 1
            end, other = ("from", "to") if sizes["from"] <= sizes["to"] else ("to", "from")
            step = neighbours(edges, self.levels[end][-1])
            for level in self.levels[end]:
                step = step.join(level.rows, "id", "left_anti")
            step = self._level(step, f"{end}{len(self.levels[end])}")
            self.levels[end].append(step)
            sizes[end] = step.rows.count() if step.table is None else step.table.num_rows
            if not sizes[end]:
                return
            # the other side's last level is the only one that a new vertex can lie on
            if self._meet(step, self.levels[other][-1]):
                self.length = hops
                return

    def _level(self, rows: DataFrame, name: str) -> Few:
        few = Few.of(rows)
        return few if few.table is not None else Few(self.scratch.write(rows, name), None)

    def _meet(self, a: Few, b: Few) -> bool:
        if a.table is not None and b.table is not None:
            return not set(a.values("id")).isdisjoint(b.values("id"))
        return not b.semi(a.rows, "id").isEmpty()


def shortest_path(edges: DataFrame, a: int, b: int, max_hops: int | None = None) -> int:
    """Number of steps from ``a`` to ``b``, 0 if they are the same, -1 if there is no way (within ``max_hops``)."""
    return 0 if a == b else _Search(edges, a, b, max_hops).length


def all_shortest_paths(edges: DataFrame, a: int, b: int, max_hops: int | None = None) -> DataFrame:
    """``path, weight``: all shortest ways with the sum of ``edges.weight``; none if there is no way, ``[a]`` if ``a = b``.

    Before paths are spelled out the levels are pruned, from where the two
    searches met, to the vertices that lie on a shortest way; so the partial
    paths never outnumber the whole ones.
    """
    spark = edges.sparkSession
    if a == b:
        return spark.createDataFrame([([a], 0.0)], "path array<bigint>, weight double")
    search = _Search(edges, a, b, max_hops)
    if search.length < 0:
        return spark.createDataFrame([], "path array<bigint>, weight double")
    forward, backward = search.levels["from"], search.levels["to"]
    meet = len(forward) - 1
    on_way: dict[int, Few] = {meet: search._level(backward[-1].semi(forward[-1].rows, "id"), "meet")}
    for i in range(meet - 1, -1, -1):
        on_way[i] = search._level(forward[i].semi(neighbours(edges, on_way[i + 1]), "id"), f"way{i}")
    for i in range(meet + 1, search.length + 1):
        on_way[i] = search._level(backward[search.length - i].semi(neighbours(edges, on_way[i - 1]), "id"), f"way{i}")
    start = F.lit(a).cast("bigint")
    paths = spark.range(1).select(start.alias("last"), F.array(start).alias("path"), F.lit(0.0).alias("weight"))
    for i in range(1, search.length + 1):
        ways = on_way[i].semi(on_way[i - 1].semi(edges, "p1"), "p2").select("p1", "p2", F.col("weight").alias("step"))
        paths = paths.join(ways, F.col("last") == F.col("p1")).select(F.col("p2").alias("last"), F.array_append("path", F.col("p2")).alias("path"), (F.col("weight") + F.col("step")).alias("weight"))
    return paths.select("path", "weight")
