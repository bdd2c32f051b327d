"""Parent-child links to full hierarchies, by tree contraction.

Each round rakes all leaves and splices out an independent set of nodes on
unary chains, recording every removal with the ancestor it hung from and the
distance to it. The recorded rounds are then undone in reverse, which gives
each node its root and depth. A core that contracts to nodes that are their own
parent is a circle; its nodes and all that hang below have root and depth -1.

The number of rounds grows with the logarithm of the longest chain, not with
its length. Each round reads what the round before left, so all rounds together
cost a small multiple of the first. Once the remaining core is of a size fit
for one task (``core_rows``, a parameter), the same contraction is carried
through there in memory; with ``core_rows=0`` all rounds are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gregaria.operators.skew import skew_join
from gregaria.sources.scratch import Scratch
from gregaria.sources.workers import on_workers

HOT_SHARE = 1 / 64
CORE_ROWS = 200_000
CORE_ROWS_WITH_PATH = 20_000
RAKED, SPLICED, KEPT, CIRCLE = 0, 1, 2, 3


def _rank(name: str, turn: int):
    """A random order of the nodes, new in each round, that every task computes alike."""
    return F.xxhash64("tree", name, F.lit(turn))


def _contract(edges: DataFrame, turn: int, with_path: bool) -> DataFrame:
    """One round: ``tree, node, parent, steps, via, fate`` for every edge.

    A node on a chain is spliced if its rank beats its child's and its
    parent's, so no two neighbours are spliced in one round and every recorded
    parent outlives the round.
    """
    via = F.col("via") if with_path else F.lit(None).cast("array<bigint>")
    none = F.lit(None).cast("bigint")
    up = edges.select("tree", "node", F.col("parent").alias("up"), F.col("steps").alias("up_steps"), via.alias("up_via"), F.lit(0).alias("n"), none.alias("child"))
    down = edges.select("tree", F.col("parent").alias("node"), none.alias("up"), none.cast("int").alias("up_steps"), F.lit(None).cast("array<bigint>").alias("up_via"), F.lit(1).alias("n"), F.col("node").alias("child"))
    extra = [F.max("up_via").alias("up_via")] if with_path else []
    seen = (
        up.unionByName(down)
        .groupBy("tree", "node")
        .agg(F.max("up").alias("up"), F.max("up_steps").alias("up_steps"), F.sum("n").alias("children"), F.max("child").alias("child"), *extra)
        .where("up is not null")
    )
    on_chain = (F.col("children") == 1) & (F.col("up") != F.col("node"))
    seen = seen.withColumn("spliced", on_chain & (_rank("node", turn) > _rank("child", turn)) & (_rank("node", turn) > _rank("up", turn)))
    over = seen.where("spliced").select(
        "tree", F.col("child").alias("node"), F.col("up").alias("over"), F.col("up_steps").alias("over_steps"),
        *([F.concat("up_via", F.array("node")).alias("over_via")] if with_path else []),
    )
    joined = seen.join(over, ["tree", "node"], "left")
    fate = (
        F.when(F.col("up") == F.col("node"), CIRCLE)
        .when(F.col("children") == 0, RAKED)
        .when(F.col("spliced"), SPLICED)
        .otherwise(KEPT)
    )
    return joined.select(
        "tree", "node",
        F.coalesce("over", "up").alias("parent"),
        (F.col("up_steps") + F.coalesce("over_steps", F.lit(0))).alias("steps"),
        *([F.concat(F.coalesce("over_via", F.array().cast("array<bigint>")), "up_via").alias("via")] if with_path else []),
        fate.alias("fate"),
    )


def contract_core(parent: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots and depths of a forest held in arrays, by the same contraction.

    ``parent[i]`` is the index of i's parent, -1 at a root. Returns the index of
    the root and the depth, both -1 on or below a circle.
    """
    n = len(parent)
    parent, steps = parent.astype(np.int64).copy(), steps.astype(np.int64).copy()
    alive = parent >= 0
    circles = np.zeros(n, bool)
    records: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    random = np.random.default_rng(n)
    while True:
        loops = alive & (parent == np.arange(n))
        circles |= loops
        alive &= ~loops
        nodes = np.flatnonzero(alive)
        if not len(nodes):
            break
        children = np.bincount(parent[nodes], minlength=n)
        child = np.full(n, -1)
        child[parent[nodes]] = nodes
        rank = random.permutation(n)
        chain = nodes[(children[nodes] == 1)]
        spliced = chain[(rank[chain] > rank[child[chain]]) & (rank[chain] > rank[parent[chain]])]
        under = child[spliced]
        records.append((spliced, parent[spliced], steps[spliced]))
        steps[under] += steps[spliced]
        parent[under] = parent[spliced]
        raked = nodes[children[nodes] == 0]
        records.append((raked, parent[raked], steps[raked]))
        alive[spliced] = False
        alive[raked] = False
    root, depth = np.arange(n), np.zeros(n, np.int64)
    root[circles] = depth[circles] = -1
    for node, above, far in reversed(records):
        root[node] = root[above]
        depth[node] = np.where(root[above] < 0, -1, depth[above] + far)
    return root, depth


def _resolve_core(edges: DataFrame, with_path: bool) -> DataFrame:
    """The remaining core in one task; its size was checked by the caller."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        core = pd.concat(parts, ignore_index=True)
        for tree, part in core.groupby("tree", sort=False):
            node, above = part["node"].to_numpy(), part["parent"].to_numpy()
            names, at = np.unique(np.concatenate([node, above]), return_inverse=True)
            parent, steps = np.full(len(names), -1), np.zeros(len(names), np.int64)
            parent[at[: len(node)]] = at[len(node) :]
            steps[at[: len(node)]] = part["steps"].to_numpy()
            root, depth = contract_core(parent, steps)
            own = at[: len(node)]
            out = pd.DataFrame({"tree": tree, "node": node, "root": np.where(root[own] < 0, -1, names[root[own]]), "depth": depth[own].astype(np.int32)})
            if with_path:
                out["path"] = _core_paths(node, above, part["via"], out["root"].to_numpy(), out["depth"].to_numpy())
            yield out

    kind = edges.schema["tree"].dataType.simpleString()
    schema = f"tree {kind}, node bigint, root bigint, depth int" + (", path array<bigint>" if with_path else "")
    return on_workers(edges.coalesce(1)).mapInPandas(run, schema)


def _core_paths(node, above, via, root, depth) -> list:
    paths: dict[int, list[int]] = {}
    out: list = [None] * len(node)
    for i in np.argsort(depth, kind="stable"):
        if root[i] >= 0 or depth[i] >= 0:
            out[i] = paths[node[i]] = [*paths.get(above[i], [int(above[i])]), *(int(v) for v in via.iloc[i]), int(node[i])]
    return out


@dataclass
class Forest:
    """``nodes``: ``tree, node, root, depth`` (and ``path``) of every node that has a parent; scratch holds what it reads."""

    nodes: DataFrame
    scratch: Scratch


def resolve_forest(edges: DataFrame, with_path: bool = False, core_rows: int | None = None) -> Forest:
    """Root and depth, and if wanted the path from the root, of every node with a parent.

    ``edges``: ``tree, node, parent`` and any other columns. Rows with a null
    in one of the three are left out, repeated ones count once, and of several
    parents of a node the largest counts. A node named only as a parent is a
    root and gets no row. Nodes on or below a circle get root and depth -1 and
    a null path. An empty input gives no rows.
    """
    if core_rows is None:
        core_rows = CORE_ROWS_WITH_PATH if with_path else CORE_ROWS
    scratch = Scratch(edges.sparkSession, "forest")
    single = edges.where("tree is not null and node is not null and parent is not null").groupBy("tree", "node").agg(F.max("parent").alias("parent"))
    start = single.select("tree", "node", "parent", F.lit(1).alias("steps"), *([F.array().cast("array<bigint>").alias("via")] if with_path else []))
    current = scratch.write(start, "edges")
    left = current.count()
    rounds: list[DataFrame] = []
    circles: list[DataFrame] = []
    while left > core_rows:
        table = scratch.write(_contract(current, len(rounds), with_path), f"round{len(rounds)}", partition_by="fate")
        rounds.append(table.where(F.col("fate").isin(RAKED, SPLICED)))
        circles.append(table.where(F.col("fate") == CIRCLE))
        current = table.where(F.col("fate") == KEPT)
        left = current.count()
        if len(rounds) == 1:
            scratch.drop("edges")

    known = _resolve_core(current.drop("fate"), with_path)
    if circles:
        known = _with_circles(known, reduce(DataFrame.unionByName, circles), with_path)
    for turn in reversed(range(len(rounds))):
        known = scratch.write(known, f"known{turn}")
        known = known.unionByName(_expand(rounds[turn], known, with_path))
    return Forest(known, scratch)


def _with_circles(core: DataFrame, loops: DataFrame, with_path: bool) -> DataFrame:
    """The resolved core and the circles that earlier rounds took out, which the core took for roots."""
    gone = loops.select("tree", F.col("node").alias("root"), F.lit(-1).alias("on_circle"))
    marked = core.join(gone, ["tree", "root"], "left")
    path = [F.when(F.col("on_circle").isNull(), F.col("path")).alias("path")] if with_path else []
    core = marked.select("tree", "node", F.coalesce(F.col("on_circle").cast("bigint"), "root").alias("root"), F.coalesce("on_circle", "depth").alias("depth"), *path)
    none = [F.lit(None).cast("array<bigint>").alias("path")] if with_path else []
    return core.unionByName(loops.select("tree", "node", F.lit(-1).cast("bigint").alias("root"), F.lit(-1).alias("depth"), *none))


def _expand(removed: DataFrame, known: DataFrame, with_path: bool) -> DataFrame:
    """Nodes removed in one round, resolved from the parents that outlived it; a parent without a row is a root, and one with a large share of the children no bottleneck."""
    above = known.select("tree", F.col("node").alias("parent"), "root", F.col("depth").alias("above"), *(["path"] if with_path else []))
    joined = skew_join(removed, above, ["tree", "parent"], HOT_SHARE)
    depth = F.when(F.col("above") < 0, F.lit(-1)).otherwise(F.coalesce("above", F.lit(0)) + F.col("steps"))
    path = F.concat(F.when(F.col("root").isNull(), F.array("parent")).otherwise(F.col("path")), "via", F.array("node"))
    return joined.select("tree", "node", F.coalesce("root", "parent").alias("root"), depth.alias("depth"), *([path.alias("path")] if with_path else []))


def preorder(edges: DataFrame, **limits: int) -> Forest:
    """``tree, node, root, enter, leave`` of every node of the trees, roots too: the descendants of a node are those entered between.

    All descendants thus take one row a node, not one a pair. The tour that goes
    down to a node's first child, on to its next sibling and up after the last is a
    chain of two elements a node; its contraction (``resolve_forest``) gives each
    its place. ``enter`` counts from 0 in each tree, ``leave - enter`` is twice the
    number of descendants plus 1; children come in order of their ids. Nodes on or
    below a circle get no row. ``edges`` are as for ``resolve_forest``; ids must
    lie below 2^62. Children are ordered in ranges, so a parent may have any number.
    """
    scratch = Scratch(edges.sparkSession, "preorder")
    single = edges.where("tree is not null and node is not null and parent is not null").groupBy("tree", "node").agg(F.max("parent").alias("parent"))
    links = scratch.write(single, "links")
    forest = resolve_forest(links, **limits)
    sound = links.join(forest.nodes.where("depth > 0").select("tree", "node"), ["tree", "node"], "left_semi")
    order = ["tree", "parent", "node"]
    ranges = scratch.write(sound.select(*order).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    ends = ranges.groupBy("range").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).orderBy("range").collect()  # a row a partition
    kind = ranges.schema["tree"].dataType.simpleString()
    around = [
        (r["range"], tuple(ends[i + 1]["first"]) if i + 1 < len(ends) else None, tuple(ends[i - 1]["last"]) if i else None) for i, r in enumerate(ends)
    ]
    row = f"struct<tree:{kind},parent:bigint,node:bigint>"
    around = F.broadcast(edges.sparkSession.createDataFrame(around, f"range int, following {row}, previous {row}"))
    window = W.partitionBy("range").orderBy(*order)
    beside = ranges.withColumns({"next": F.lead(F.struct(*order)).over(window), "before": F.lag(F.struct(*order)).over(window)}).join(around, "range", "left")
    beside = beside.withColumns({"next": F.coalesce("next", "following"), "before": F.coalesce("before", "previous")})
    same = lambda other: F.coalesce((F.col(f"{other}.tree") == F.col("tree")) & (F.col(f"{other}.parent") == F.col("parent")), F.lit(False))
    beside = scratch.write(beside.select(*order, F.when(same("next"), F.col("next.node")).alias("sibling"), (~same("before")).alias("is_first")), "beside")
    down, up = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    leaves = beside.select("tree", "node").join(beside.where("is_first").select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    tour = [
        beside.select("tree", up("node").alias("node"), F.coalesce(down("sibling"), up("parent")).alias("parent")),
        beside.where("is_first").select("tree", down("parent").alias("node"), down("node").alias("parent")),
        leaves.select("tree", down("node").alias("node"), up("node").alias("parent")),
    ]
    places = resolve_forest(reduce(DataFrame.unionByName, tour), **limits)
    is_down = F.pmod("node", F.lit(2)) == 0
    spans = (
        places.nodes.groupBy("tree", F.shiftright("node", 1).alias("node"))
        .agg(F.max("root").alias("root"), F.max(F.when(is_down, F.col("depth"))).alias("from_end"), F.coalesce(F.max(F.when(~is_down, F.col("depth"))), F.lit(0)).alias("after"))
        .withColumn("root", F.shiftright("root", 1))
    )
    spans = scratch.write(spans, "spans")
    whole = spans.where("node = root").select("tree", "root", F.col("from_end").alias("whole"))
    placed = skew_join(spans, whole, ["tree", "root"], HOT_SHARE)
    return Forest(placed.select("tree", "node", "root", (F.col("whole") - F.col("from_end")).alias("enter"), (F.col("whole") - F.col("after")).alias("leave")), scratch)


def descendants(nodes: DataFrame) -> DataFrame:
    """``tree, ancestor, node, distance`` for every proper ancestor of every node, from resolved paths."""
    return nodes.where("path is not null").select(
        "tree", "node", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor"), "depth"
    ).select("tree", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
