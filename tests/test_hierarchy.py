import random

import numpy as np
import pytest

from gregaria.operators.hierarchy import contract_core, descendants, resolve_forest, preorder


def brute(parent):
    out = {}
    for node in parent:
        path, at = [node], node
        while at in parent and len(path) <= len(parent) + 1:
            at = parent[at]
            path.append(at)
        out[node] = (at, len(path) - 1, path[::-1]) if at not in parent else (-1, -1, None)
    return out


def forest(n, seed, circles=True):
    r = random.Random(seed)
    parent = {}
    for v in range(1, n):
        style = r.random()
        if style < 0.05:
            continue
        parent[v] = r.randrange(v) if style < 0.5 else v - 1 if style < 0.9 else 0
    if circles:
        parent |= {n: n + 1, n + 1: n, n + 2: n, n + 3: n + 2, n + 4: n + 4, n + 5: n + 4, n + 6: n + 7, n + 7: n + 8, n + 8: n + 6}
    return parent


@pytest.mark.parametrize("core_rows", [0, 40, None])
@pytest.mark.parametrize("with_path", [False, True])
def test_forest_as_by_brute_force(spark, core_rows, with_path):
    parent = forest(300, core_rows or 1)
    edges = spark.createDataFrame([("t", k, v) for k, v in parent.items()], "tree string, node bigint, parent bigint")
    out = resolve_forest(edges, with_path=with_path, core_rows=core_rows).nodes
    found = {r.node: (r.root, r.depth, r.path if with_path else None) for r in out.collect()}
    expected = brute(parent)
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in expected.items()}
    if with_path:
        assert {k: v[2] for k, v in found.items()} == {k: v[2] for k, v in expected.items()}
        pairs = {(r.ancestor, r.node, r.distance) for r in descendants(out).collect()}
        assert pairs == {(a, k, len(p) - 1 - i) for k, (_, _, p) in expected.items() if p for i, a in enumerate(p[:-1])}


def test_long_chain_takes_few_rounds(spark):
    edges = spark.range(1, 3001).selectExpr("'t' as tree", "id as node", "id - 1 as parent")
    out = resolve_forest(edges, core_rows=200)
    assert out.nodes.where("root = 0 and depth = node").count() == 3000


def test_trees_do_not_mix_and_extra_columns_do_no_harm(spark, rows):
    edges = spark.createDataFrame([("a", 1, 2, "x"), ("b", 2, 1, "x"), ("b", 1, 9, "x")], "tree string, node bigint, parent bigint, fate string")
    assert rows(resolve_forest(edges).nodes) == [("a", 1, 2, 1), ("b", 1, 9, 1), ("b", 2, 9, 2)]


@pytest.mark.parametrize("core_rows", [0, 100])
def test_repeated_rows_nulls_and_several_parents(spark, rows, core_rows):
    edges = [("t", 1, 2), ("t", 1, 2), ("t", 2, 3), ("t", 3, 9), ("t", 3, 4), (None, 5, 6), ("t", None, 6), ("t", 6, None)]
    df = spark.createDataFrame(edges, "tree string, node bigint, parent bigint")
    assert rows(resolve_forest(df, core_rows=core_rows).nodes) == [("t", 1, 9, 3), ("t", 2, 9, 2), ("t", 3, 9, 1)]


def test_star_and_empty(spark):
    star = spark.range(1, 5001).selectExpr("'t' as tree", "id as node", "0L as parent")
    assert resolve_forest(star, core_rows=0).nodes.where("root = 0 and depth = 1").count() == 5000
    assert resolve_forest(star.limit(0)).nodes.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_core(seed):
    parent = forest(500, seed, circles=seed % 2 == 0)
    names = sorted(set(parent) | set(parent.values()))
    at = {v: i for i, v in enumerate(names)}
    array = np.array([at[parent[v]] if v in parent else -1 for v in names])
    root, depth = contract_core(array, np.ones(len(names), int))
    for node, (top, far, _) in brute(parent).items():
        assert (names[root[at[node]]] if root[at[node]] >= 0 else -1, depth[at[node]]) == (top, far)


def test_workers_find_the_package_wherever_the_driver_runs(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from gregaria.session import local_session
from gregaria.operators.hierarchy import resolve_forest, preorder
spark = local_session(2, "elsewhere")
edges = spark.createDataFrame([("t", 1, 2)], "tree string, node bigint, parent bigint")
print("ROWS", resolve_forest(edges).nodes.collect())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS [Row(tree='t', node=1, root=2, depth=1)]" in out.stdout, out.stderr[-2000:]


def brute_intervals(edges):
    parents = {}
    for tree, node, parent in edges:
        if None not in (tree, node, parent):
            parents[tree, node] = max(parent, parents.get((tree, node), parent))
    children = {}
    for (tree, node), parent in parents.items():
        children.setdefault((tree, parent), []).append(node)
    out, clock = [], 0

    def walk(tree, root, node):
        nonlocal clock
        enter, clock = clock, clock + 1
        for child in sorted(children.get((tree, node), [])):
            walk(tree, root, child)
        out.append((tree, node, root, enter, clock))
        clock += 1

    for tree, parent in list(children):
        if (tree, parent) not in parents:
            clock = 0
            walk(tree, parent, parent)
    return sorted(out)


@pytest.mark.parametrize("core_rows", [0, 200_000])
def test_intervals_as_by_brute_force(spark, core_rows):
    r = random.Random(core_rows)
    edges = [("a", i, r.choice([0] * 8 + list(range(i)))) for i in range(1, 120)] + [("b", i, i - 1) for i in range(-5, 40)]
    edges += [("c", 1, 2), ("c", 2, 1), ("c", 3, 2), ("c", 4, 4), ("b", 100, 7), ("b", 100, 5), ("b", 100, 7), (None, 1, 2), ("a", None, 1), ("a", 500, None), ("d", -9, -3)]
    df = spark.createDataFrame([(*e, "x") for e in edges], "tree string, node bigint, parent bigint, enter string").repartition(5)
    found = sorted(tuple(x) for x in preorder(df, core_rows=core_rows).nodes.collect())
    assert found == brute_intervals(edges)
    assert preorder(df.limit(0)).nodes.count() == 0
