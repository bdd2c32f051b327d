import random

import numpy as np
import pytest

from gregaria.llm.topn import LoserTree, Merge, merge_runs, sorted_run, top_n


def brute(rows, n):
    out = []
    groups = {r[0] for r in rows if None not in r}
    for g in groups:
        items = sorted({r for r in rows if r[0] == g and None not in r}, key=lambda r: (-r[1], -r[2]))
        out += [(g, i, r[2]) for i, r in enumerate(items[:n], 1)]
    return sorted(out)


def table(k, seed):
    r = random.Random(seed)
    rows = [(r.choice([1] * 20 + list(range(-5, 40))), r.choice([None, *range(6)]), r.randrange(200)) for _ in range(k)]
    return rows + rows[: k // 4] + [(None, 1, 1), (3, 1, None)]


@pytest.mark.parametrize(("n", "run_rows", "buckets"), [(5, 1 << 19, None), (3, 60, 4), (1, 10, 1), (500, 100, 7)])
def test_as_by_brute_force(spark, n, run_rows, buckets):
    rows = table(1500, n)
    df = spark.createDataFrame([(*r, "x") for r in rows], "g bigint, s bigint, t bigint, rank_no string").repartition(9)
    out = top_n(df, "g", "s", "t", n, run_rows=run_rows, buckets=buckets)
    assert out.columns == ["g", "rank_no", "t"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, n)


def test_times_and_empty(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, day, 1), (1, day, 2), (1, None, 3), (1, day + datetime.timedelta(1), 0)], "g bigint, s timestamp_ntz, t bigint")
    assert [tuple(r) for r in top_n(df, "g", "s", "t", 2).collect()] == [(1, 1, 0), (1, 2, 2)]
    assert top_n(df.limit(0), "g", "s", "t", 2).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    r = random.Random(k)
    lists = [sorted((r.randrange(50), i) for _ in range(r.randrange(30))) for i in range(k)]
    tree, out = LoserTree([tuple(zip(*one)) or ((), ()) for one in lists]), []
    while (head := tree.heads[tree.winner]) is not None:
        out.append(head)
        tree.advance(tree.at[tree.winner] + 1)
    assert out == sorted(x for one in lists for x in one)


def test_merged_runs_keep_n_of_each_group():
    r = np.random.default_rng(2)
    columns = [(r.integers(0, 9, 400), r.integers(0, 5, 400), r.integers(0, 90, 400)) for _ in range(70)]
    merged = merge_runs([sorted_run(*c, 4) for c in columns], 4)
    whole = sorted_run(*(np.concatenate([c[i] for c in columns]) for i in range(3)), 4)
    assert all((a == b).all() for a, b in zip(merged, whole))


def test_a_row_is_written_once_a_level():
    """4,096 runs of a million groups: two levels of 64, and no more."""
    r = np.random.default_rng(4)
    merge, rows, groups = Merge(5), 0, set()
    for _ in range(4096):
        run = sorted_run(r.integers(0, 1_000_000, 64), r.integers(0, 9, 64), r.integers(0, 10**9, 64), 5)
        rows += len(run[0])
        groups |= set(run[0].tolist())
        merge.add(run)
    assert set(merge.result()[0].tolist()) == groups
    assert merge.written <= 2 * rows + len(groups)


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_levels_as_one_merge(fan_in):
    r = np.random.default_rng(8)
    columns = [(r.integers(0, 40, 90), r.integers(0, 5, 90), r.integers(0, 90, 90)) for _ in range(37)]
    merge = Merge(3, fan_in)
    for c in columns:
        merge.add(sorted_run(*c, 3))
    whole = sorted_run(*(np.concatenate([c[i] for c in columns]) for i in range(3)), 3)
    assert all((a == b).all() for a, b in zip(merge.result(), whole))
