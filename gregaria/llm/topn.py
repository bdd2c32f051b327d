"""Top N items within every group, by merging sorted runs with a loser tree.

Rows are cut into bounded runs, each sorted by group and score, and stored by
bucket of the group. A bucket's runs are merged with a loser tree, ``FAN_IN`` of a
level into one of the next; when a group has given N items, every run seeks to
its next group. A run itself keeps no more than the first N items of a group,
since only those can come out, so a group with millions of items adds N rows a
run to the shuffle and to one task. The number of buckets follows the number of
rows, so that of many groups each bucket holds a bounded share.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gregaria.sources.workers import on_workers

RUN_ROWS = 1 << 19
FAN_IN = 64
BUCKET_ROWS = 1 << 18

Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # groups, inverted scores, inverted ties: all ascending


def sorted_run(group: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> Run:
    """A run from rows in any order: repeated rows once, the first ``n`` of each group."""
    order = np.lexsort((tie, score, group))
    group, score, tie = group[order], score[order], tie[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (tie[1:] != tie[:-1])
    group, score, tie = group[fresh], score[fresh], tie[fresh]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    at = np.arange(len(group))
    kept = at - np.maximum.accumulate(np.where(first, at, 0)) < n
    return group[kept], score[kept], tie[kept]


class LoserTree:
    """The smallest head of several sorted runs, with a run's next head found in log(k) comparisons.

    Runs are tuples of equally long columns; only heads become Python values.
    """

    def __init__(self, runs: list[tuple]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads: list[tuple | None] = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)
        self.winner = self.losers[0] if self.k else -1

    def _head(self, i: int) -> tuple | None:
        at, run = self.at[i], self.runs[i]
        return tuple([column[at] for column in run]) if at < len(run[0]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _play(self, i: int) -> None:
        node, losers = (i + self.k) >> 1, self.losers
        while node:
            other = losers[node]
            if other < 0:  # the tree is being built: wait here for an opponent
                losers[node] = i
                return
            if self._before(other, i):
                losers[node], i = i, other
            node >>= 1
        losers[0] = i

    def advance(self, to: int) -> None:
        """The winner's run goes on at ``to``."""
        i = self.winner
        self.at[i] = to
        self.heads[i] = self._head(i)
        self._play(i)
        self.winner = self.losers[0]


def merge_runs(runs: list[Run], n: int) -> Run:
    """One run from many: the first ``n`` distinct items of each group."""
    if len(runs) == 1:
        return runs[0]
    ends = []  # of each item, where its run's next group starts
    for groups, _, _ in runs:
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(groups) else np.array([0])
        ends.append(memoryview(np.repeat(starts[1:], np.diff(starts))))
    tree = LoserTree([tuple(memoryview(np.ascontiguousarray(column)) for column in run) for run in runs])
    out = tuple(array("q") for _ in range(3))
    group, given, last = None, 0, None
    while (head := tree.heads[tree.winner]) is not None:
        at = tree.at[tree.winner]
        if head[0] != group:
            group, given, last = head[0], 0, None
        if given == n:
            tree.advance(ends[tree.winner][at])
            continue
        if head != last:
            for column, value in zip(out, head):
                column.append(value)
            given += 1
            last = head
        tree.advance(at + 1)
    return tuple(np.frombuffer(column, np.int64) if column else np.empty(0, np.int64) for column in out)


class Merge:
    """Runs of one bucket, merged as they come: ``FAN_IN`` of a level make one of the next, so a row is written once a level."""

    def __init__(self, n: int, fan_in: int = FAN_IN):
        self.n, self.fan_in, self.written = n, fan_in, 0
        self.levels: list[list[Run]] = []

    def add(self, run: Run, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            self.add(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []

    def _merged(self, runs: list[Run]) -> Run:
        if len(runs) == 1:
            return runs[0]
        run = merge_runs(runs, self.n)
        self.written += len(run[0])
        return run

    def result(self) -> Run:
        rest: list[Run] = []
        for level in self.levels:
            rest = [self._merged(rest + level)] if rest or level else []
        self.levels = []
        return rest[0]


def _bucket(group: np.ndarray, buckets: int) -> np.ndarray:
    mixed = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def top_n(rows: DataFrame, group: str, score: str, tie: str, n: int, run_rows: int = RUN_ROWS, buckets: int | None = None) -> DataFrame:
    """``group, rank_no, tie``: the ``n`` distinct items of each group with the highest score, then the highest tie.

    ``group`` and ``tie`` are bigint, ``score`` an integer or timestamp column;
    rows with a null in any of them are left out. Rows equal in all three count
    once. Groups with fewer items give fewer rows, an empty table none.
    """
    whole = rows.select(group, score, tie).where(f"`{group}` is not null and `{score}` is not null and `{tie}` is not null")
    buckets = buckets or max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole.count() // BUCKET_ROWS)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Run] = []
        size = 0

        def flush() -> pa.RecordBatch:
            run = sorted_run(*(np.concatenate(column) for column in zip(*held)), n)
            bucket = _bucket(run[0], buckets)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            parts = [[c[order][i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(order)])] for c in run]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=["bucket", "groups", "scores", "ties"])

        for batch in batches:
            columns = [batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)]
            held.append((columns[0], ~columns[1], ~columns[2]))  # inverted, so that ascending order is highest first
            size += batch.num_rows
            if size >= run_rows:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(merge: Merge) -> pa.RecordBatch:
            groups, _, ties = merge.result()
            at = np.arange(len(groups))
            first = np.r_[True, groups[1:] != groups[:-1]]
            rank = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
            return pa.RecordBatch.from_arrays([pa.array(groups), pa.array(rank), pa.array(~ties)], names=[group, "rank_no", tie])

        current, runs = None, None
        for batch in batches:
            for bucket, *parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != current:
                    if runs:
                        yield ranked(runs)
                    current, runs = bucket, Merge(n)
                runs.add(tuple(np.frombuffer(p, np.int64) for p in parts))
        if runs:
            yield ranked(runs)

    stored = on_workers(whole).mapInArrow(form, "bucket int, groups binary, scores binary, ties binary")
    return stored.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, f"`{group}` bigint, rank_no bigint, `{tie}` bigint")
