"""Relational idioms shared by the reads."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEW_ROWS = 100_000  # rows of keys and numbers that may be held by the driver and sent to every task
FEW_LITERALS = 1000


class Few:
    """Rows of which there may be few.

    Up to ``FEW_ROWS`` are held as literals: other tables then meet them by a
    filter at the scan or by broadcast, and no large table is shuffled for them.
    Beyond that bound ``rows`` stays the plan it was and joins are ordinary ones.
    """

    def __init__(self, rows: DataFrame, table: pa.Table | None):
        self.rows, self.table = rows, table

    @classmethod
    def of(cls, rows: DataFrame, bound: int | None = None) -> Few:
        bound = FEW_ROWS if bound is None else bound
        table = rows.limit(bound + 1).toArrow()
        if table.num_rows > bound:
            return cls(rows, None)
        return cls(F.broadcast(rows.sparkSession.createDataFrame(table, rows.schema)), table)

    def values(self, column: str) -> list | None:
        """Distinct values but null, if they are held."""
        return None if self.table is None else sorted(set(self.table.column(column).drop_null().to_pylist()))

    def semi(self, other: DataFrame, on: str, column: str = "id") -> DataFrame:
        """The rows of ``other`` whose ``on`` is among the values of ``column``; null is not."""
        values = self.values(column)
        if values is not None and len(values) <= FEW_LITERALS:
            return other.where(F.col(on).isin(values)) if values else other.where(F.lit(False))
        keys = self.rows.select(F.col(column).alias(on)).distinct()
        return other.join(keys if values is None else F.broadcast(keys), on, "left_semi")



def top_k(rows: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of a total order; all, sorted, for None, and none for 0.

    With a limit this is a bounded heap in each task and one merge, no full sort.
    """
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(max(0, limit))


def with_rank(rows: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """``top_k`` with the order as a column ``rank`` from 1, if there is a limit (so few rows in one task), in that order."""
    top = top_k(rows, order, limit)
    if limit is None:
        return top
    return in_order(top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint")), [F.col("rank")], limit)


def first_few(rows: DataFrame, order: Sequence[Column], limit: int | None) -> Few:
    """``with_rank``, held as literals if there is a limit of a size for that."""
    top = with_rank(rows, order, limit)
    return Few(top, None) if limit is None else Few.of(top)


def in_order(rows: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Sorted rows; where a limit bounds their number by a heap in each task and one merge."""
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(max(0, limit))


def arg_max(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; a group limit runs before the shuffle, so a hot group sends one row a task."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(window)).where("_turn = 1").drop("_turn")


def semi(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def anti(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def mark(rows: DataFrame, keys: DataFrame, on: str | list[str], name: str) -> DataFrame:
    """``rows`` with a boolean column: whether the key is in ``keys``. Null keys are not."""
    on = [on] if isinstance(on, str) else on
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sorted_lists(rows: DataFrame, key: str, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """For each key parallel arrays of ``values`` (name: column), all ordered by ``order``."""
    fields = [*order, *(c for c in values.values() if c not in order)]
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_items"))
    return packed.select(key, *(F.col("_items").getField(c).alias(name) for name, c in values.items()))
