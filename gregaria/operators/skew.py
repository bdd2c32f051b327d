"""Per-key results where a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch (``approx_top_k``)
that runs as a map-side partial aggregate; they are then treated by broadcast
join against the short list of heavy keys, all other keys by an ordinary
shuffle, and both parts are united.

Size of what is broadcast: a key that holds at least ``share`` of the rows is
one of at most ``1 / share`` keys. The sketch tracks ``SKETCH_ITEMS_PER_KEY /
share`` items, which keeps its error below a quarter of ``share``, so at most
``2 / share`` keys can be estimated that high; that many are kept as
candidates, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ITEMS_PER_KEY = 32


def heavy_candidates(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Columns ``key``, ``total``: every key that holds at least ``share`` of the non-null keys, and few others.

    Null keys are left out; an empty input gives no row.
    """
    kept = max(2, round(2 / share))
    tracked = 1 << (round(SKETCH_ITEMS_PER_KEY / share) - 1).bit_length()
    keyed = rows.where(F.col(key).isNotNull())
    top = keyed.agg(F.expr(f"approx_top_k(`{key}`, {kept}, {tracked})").alias("top"), F.count(F.lit(1)).alias("total"))
    return (
        top.select("total", F.explode("top").alias("top"))
        .where(F.col("top.count") >= F.col("total") * F.lit(share * 0.75))
        .select(F.col("top.item").alias(key), "total")
    )


def heavy_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Columns ``key``, ``n_rows``, ``total``: the keys that hold at least ``share``, counted exactly."""
    candidates = heavy_candidates(rows, key, share)
    counted = (
        rows.select(key).join(F.broadcast(candidates), key)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("total").alias("total"))
    )
    return counted.where(F.col("n_rows") >= F.col("total") * F.lit(share))


def per_key(rows: DataFrame, key: str, aggregates: Sequence[Column], share: float) -> DataFrame:
    """``aggregates`` and ``is_heavy`` for every non-null value of ``key``.

    Rows of heavy keys meet the list of heavy keys by broadcast join and are
    aggregated apart, so they never travel with the shuffle of the light keys.
    ``aggregates`` must have partial aggregation (count, sum, min, max, avg,
    sketches): of a heavy key one partial row per task is shuffled.
    """
    heavy = heavy_keys(rows, key, share).select(key)
    keyed = rows.where(F.col(key).isNotNull())
    hot = keyed.join(F.broadcast(heavy), key, "left_semi").groupBy(key).agg(*aggregates)
    cold = keyed.join(F.broadcast(heavy), key, "left_anti").groupBy(key).agg(*aggregates)
    return hot.withColumn("is_heavy", F.lit(True)).unionByName(cold.withColumn("is_heavy", F.lit(False)))


def skew_join(rows: DataFrame, lookup: DataFrame, key: str | Sequence[str], share: float) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (at most one row a key), without one task taking a heavy key.

    Heavy keys meet their lookup rows by broadcast join where the rows lie (one
    row each, so at most ``2 / share`` but for keys of equal hash); the rest is
    shuffled as usual. Keys with a null match nothing and keep their row.
    Columns of ``lookup`` whose names ``rows`` has too come out with
    ``_lookup`` behind the name.
    """
    keys = [key] if isinstance(key, str) else list(key)
    whole = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    mark = "_key_hash"
    hashed = lambda df: df.withColumn(mark, F.when(whole, F.xxhash64(*keys)))
    lookup = lookup.withColumnsRenamed({c: f"{c}_lookup" for c in lookup.columns if c not in keys and c in rows.columns})
    rows, lookup = hashed(rows), hashed(lookup)
    hot_keys = F.broadcast(heavy_candidates(rows, mark, share).select(mark))
    hot_lookup = lookup.join(hot_keys, mark, "left_semi").drop(mark)
    hot = rows.join(hot_keys, mark, "left_semi").join(F.broadcast(hot_lookup), keys, "left")
    cold = rows.join(hot_keys, mark, "left_anti").join(lookup.drop(mark), keys, "left")
    columns = [c for c in rows.columns if c != mark] + [c for c in lookup.columns if c not in keys and c != mark]
    return hot.select(columns).unionByName(cold.select(columns))


def salted(rows: DataFrame, hot: DataFrame, key: str, spread_by: Column, salts: int) -> DataFrame:
    """``rows`` with ``salt``: by ``spread_by`` for the keys in ``hot`` (a short list), else 0."""
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("is_hot"))), key, "left")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return marked.withColumn("salt", salt).drop("is_hot")


def copied_to_salts(rows: DataFrame, hot: DataFrame, key: str, salts: int) -> DataFrame:
    """The other side of ``salted``: rows of hot keys once for every salt."""
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("is_hot"))), key, "left")
    copies = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("salt", F.explode(copies)).drop("is_hot")
