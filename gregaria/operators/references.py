"""References to records that do not exist.

References and parent keys are co-partitioned by the key they name, sorted, and
merged linearly (a sort-merge join). A parent is one row that carries the
interval in which it is valid, so the merge tells apart keys that are missing,
deleted and late. Keys that hold a large share of the references are spread
over salts, with their one parent row copied to each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gregaria.operators.skew import copied_to_salts, heavy_candidates, salted

HOT_SHARE = 1 / 64
SALTS = 32


def given(reference: Column) -> Column:
    """Null and -1 name nothing."""
    return reference.isNotNull() & (reference != -1)


def parent_intervals(parents: dict[str, DataFrame], removals: DataFrame) -> DataFrame:
    """One row for each parent that was ever delivered: ``kind, key, valid_from, removed``.

    ``parents``: by kind, rows with ``key`` and ``arrived`` (null where the kind
    has no arrivals). ``removals``: ``kind, key, removed_at``; only the latest
    counts, and only if it is not before the parent's last arrival. A removal
    of a key that was never delivered gives no row. Null keys are left out.
    """
    streams = [
        df.select(F.lit(kind).alias("kind"), "key", F.col("arrived"), F.lit(1).alias("seen"), F.lit(None).cast("timestamp_ntz").alias("removed_at"))
        for kind, df in parents.items()
    ]
    gone = removals.where(F.col("kind").isin(list(parents))).select(
        "kind", "key", F.lit(None).cast("timestamp_ntz").alias("arrived"), F.lit(0).alias("seen"), F.col("removed_at")
    )
    merged = reduce(DataFrame.unionByName, [*streams, gone]).where(F.col("key").isNotNull())
    return (
        merged.groupBy("kind", "key")
        .agg(F.max("seen").alias("seen"), F.min("arrived").alias("valid_from"), F.max("arrived").alias("last_arrival"), F.max("removed_at").alias("removed_at"))
        .where("seen = 1")
        .select("kind", "key", "valid_from", F.coalesce(F.col("removed_at") >= F.coalesce("last_arrival", "removed_at"), F.lit(False)).alias("removed"))
    )


def broken_references(references: DataFrame, parents: DataFrame, hot_share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """The rows of ``references`` that name no valid parent, with ``fault``: missing, deleted or late.

    ``references``: ``kind, key, record_id, seen_at`` and any further columns,
    which come out as they are (but for one named ``fault``, which is replaced);
    ``seen_at`` is the first arrival of the referring record. A null or -1 key
    is no reference. A parent with null ``valid_from`` is never late, nor is a
    reference with null ``seen_at``. Repeated references are all kept. An
    empty table of parents leaves every reference missing.
    """
    columns = [c for c in references.columns if c != "fault"]
    named = F.xxhash64("kind", "key").alias("named")
    whole = references.where(given(F.col("key"))).select(named, "kind", "key", "record_id", F.struct(*columns).alias("row"))
    hot = heavy_candidates(whole, "named", hot_share)
    left = salted(whole, hot, "named", F.col("record_id"), salts)
    right = copied_to_salts(parents.select(named, "kind", "key", "valid_from", "removed", F.lit(True).alias("found")), hot, "named", salts).drop("named")
    merged = left.join(right.hint("merge"), ["kind", "key", "salt"], "left")
    fault = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("removed"), "deleted")
        .when(F.col("valid_from") > F.col("row.seen_at"), "late")
    )
    return merged.select("row.*", fault.alias("fault")).where(F.col("fault").isNotNull())
