import random

import pytest
from pyspark.sql import functions as F

from gregaria.operators.skew import heavy_keys, per_key, skew_join


@pytest.fixture
def skewed(spark):
    keys = random.Random(1).choices([7] * 400 + [8] * 60 + [None] * 30 + list(range(100, 900)), k=6000)
    return spark.createDataFrame([(k, i, i) for i, k in enumerate(keys)], "key bigint, value bigint, total bigint")


def test_heavy_keys_are_exact(skewed, rows):
    counts = {r[0]: r[1] for r in skewed.where("key is not null").groupBy("key").count().collect()}
    whole = sum(counts.values())
    assert {(r[0], r[1]) for r in rows(heavy_keys(skewed, "key", 1 / 40))} == {(k, c) for k, c in counts.items() if c * 40 >= whole}


def test_a_key_at_the_limit_counts(spark, rows):
    df = spark.createDataFrame([(1,)] + [(k,) for k in range(2, 41)], "key bigint")
    assert len(rows(heavy_keys(df, "key", 1 / 40))) == 40


def test_results_of_all_keys(skewed, rows):
    out = per_key(skewed, "key", [F.count(F.lit(1)).alias("n"), F.max("value").alias("value")], 1 / 40)
    plain = skewed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    assert rows(out.drop("is_heavy")) == rows(plain)
    assert {r.key for r in out.where("is_heavy").collect()} == {7, 8}


def test_join_as_plain_join(spark, skewed, rows):
    lookup = spark.createDataFrame([(k, f"n{k}", -1) for k in [7, *range(100, 500)]], "key bigint, name string, value bigint")
    out = skew_join(skewed, lookup, "key", 1 / 40)
    assert out.columns == ["key", "value", "total", "name", "value_lookup"]
    plain = skewed.join(lookup.withColumnRenamed("value", "value_lookup"), "key", "left")
    assert rows(out) == rows(plain.select(out.columns))


def test_empty_and_all_null(spark, rows):
    for df in (spark.createDataFrame([], "key bigint, v int"), spark.createDataFrame([(None, 1)], "key bigint, v int")):
        assert rows(heavy_keys(df, "key", 0.1)) == []
        assert rows(per_key(df, "key", [F.sum("v").alias("v")], 0.1)) == []
        assert skew_join(df, df, "key", 0.1).count() == df.count()
