import pytest

from gregaria.sources.scratch import Scratch, scratch_root
from gregaria.sources.tables import read_table, spread


def test_scratch_is_below_the_shared_folder_of_the_session(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_root(spark) == root
    scratch = Scratch(spark, "test")
    assert scratch.root.startswith(root)


def test_written_tables_come_back_and_go(spark, rows):
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, s string")
    for back in (scratch.write(df, "plain"), scratch.write(df, "parts", partition_by="id")):
        assert dict(back.dtypes) == dict(df.dtypes) and rows(back.select("id", "s")) == rows(df)
    empty = scratch.write(df.limit(0), "empty")
    assert empty.columns == df.columns and empty.count() == 0
    assert spark.read.parquet(f"{scratch.root}/plain").count() == 2
    scratch.drop("plain")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{scratch.root}/plain").count()
    scratch.drop()
    scratch.drop()


def test_only_tables_of_few_splits_are_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/few.parquet")
    few = spread(read_table(spark, str(tmp_path), "few"))
    assert few.rdd.getNumPartitions() == cores and few.count() == 100
    many = spark.range(100).repartition(cores + 3)
    assert spread(many) is many
