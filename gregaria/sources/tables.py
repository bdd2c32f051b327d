"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` below ``directory``: one parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` for work that takes long a row: dealt out to all cores if they come from files of fewer splits, else as they are.

    Only tables of fewer splits than cores are shuffled, so the shuffle is
    bounded by the cluster's size, not the table's. Files and their sizes tell;
    no part of the plan is run for it.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if not files or len(files) >= cores:
        return rows
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    sizes = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths]
    return rows.repartition(cores) if sum(-(-size // split) for size in sizes) < cores else rows
