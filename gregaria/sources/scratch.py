"""Written tables that cut lineage.

Iterative operators write each step below the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs no recomputation of earlier
steps. Parquet is used rather than ``checkpoint()``: it is compressed, columns
are pruned on the way back, and its footers give row counts without a scan.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="gregaria-")
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


class Scratch:
    """A set of tables in the shared folder, removed when superseded, dropped, or when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/gregaria-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Has Spark remove the shuffle files of plans that are no longer held, else they stay until the driver happens to collect its garbage."""
        gc.collect()
        try:
            self.spark._jsc.sc().listenerBus().waitUntilEmpty()  # its events hold the plans that ended
        except Exception:  # others keep it busy: what their plans hold stays for now
            pass
        for _ in range(2):
            self.spark._jvm.System.gc()

    def drop(self, name: str | None = None) -> None:
        """Removes one table, or all of them for good."""
        if name is None:
            atexit.unregister(self.drop)
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root if name is None else f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: the folder is the cluster's to clean
            pass
