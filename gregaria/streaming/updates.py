"""Updates as a stream: files of requests in, graph versions out.

Every micro-batch is applied to the newest version, and its changes are stored as
the next, so a batch costs what it changes; many changes are merged now and then.
The number of the last batch is kept beside the versions, so a batch that is
delivered again after a failure changes nothing. Late events need no watermark:
reads order by time themselves, and upserts compare times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gregaria.plans.updates import apply_updates, split_updates, wide_schema
from gregaria.sources import snapshot


def _last_batch(spark: SparkSession, root: str, stream: str) -> int:
    fs, where = snapshot._fs(spark, f"{root}/batches/{stream}")
    if not fs.exists(where):
        return -1
    return max((int(s.getPath().getName()) for s in fs.listStatus(where)), default=-1)


def _mark(spark: SparkSession, root: str, stream: str, batch: int) -> None:
    fs, where = snapshot._fs(spark, f"{root}/batches/{stream}/{batch}")
    fs.create(where, True).close()


def apply_batch(rows: DataFrame, batch: int, root: str, stream: str = "updates", keep: int = 2) -> None:
    """One micro-batch onto the newest version below ``root``."""
    spark = rows.sparkSession
    if batch <= _last_batch(spark, root, stream):
        return
    rows = rows.persist()  # each kind of request filters it
    try:
        if not rows.isEmpty():
            updated = apply_updates(snapshot.open_version(spark, root), split_updates(rows))
            snapshot.append(updated, root)
            updated.release()
            snapshot.fold(spark, root)
        _mark(spark, root, stream, batch)
    finally:
        rows.unpersist()
    snapshot.compact(spark, root, keep)


def stream_updates(spark: SparkSession, source: str, root: str, checkpoint: str, file_format: str = "json", stream: str = "updates", **options: str) -> StreamingQuery:
    """Starts applying the request files that appear in ``source``; ``available_now="true"`` stops when all are done."""
    rows = spark.readStream.schema(wide_schema()).format(file_format).options(**{k: v for k, v in options.items() if k != "available_now"}).load(source)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply_batch(df, n, root, stream))
    return (writer.trigger(availableNow=True) if options.get("available_now") == "true" else writer.trigger(processingTime="10 seconds")).start()
