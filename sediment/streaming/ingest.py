"""Structured Streaming into the change log: one micro-batch is one log segment."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sediment.operators.resolve import newest


def ingest(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes (seq, kind, key, value) batches as ``seg=<batch>`` folders, each replaced whole.

    A batch that is retried after a failure overwrites its own folder, so the sink is
    idempotent; the checkpoint is the recovery pointer. Rate limits on the source set
    how much a segment holds.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (newest(batch, ["key"], F.col("seq"), ["seq"]).repartitionByRange("key").sortWithinPartitions("key")
         .write.mode("overwrite").parquet(f"{path}/seg={batch_id}"))

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """Newest version per key as a streaming aggregate; tombstones stay in state, as older puts may still arrive."""
    return newest(changes, ["key"], F.col("seq"), ["seq"])
