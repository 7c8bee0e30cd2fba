"""Rebuilding the visible state from durable logs, and checking it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sediment.functions.scalars import wal_record_size
from sediment.operators import resolve


def replay_summary(log: DataFrame) -> DataFrame:
    """Records, sequence range and log bytes of each segment."""
    return log.groupBy("seg").agg(F.count("*").cast("long").alias("records"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
                                  F.sum(wal_record_size(F.col("key"), F.col("value"))).cast("long").alias("log_bytes"))


def unflushed(log: DataFrame, maximum_memtables: int = 4) -> DataFrame:
    return resolve.layers(log, maximum_memtables).where(F.col("layer") != "sstable").drop("layer")


def recovered(log: DataFrame, maximum_memtables: int = 4) -> DataFrame:
    """The view that replaying the logs of unflushed segments gives."""
    return resolve.resolved(unflushed(log, maximum_memtables))


def current_state(log: DataFrame, maximum_memtables: int = 4) -> DataFrame:
    """The four next ids implied by a log whose older segments are flushed."""
    return log.agg(
        F.greatest(F.max("seg") - maximum_memtables, F.lit(0)).cast("long").alias("next_sstable_id"), (F.max("seg") + 1).cast("long").alias("next_wal_id"),
        F.lit(1).cast("long").alias("next_manifest_id"), F.coalesce(F.max("seq") + 1, F.lit(1)).cast("long").alias("next_sequence_id"))
