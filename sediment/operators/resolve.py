"""Newest-version-wins reads: one resolved view serves point, batch and scan reads.

``max_by`` keeps the aggregate a map-side-combining hash aggregate, and Catalyst
pushes key predicates through it to the Parquet scan; a ranking window would do
neither. Kind and value travel in one struct, so a tombstone's null value can't
let an older value show.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sediment.model import PUT, TOMBSTONE


def newest(log: DataFrame, by: list[str], order: Column, extra: list[str] = ()) -> DataFrame:
    """One row per ``by``: the kind, value and ``extra`` columns of its newest version."""
    v = F.max_by(F.struct("kind", "value", *extra), order).alias("v")
    return log.groupBy(*by).agg(v).select(*by, "v.*")


def dedupe_segments(log: DataFrame) -> DataFrame:
    """What each memtable or sorted segment holds: one version per segment and key."""
    return newest(log, ["seg", "key"], F.col("seq"))


def resolved(log: DataFrame) -> DataFrame:
    """Visible rows: newest by (segment, sequence), tombstones removed afterwards."""
    return newest(log, ["key"], F.struct("seg", "seq")).where(F.col("kind") == PUT).select("key", "value")


def tombstones(log: DataFrame) -> DataFrame:
    return newest(log, ["key"], F.struct("seg", "seq")).where(F.col("kind") == TOMBSTONE).select("key")


def get(log: DataFrame, key) -> DataFrame:
    """A point read: the filter reaches the scan before anything is aggregated."""
    return resolved(log.where(F.col("key") == F.lit(key)))


def multi_get(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Every asked key once per asking row; value null when missing or deleted."""
    return keys.join(resolved(log), "key", "left")


def layers(log: DataFrame, maximum_memtables: int = 4) -> DataFrame:
    """Adds ``layer``: the last segment is active, those queued before it immutable, the rest flushed."""
    last = log.agg(F.max("seg").alias("_last"))
    return (log.join(F.broadcast(last), F.col("seg") <= F.col("_last"))
            .withColumn("layer", F.when(F.col("seg") == F.col("_last"), "active")
                        .when(F.col("seg") >= F.col("_last") - maximum_memtables, "immutable").otherwise("sstable")).drop("_last"))


def layered_get(log: DataFrame, maximum_memtables: int = 4) -> DataFrame:
    """Visible rows with the layer that answers; within a segment the later write wins."""
    found = newest(layers(log, maximum_memtables), ["key"], F.struct("seg", "seq"), ["seg", "layer"])
    return found.where(F.col("kind") == PUT).select("key", "value", "seg", "layer")


def unanswered(expected: DataFrame, log: DataFrame) -> DataFrame:
    """Acknowledged (key, value) rows that a reader would not see."""
    got = resolved(log).withColumnRenamed("value", "_got").withColumn("_hit", F.lit(True))
    return expected.join(got, "key", "left").where(F.col("_hit").isNull() | ~F.col("value").eqNullSafe(F.col("_got"))).select("key", "value")


def scan(log: DataFrame, low=None, high=None) -> DataFrame:
    """Visible rows with low <= key < high in key order (an extension)."""
    if low is not None:
        log = log.where(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.where(F.col("key") < F.lit(high))
    return resolved(log).orderBy("key")
