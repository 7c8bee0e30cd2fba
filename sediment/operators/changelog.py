"""The change log: blind puts and deletes in a total order."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sediment.functions.scalars import memory_size, to_key
from sediment.model import PUT, TOMBSTONE


def puts(df: DataFrame, key: str, value: str) -> DataFrame:
    """One put per row; order columns pass through."""
    return df.withColumn("kind", F.lit(PUT)).withColumn("key", to_key(key)).withColumn("value", to_key(value))


def deletes(df: DataFrame, key: str) -> DataFrame:
    """One tombstone per row, whether or not the key exists."""
    return df.withColumn("kind", F.lit(TOMBSTONE)).withColumn("key", to_key(key)).withColumn("value", F.lit(None).cast("binary"))


def number_rows(df: DataFrame, order: list[str], base: int, staging: str) -> DataFrame:
    """Adds ``seq`` = base, base+1, ... in the given order, without a single-task window.

    Rows are range-partitioned and staged once; each partition's start is the sum of
    the counts before it, a table with one row a partition.
    """
    spark = df.sparkSession
    (df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
       .withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staging))
    staged = spark.read.parquet(staging)
    shift = 2 ** 33
    counts = staged.groupBy((F.col("_at") / shift).cast("long").alias("p")).count().collect()
    starts, total = {}, base
    for r in sorted(counts, key=lambda r: r["p"]):
        starts[r["p"]], total = total, total + r["count"]
    table = spark.createDataFrame(list(starts.items()) or [(0, base)], "_p long, _start long")
    return (staged.withColumn("_p", (F.col("_at") / shift).cast("long")).join(F.broadcast(table), "_p")
            .withColumn("seq", F.col("_start") + F.col("_at") % shift).drop("_p", "_start", "_at"))


def events_log(events: DataFrame, per_segment: int = 50) -> DataFrame:
    """The canonical change log of the test tables: an error event deletes its user's key.

    Keys and values are strings here, so that results compare without rendering bytes.
    """
    return events.select(
        F.floor(F.col("event_id") / per_segment).cast("long").alias("seg"), (F.col("event_id") + 1).cast("long").alias("seq"),
        F.when(F.col("event_type") == "error", TOMBSTONE).otherwise(PUT).cast("int").alias("kind"),
        F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 20, "0")).alias("key"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"))


def with_sizes(log: DataFrame) -> DataFrame:
    return log.withColumn("size", memory_size(F.col("key"), F.col("value")))
