"""Generated workloads: sequential writes, pseudo-random reads, a mixed split, hot-key hints."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.functions.scalars import make_key, make_value, pseudo_random_index
from sediment.model import PUT
from sediment.operators.resolve import unanswered


def writes(spark: SparkSession, n: int, value_bytes: int = 256, start: int = 0) -> DataFrame:
    """A change log of n sequential puts."""
    i = F.col("id")
    return spark.range(start, start + n).select(F.lit(0).cast("long").alias("seg"), (i + 1).alias("seq"), F.lit(PUT).alias("kind"),
                                                make_key(i).cast("binary").alias("key"), make_value(i, value_bytes).cast("binary").alias("value"))


def reads(spark: SparkSession, ops: int, keys: int) -> DataFrame:
    return spark.range(ops).select(F.col("id").alias("op"), pseudo_random_index(F.col("id"), keys).alias("index"))


def mixed(spark: SparkSession, ops: int, keys: int, read_percent: int = 50) -> DataFrame:
    """Per operation: a get of a pseudo-random key, or a put of a new one."""
    op = F.col("id")
    is_get = op % 100 < read_percent
    return spark.range(ops).select(op.alias("op"), F.when(is_get, "get").otherwise("put").alias("action"),
                                   F.when(is_get, pseudo_random_index(op, keys)).otherwise(op + keys).alias("index"))


def throughput(operations: int, seconds: float) -> float:
    """Operations a second; 0 for no time."""
    return operations / seconds if seconds > 0 else 0.0


def demo(engine) -> dict[bytes, bytes | None]:
    """Puts three keys, overwrites and deletes one, and reads them and a missing one."""
    for key, value in ((b"alpha", b"one"), (b"beta", b"two"), (b"gamma", b"three"), (b"alpha", b"updated"), (b"alpha", None)):
        engine.write([(key, value)])
    return {k: engine.get(k) for k in (b"alpha", b"beta", b"gamma", b"missing")}


def acknowledge(engine, rows, out) -> None:
    """Writes rows one by one; a line goes to ``out`` once its row is durable."""
    for key, value in rows:
        engine.put(key, value)
        print("PUT", key.decode(), value.decode(), sep="\t", file=out, flush=True)


def verify(engine, acknowledged: DataFrame) -> DataFrame:
    """Acknowledged (key, value) rows that the reopened store does not show; none are expected."""
    return unanswered(acknowledged, engine.log())


def publish(hints: DataFrame, more: DataFrame) -> DataFrame:
    """Appends (key_hash, page_id) hints; repeats stay."""
    return hints.unionByName(more)
