"""Block packing and the floor lookup over block indexes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sediment.functions.scalars import block_entry_size
from sediment.model import BLOCK_BYTES


def pack_blocks(entries: DataFrame, target: int = BLOCK_BYTES, by: str = "seg") -> DataFrame:
    """Greedy packing in key order: (seg, block_id, first_key, entries, bytes).

    A block opens with its 4-byte count; the next entry starts a new one when it
    would exceed ``target`` and the block isn't empty, so an oversized entry gets a
    block of its own. Entries stream through in key order, a jump a block; a task holds
    one Arrow batch and the block that is open.
    """
    kind = entries.schema["key"].dataType.simpleString()
    rows = entries.select(F.col(by).cast("long").alias("_by"), F.col("key").alias("_key"), block_entry_size(F.col("key"), F.col("value")).cast("long").alias("_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, number, key, count, size = None, 0, None, 0, 0  # the open block
        for b in batches:
            out = []
            at, sizes, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), b.column(1)
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if at[low] != seg:
                    if count:
                        out.append((seg, number, key, count, size))
                    seg, number, count = int(at[low]), 0, 0
                ends, i = np.cumsum(sizes[low:high]), 0
                while i < high - low:
                    if not count:
                        key, count, size = keys[low + i].as_py(), 1, 4 + int(sizes[low + i])
                        i += 1
                    fit = int(np.searchsorted(ends, target - size + (ends[i - 1] if i else 0), side="right"))
                    if fit > i:
                        count, size, i = count + fit - i, size + int(ends[fit - 1] - (ends[i - 1] if i else 0)), fit
                    if i < high - low:
                        out.append((seg, number, key, count, size))
                        number, count = number + 1, 0
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["seg", "block_id", "first_key", "entries", "bytes"])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((seg, number, key, count, size), kinds)], ["seg", "block_id", "first_key", "entries", "bytes"])

    kinds = [pa.int64(), pa.int64(), pa.binary() if kind == "binary" else pa.string(), pa.int64(), pa.int64()]
    packed = rows.repartition("_by").sortWithinPartitions("_by", "_key").mapInArrow(run, f"seg long, block_id long, first_key {kind}, entries long, bytes long")
    return packed.withColumnRenamed("seg", by)


def floor_lookup(probes: DataFrame, index: DataFrame, on: str = "key", first: str = "first_key", salt: int = 64) -> DataFrame:
    """Adds the greatest ``first`` not after each probe key; null before the first.

    Index and probes are merged in key order within buckets that each begin at an index
    key, so a bucket needs nothing from the one before it: no nested loop and no single
    task. The ``salt`` cut points are a bounded random pick and only balance the work.
    """
    kind = probes.schema[on].dataType
    merged = (index.select(F.col(first).alias(on), F.col(first).alias("_floor"), F.lit(0).alias("_probe")).distinct()
              .unionByName(probes.select(on, F.lit(None).cast(kind).alias("_floor"), F.lit(1).alias("_probe"))))
    bounds = sorted(r[0] for r in index.select(first).distinct().orderBy(F.rand(7)).limit(salt).collect())
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + F.when(F.col(on) >= F.lit(b), 1).otherwise(0)
    merged = merged.withColumn("_b", bucket)
    w = Window.partitionBy("_b").orderBy(on, "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (merged.withColumn(first, F.last("_floor", ignorenulls=True).over(w)).where("_probe = 1").select(on, first))
