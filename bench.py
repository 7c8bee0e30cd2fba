"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads. Each query
is run once to warm up and once timed, to a sink that computes every column. The
workloads are the published ones: 20,000 puts of 256-byte values, 20,000 reads of
loaded keys, and 20,000 operations of which half read and half write, in batches with one
synced write each; and 500 single puts, each synced.
"""
from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from sediment.functions.scalars import make_key, make_value
from sediment.model import EngineConfig
from sediment.plans import workloads
from sediment.plans.catalogue import CATALOGUE
from sediment.plans.engine import Engine

SINGLE = 500
HEADLINES = ["kv_latest_state", "kv_multi_get", "kv_layered_get", "kv_segment_scan", "kv_segment_meta", "kv_memtable_size", "kv_manifest_live", "kv_wal_replay", "kv_recovery",
             "kv_rotation", "kv_block_floor", "kv_bloom_get", "kv_mixed_workload", "kv_value_gen"]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    at = tempfile.mkdtemp(prefix="sediment-bench-")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    runs = {name: (lambda q=CATALOGUE[name][0]: sink(q(spark, data))) for name in HEADLINES}
    n, made = 20_000, iter(range(100))
    store = Engine(spark, EngineConfig(f"{at}/read", memtable_threshold=1 << 20, maximum_memtables=0))
    store.load(workloads.writes(spark, n).drop("seg", "seq"))

    def write():
        Engine(spark, EngineConfig(f"{at}/write{next(made)}", 1 << 20, 0)).load(workloads.writes(spark, n).drop("seg", "seq"))

    def write_through_log():
        """The same puts through the write-ahead log and memtables, flushed at 1 MiB."""
        rows = [(bytes(r["key"]), bytes(r["value"])) for r in workloads.writes(spark, n).orderBy("seq").collect()]
        e = Engine(spark, EngineConfig(f"{at}/log{next(made)}", 1 << 20, 0))
        e.write(rows)
        assert (e.sstable_count(), e.immutable_memtable_count(), e.memtable_size()) == (5, 0, 376_540)

    def read():
        keys = workloads.reads(spark, n, n).select(F.expr("cast(concat('key-', lpad(index, 20, '0')) as binary)").alias("key"))
        sink(store.multi_get(keys))

    def mixed():
        """10,000 gets over 10,000 loaded keys and 10,000 puts of 256-byte values, a hundred operations a batch of either."""
        e = Engine(spark, EngineConfig(f"{at}/mixed{next(made)}", 1 << 20, 4))
        e.load(workloads.writes(spark, n // 2).drop("seg", "seq"))
        ops = workloads.mixed(spark, n, n // 2)
        puts = ops.where("action = 'put'").select(make_key(F.col("index")).cast("binary").alias("key"), make_value(F.col("index"), 256).cast("binary").alias("value")).collect()
        e.write([(bytes(r["key"]), bytes(r["value"])) for r in puts])
        sink(e.multi_get(ops.where("action = 'get'").select(make_key(F.col("index")).cast("binary").alias("key"))))
        assert (e.immutable_memtable_count(), e.memtable_size()) == (2, (n // 2 - 2 * 3732) * 281)

    def single_puts():
        """One synced append a put."""
        e = Engine(spark, EngineConfig(f"{at}/single{next(made)}", 1 << 30, 64))
        for i in range(SINGLE):
            e.put(f"key-{i:020}".encode(), bytes(256))

    runs |= {"load_20000": write, "log_writes_20000": write_through_log, "reads_20000": read, "mixed_20000": mixed, f"single_puts_{SINGLE}": single_puts}
    timed = {}
    for name, run in runs.items():
        run()
        began = time.perf_counter()
        run()
        timed[name] = round(time.perf_counter() - began, 3)
    per_second = {k: round(n / timed[k]) for k in ("load_20000", "log_writes_20000", "reads_20000", "mixed_20000")}
    per_second[f"single_puts_{SINGLE}"] = round(SINGLE / timed[f"single_puts_{SINGLE}"])
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "operations_per_second": per_second, "sf": data.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()
    shutil.rmtree(at, ignore_errors=True)


if __name__ == "__main__":
    main()
