"""A writer is killed; everything that it acknowledged has to be there afterwards."""
import os
import signal
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sediment.functions.scalars import printable
from sediment.model import CorruptFormat, EngineConfig
from sediment.plans import workloads
from sediment.plans.engine import Engine
from sediment.sources import files
from sediment.sources.files import Files, read_sstables, write_sstables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WRITER = """
import sys
from pyspark.sql import SparkSession
from sediment.model import EngineConfig
from sediment.plans.engine import Engine
from sediment.plans.workloads import acknowledge
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = ((f"key-{i:020}".encode(), f"value-{i:020}".encode()) for i in range(10 ** 6))
acknowledge(Engine(spark, EngineConfig(sys.argv[1], 256, 2)), rows, sys.stdout)
"""


def test_killed_writer_loses_nothing_acknowledged(spark, tmp_path):
    at = str(tmp_path / "store")
    child = subprocess.Popen([sys.executable, "-c", WRITER, at], cwd=ROOT, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True, env=os.environ | {"PYTHONPATH": ROOT})
    acks = []
    try:
        while len(acks) < 40:
            line = child.stdout.readline()
            assert line, "the writer ended"
            if line.startswith("PUT\t"):
                acks.append(line.rstrip("\n").split("\t")[1:])
    finally:
        os.killpg(child.pid, signal.SIGKILL)
        child.wait()
    e = Engine(spark, EngineConfig(at, 256, 2))
    rows = spark.createDataFrame(acks, "key string, value string").select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    assert workloads.verify(e, rows).count() == 0 and e.sstable_count() > 0
    missing = rows.withColumn("value", F.lit(b"other"))
    assert workloads.verify(e, missing).count() == len(acks)


class Dead(Exception):
    pass


@pytest.mark.parametrize("most, steps", [(9, range(0, 40)), (0, range(2, 40, 5))])
def test_a_stop_between_any_two_file_operations_loses_nothing_acknowledged(spark, tmp_path, monkeypatch, most, steps):
    left = [0]

    def dying(f):
        def run(*args):
            if left[0] == 0:
                raise Dead
            left[0] -= 1
            return f(*args)
        return run

    for k in steps:
        config, acked = EngineConfig(str(tmp_path / f"{most}-{k}"), 40, most), {}
        with monkeypatch.context() as m:
            for of, name in ((files.Log, "__init__"), (files.Log, "append"), (Files, "_replace"), (Files, "delete")):
                m.setattr(of, name, dying(getattr(of, name)))
            left[0] = k
            try:
                for start in range(2):  # the second time over what the first left
                    e = Engine(spark, config)
                    for i in range(5):
                        key, value = f"key{i}".encode(), f"value{start}{i}".encode()
                        e.put(key, value)
                        acked[key] = value
            except Dead:
                pass
        left[0] = -1
        e = Engine(spark, config)
        got = {bytes(r["key"]): bytes(r["value"]) for r in e.resolved().collect()}
        for key, value in acked.items():  # or a later value, whose put was not acknowledged
            assert got.get(key) in (value, f"value1{key.decode()[-1]}".encode()), (most, k, key)
        e.put(b"after", b"1")
        assert Engine(spark, config).get(b"after") == b"1"


def test_removed_segments_and_truncated_logs(spark, tmp_path):
    config = EngineConfig(str(tmp_path / "s"), 8, 0)
    e = Engine(spark, config)
    e.put(b"alpha", b"one")
    e.put(b"beta", b"two2")
    e.remove_sstable(0)
    e.remove_sstable(77)
    e = Engine(spark, config)
    assert e.get(b"alpha") is None and e.get(b"beta") == b"two2" and e.sstable_count() == 1
    e.put(b"c", b"3")
    e.truncate_log()
    assert e.memtable_size() == 0 and Engine(spark, config).get(b"c") is None
    f = Files(spark, str(tmp_path / "t"))
    f.write("x", b"0123456789")
    assert f.read_section("x", 3, 4) == b"3456"
    with pytest.raises(CorruptFormat):
        f.read_section("x", 8, 4)


def test_repeated_keys_are_loaded_once(spark, tmp_path):
    e = Engine(spark, EngineConfig(str(tmp_path / "s")))
    e.load(spark.createDataFrame([(bytearray(b"k"), 1, bytearray(b"a")), (bytearray(b"k"), 1, bytearray(b"b"))], "key binary, kind int, value binary"))
    assert [bytes(r["value"]) for r in e.log().collect()] == [b"b"]
    e.load(spark.createDataFrame([], "key binary, kind int, value binary"))
    assert e.sstable_count() == 1


def test_demo(spark, tmp_path):
    got = workloads.demo(Engine(spark, EngineConfig(str(tmp_path / "demo"))))
    assert got == {b"alpha": None, b"beta": b"two", b"gamma": b"three", b"missing": None}
    assert workloads.throughput(10, 2) == 5 and workloads.throughput(10, 0) == 0


def test_byte_format_segments_round_trip(spark, tmp_path):
    rows = [(i % 3, bytearray(f"k{i:03}".encode()), 2 if i % 7 == 0 else 1, None if i % 7 == 0 else bytearray(b"v" * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "file_id long, key binary, kind int, value binary")
    write_sstables(df, Files(spark, str(tmp_path)), "", 400)
    got = read_sstables(spark, str(tmp_path))
    assert got.exceptAll(df).count() == 0 and got.count() == len(rows)
    assert spark.createDataFrame([(bytearray(b"a\xffb"),)], "v binary").select(printable(F.col("v"))).first()[0] == "a�b"


def test_files_are_written_by_the_executors_byte_for_byte(spark, tmp_path, monkeypatch):
    """The driver renames files and gets none of their bytes, whatever byte a file ends with."""
    def refused(*_):
        raise AssertionError("a file's bytes came to the driver")

    for name in ("write", "log"):
        monkeypatch.setattr(Files, name, refused)
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refused)
    ends = [0, 9, 10, 13, 92, 127, 128, 195, 255]
    rows = [(i, 10 * i + j, 1, bytearray(b"k\n%d" % j), bytearray(b"\r\n\x00\xff" * j + bytes([end]))) for i, end in enumerate(ends) for j in (2, 1)]
    there = Files(spark, str(tmp_path))
    log = spark.createDataFrame(rows, "seg long, seq long, kind int, key binary, value binary")
    for _ in range(2):  # the second time over the first's files
        files.write_wals(log, there, "wal")
    assert sorted(os.listdir(tmp_path)) == ["wal"] and sorted(os.listdir(tmp_path / "wal")) == [f"wal_{i}.log" for i in range(len(ends))]
    for i in range(len(ends)):
        want = b"".join(files.codec.encode_wal(seq, kind, bytes(k), bytes(v)) for s, seq, kind, k, v in sorted(rows, key=lambda r: r[1]) if s == i)
        assert (tmp_path / "wal" / f"wal_{i}.log").read_bytes() == want
    got = files.read_wal(spark, str(tmp_path / "wal")).select("wal_id", "seq", "kind", "key", "value")
    assert sorted((*r[:3], bytes(r[3]), bytes(r[4])) for r in got.collect()) == sorted((*r[:3], bytes(r[3]), bytes(r[4])) for r in rows)
    write_sstables(log.select(log.seg.alias("file_id"), "key", "kind", "value"), there, "sst")
    assert read_sstables(spark, str(tmp_path / "sst")).count() == len(rows)
    write_sstables(log.limit(0).select(log.seg.alias("file_id"), "key", "kind", "value"), there, "none")
