"""Operators on small hand-made logs, and streaming ingestion."""
import pytest

from pyspark.sql import functions as F

from sediment.functions import scalars as S
from sediment.operators import blocks, bloom, changelog, manifest, resolve, segments
from sediment.plans import workloads
from sediment.streaming.ingest import ingest, latest


ACTIONS = "manifest_id long, ord long, action int, file_id long, size long"


def log(spark, rows):
    return spark.createDataFrame(rows, "seg long, seq long, kind int, key string, value string")


ROWS = [(0, 1, 1, "a", "1"), (0, 2, 1, "b", ""), (0, 3, 1, "a", "22"), (1, 4, 2, "a", None), (1, 5, 1, "c", "3"), (2, 6, 1, "d", "4"), (2, 7, 2, "nothing", None)]


def test_newest_wins_and_tombstones_hide(spark):
    d = log(spark, ROWS)
    assert {(r["key"], r["value"]) for r in resolve.resolved(d).collect()} == {("b", ""), ("c", "3"), ("d", "4")}
    assert {r["key"] for r in resolve.tombstones(d).collect()} == {"a", "nothing"}
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "key string")
    assert sorted(((r["key"], r["value"]) for r in resolve.multi_get(keys, d).collect()), key=str) == [("a", None), ("b", ""), ("b", ""), ("zz", None)]
    assert [r["key"] for r in resolve.scan(d, "b", "d").collect()] == ["b", "c"]


def test_layers_follow_the_newest_segment(spark):
    got = {r["key"]: r["layer"] for r in resolve.layered_get(log(spark, ROWS), 1).collect()}
    assert got == {"b": "sstable", "c": "immutable", "d": "active"}


def test_sizes_and_rotation(spark):
    sized = changelog.with_sizes(log(spark, ROWS))
    held = {r["seg"]: r["bytes"] for r in segments.memtable_sizes(log(spark, ROWS)).collect()}
    assert held == {0: 4 + 2, 1: 2 + 3, 2: 3 + 8}
    assert [tuple(r) for r in segments.rotation_points(sized, 5).orderBy("seg").collect()] == [(0, 2, 5, True), (1, 5, 5, True), (2, 7, 11, True)]
    once = sized.where("seq in (2, 4, 5, 6, 7)")
    assert [tuple(r) for r in segments.rotate_distinct(once, 5).collect()] == [tuple(r)[:3] for r in segments.rotation_points(once, 5).orderBy("seg").collect()]


def test_oversized_entries_get_a_block(spark):
    rows = [(0, "a", 1, "x" * 10), (0, "b", 1, "x" * 500), (0, "c", 1, "x"), (0, "d", 1, "x")]
    got = blocks.pack_blocks(spark.createDataFrame(rows, "seg long, key string, kind int, value string"), 100).orderBy("block_id").collect()
    assert [(r["first_key"], r["entries"], r["bytes"]) for r in got] == [("a", 1, 24), ("b", 1, 514), ("c", 2, 26)]


def test_floor_before_first_exact_between_after(spark):
    index = spark.createDataFrame([("c",), ("f",)], "first_key string")
    probes = spark.createDataFrame([("a",), ("c",), ("d",), ("f",), ("z",), ("z",)], "key string")
    assert sorted(((r["key"], r["first_key"]) for r in blocks.floor_lookup(probes, index).collect()), key=str) == [("a", None), ("c", "c"), ("d", "c"), ("f", "f"), ("z", "f"), ("z", "f")]
    assert blocks.floor_lookup(probes, index.where("1 = 0")).where("first_key is null").count() == 6


def test_sketch_has_no_false_negatives(spark):
    held = spark.range(300).selectExpr("if(id < 250, 0, 1) as seg", "concat('k', id) as key", "1 as kind", "'v' as value")
    sketch = bloom.build(held)
    assert {r["seg"]: r["bits"] for r in sketch.select("seg", "bits").distinct().collect()} == {0: 4096, 1: 512}
    probes = held.select("key").unionByName(spark.range(2000).selectExpr("concat('no', id) as key"))
    let = bloom.passing(sketch, probes)
    assert let.where("key like 'k%'").join(held, ["seg", "key"]).count() == 300 and let.where("key like 'no%'").count() < 2000 * 2 * 0.02
    assert bloom.filtered_get(held, sketch, probes).count() == 300
    assert bloom.sized_bits(100) == 959


def test_rotation_with_overwrites_goes_by_bounded_stretches(spark, monkeypatch):
    import random
    most, kind = [], type(spark.range(0))
    real = kind.mapInArrow

    def counted(self, run, *a, **k):
        most.append(self.count())
        return real(self, run, *a, **k)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    monkeypatch.setattr(segments, "STRETCH", 300)
    for seed, threshold, keys in ((1, 50, 40), (3, 400, 1000), (4, 10 ** 6, 5)):  # the last never rotates: a segment over all stretches
        rng = random.Random(seed)
        rows = [(i * 3, None if (k := rng.randrange(keys)) == 1 else f"k{k}", rng.choice([1, 2, 7, 30])) for i in range(2000)]
        want, held, total = [], {}, 0
        for q, key, n in rows:
            total += n - held.get(key, 0)
            held[key] = n
            if total >= threshold:
                want.append((len(want), q, total, True))
                held, total = {}, 0
        if held:
            want.append((len(want), rows[-1][0], total, False))
        most.clear()
        got = segments.rotation_points(spark.createDataFrame(rows[::-1], "seq long, key string, size long"), threshold)
        assert sorted(map(tuple, got.collect())) == want
        assert len(most) > 1 and max(most) < 1000  # no task gets the whole stream
        most.clear()
    assert segments.rotation_points(spark.createDataFrame([], "seq long, key string, size long"), 5).count() == 0


def test_rotation_by_partitions_equals_a_fold(spark):
    import random
    for seed, threshold in ((1, 50), (2, 9), (3, 400), (4, 10 ** 6)):
        rng = random.Random(seed)
        rows = [(i * 3, rng.choice([1, 2, 7, 30])) for i in range(500)]
        want, total = [], 0
        for q, n in rows:
            total += n
            if total >= threshold:
                want.append((len(want), q, total))
                total = 0
        if total:
            want.append((len(want), rows[-1][0], total))
        got = segments.rotate_distinct(spark.createDataFrame(rows, "seq long, size long"), threshold)
        assert sorted(map(tuple, got.collect())) == want
    assert segments.rotate_distinct(spark.createDataFrame([], "seq long, size long"), 5).count() == 0


def test_no_plan_gathers_a_table_in_one_row_or_nests_loops(spark):
    held = spark.range(100).selectExpr("id % 3 as seg", "concat('k', id) as key", "1 as kind", "'v' as value")
    acts = spark.createDataFrame([(0, i, 1, i, 5) for i in range(9)], ACTIONS)
    for df in (blocks.pack_blocks(held), manifest.compact(acts), bloom.filtered_get(held, bloom.build(held), held.select("key")), segments.rotate_distinct(spark.createDataFrame([(1, 5)], "seq long, size long"), 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Cartesian" not in plan


def test_probes_meet_the_sketches_of_all_segments_by_an_equality(spark):
    held = spark.range(4000).selectExpr("id % 40 as seg", "concat('k', id % 300 + id % 40) as key", "1 as kind", "'v' as value").distinct()
    probes = held.select("key").distinct().unionByName(spark.createDataFrame([("k7",), ("none",), (None,)], "key string"))
    got = bloom.filtered_get(held, bloom.build(held), probes)
    want = held.join(probes, "key").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_are_tested_in_bounded_tiles_with_equal_results(spark, monkeypatch):
    held = spark.range(6000).selectExpr("if(id % 7 = 0, 99, id % 130) as seg", "concat('k', id % 700) as key", "1 as kind", "'v' as value").distinct()
    sketch = bloom.build(held)
    assert sketch.count() == 130 and sketch.where("octet_length(sketch) * 8 != bits").count() == 0  # a row a segment, not a row a bit
    probes = held.select("key").distinct().unionByName(spark.range(3000).selectExpr("concat('no', id) as key")).unionByName(spark.createDataFrame([("k7",)], "key string"))

    def bit_by_bit():
        raw, keys = sketch.collect(), probes.select("key", bloom.hashed(F.col("key"), 7).alias("h")).distinct().collect()
        return {(r["seg"], k["key"]) for r in raw for k in keys if all(r["sketch"][p >> 3] >> (p & 7) & 1 for p in (h % r["bits"] for h in k["h"]))}

    want, mine = bit_by_bit(), {(r["seg"], r["key"]) for r in held.collect()}
    assert mine <= want and len(want) > len(mine)
    for bits, asked in ((1 << 25, 1 << 17), (1 << 13, 500)):
        monkeypatch.setattr(bloom, "TILE_BITS", bits)
        monkeypatch.setattr(bloom, "TILE_PROBES", asked)
        assert sorted(map(tuple, bloom.passing(sketch, probes).collect())) == sorted(want)
        for r in bloom.tally(held, sketch, probes).collect():
            here = {k for s, k in want if s == r["seg"]}
            assert r["passed"] == len(here) and r["held"] == r["found"] == len({k for s, k in mine if s == r["seg"]})
        got = bloom.filtered_get(held, sketch, probes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, held.join(probes, "key").select(*got.columns).collect()))
    gone = sketch.withColumn("sketch", F.expr("unhex(repeat('00', int(bits / 8)))"))
    assert bloom.filtered_get(held, gone, probes).count() == 0  # the sketches decide


@pytest.mark.parametrize("rows, live, nxt", [
    ([(0, 0, 1, 1, 5), (0, 1, 1, 2, 5), (0, 2, 2, 1, None)], [2], 3), ([(0, 0, 1, 7, 5), (0, 1, 1, 3, 5)], [3, 7], 8), ([], [], 0),
    ([(0, 0, 1, 1, 5), (1, 0, 2, 1, None), (2, 0, 1, 1, 9)], [1], 2), ([(0, 0, 2, 4, None)], [], 0)])
def test_manifest_folds(spark, rows, live, nxt):
    a = spark.createDataFrame(rows, ACTIONS)
    assert sorted(r["file_id"] for r in manifest.live(a).collect()) == live
    assert manifest.next_file_id(a).first()[0] == nxt
    assert [r["file_id"] for r in manifest.compact(a).orderBy("ord").collect()] == live


def test_sequence_numbers_without_a_single_task(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as t", "id")
    got = changelog.number_rows(df, ["t"], 11, str(tmp_path / "staged"))
    assert [(r["t"], r["seq"]) for r in got.orderBy("seq").collect()] == [(i, i + 11) for i in range(1000)]


def test_scalars(spark):
    r = spark.range(5, 6).select(S.make_key(F.col("id")).alias("k"), S.make_value(F.col("id"), 31).alias("v"), S.make_value(F.col("id"), 9).alias("cut"), S.pseudo_random_index(F.col("id"), 97).alias("i"),
                                 S.id_of_name(F.lit("wal_12.log"), r"^wal_(\d+)\.log$").alias("w"), S.id_of_name(F.lit("junk"), r"^wal_(\d+)\.log$").alias("n"), S.segment_name(F.col("id")).alias("s")).first()
    assert r["k"] == f"key-{5:020}" and bytes(r["v"]) == f"value-{5:020}:".encode() + bytes((5 + o) % 251 for o in range(27, 31)) and bytes(r["cut"]) == b"value-000"
    assert r["i"] == (5 * 6364136223846793005 + 1442695040888963407) % 2 ** 64 % 97 and r["w"] == 12 and r["n"] is None and r["s"] == f"{5:020}.sst"


def test_workload_end_states(spark):
    m = workloads.mixed(spark, 1000, 500).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in m} == {"get": 500, "put": 500}
    assert resolve.resolved(workloads.writes(spark, 100, 40)).count() == 100


def test_key_filter_reaches_the_scan(spark, tmp_path):
    log(spark, ROWS).write.parquet(str(tmp_path / "log"))
    plan = resolve.get(spark.read.parquet(str(tmp_path / "log")), "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan


def test_streaming_batches_become_segments(spark, tmp_path):
    schema = "seq long, kind int, key string, value string"
    for i, rows in enumerate(([(1, 1, "a", "1"), (2, 1, "a", "2")], [(3, 2, "a", None), (4, 1, "b", "3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    held = spark.read.parquet(str(tmp_path / "out"))
    assert held.count() == 3 and {(r["key"], r["value"]) for r in resolve.resolved(held.withColumn("seg", F.col("seg").cast("long"))).collect()} == {("b", "3")}
    s = latest(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination()
    assert {(r["key"], r["kind"]) for r in spark.sql("select * from newest").collect()} == {("a", 2), ("b", 1)}
