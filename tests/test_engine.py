"""A store's behaviour across writes, flushes and reopening."""
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from sediment.model import CorruptFormat, EngineConfig
from sediment.plans.engine import Engine, Memtable
from sediment.sources import codec
from sediment.sources.files import Files, read_manifests, read_wal


@pytest.fixture
def opened(spark, tmp_path):
    def make(threshold=8, most=0):
        return Engine(spark, EngineConfig(str(tmp_path / "store"), threshold, most))
    return make


def test_active_read(opened):
    e = opened()
    e.put(b"a", b"1")
    assert e.get(b"a") == b"1" and e.get(b"missing") is None


def test_flush_newest_and_tombstone(opened):
    e = opened()
    e.put(b"alpha", b"one")
    assert (e.sstable_count(), e.memtable_size(), e.get(b"alpha")) == (1, 0, b"one")
    meta = e.manifest_sstables().collect()
    assert [(m["file_id"], bytes(m["smallest_key"]), bytes(m["largest_key"])) for m in meta] == [(0, b"alpha", b"alpha")]
    assert {k: e.state[k] for k in ("next_sstable_id", "next_wal_id", "next_manifest_id", "next_sequence_id")} == {"next_sstable_id": 1, "next_wal_id": 2, "next_manifest_id": 1, "next_sequence_id": 2}
    e.put(b"alpha", b"two")
    assert e.sstable_count() == 2 and e.get(b"alpha") == b"two"
    e.delete(b"alpha")
    e.flush_memtable()
    assert e.get(b"alpha") is None


def test_immutable_reads_without_flush(opened):
    e = opened(8, 4)
    e.put(b"alpha", b"one")
    assert (e.sstable_count(), e.immutable_memtable_count(), e.get(b"alpha")) == (0, 1, b"one")


def test_empty_value_is_no_tombstone(opened):
    e = opened(4096, 4)
    e.put(b"", b"")
    e.put(b"\xff", b"x")
    e.delete(b"never")
    assert e.get(b"") == b"" and e.get(b"never") is None and e.get(b"\xff") == b"x" and e.state["next_sequence_id"] == 4


def test_reopening_continues_ids_and_recovers(opened):
    e = opened()
    e.put(b"alpha", b"one")
    e = opened()
    e.put(b"beta", b"two")
    assert [m["file_id"] for m in e.manifest_sstables().collect()] == [0, 1]
    assert e.get(b"alpha") == b"one" and e.state["next_sstable_id"] == 2 and e.state["next_wal_id"] == 4


@pytest.mark.parametrize("threshold, most, queued", [(4096, 0, 0), (8, 4, 1)])
def test_recovery_from_logs(opened, threshold, most, queued):
    e = opened(threshold, most)
    e.put(b"alpha", b"one")
    e = opened(threshold, most)
    assert e.get(b"alpha") == b"one" and e.sstable_count() == 0 and e.immutable_memtable_count() == queued
    assert (e.memtable_size() > 0) == (queued == 0)
    e = opened(threshold, most)  # also survives a second restart
    assert e.get(b"alpha") == b"one" and e.sstable_count() == 0
    e.put(b"beta", b"two")
    assert e.state["next_sequence_id"] == 3


def test_torn_log_tail_is_ignored(opened):
    e = opened(4096, 4)
    e.put(b"a", b"1")
    e.put(b"b", b"2")
    name = f"wal/wal_{e.wal_id}.log"
    e.files.write(name, e.files.read(name)[:-3])
    e = opened(4096, 4)
    assert e.get(b"a") == b"1" and e.get(b"b") is None


def test_published_end_states(opened):
    e = opened(1 << 20, 0)
    e.write([(f"key-{i:020}".encode(), bytes(256)) for i in range(8000)])
    assert (e.sstable_count(), e.memtable_size()) == (2, (8000 - 2 * 3732) * 281)
    assert e.get(b"key-00000000000000000005") == bytes(256)


def test_load_and_batch_reads(spark, opened):
    e = opened(4096, 4)
    e.put(b"k1", b"old")
    e.load(spark.createDataFrame([(bytearray(f"k{i}".encode()), 1, bytearray(b"v")) for i in range(50)], "key binary, kind int, value binary"))
    e.delete(b"k2")
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"k1", b"k2", b"zz")], "key binary")
    assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in e.multi_get(keys).collect()} == {b"k1": b"v", b"k2": None, b"zz": None}
    assert e.resolved().count() == 49
    e.compact_manifest()
    assert e.sstable_count() == 2 and len(e.files.list("manifest")) == 1


def test_files_read_as_tables(spark, opened):
    e = opened(40, 1)
    for i in range(12):
        e.put(f"key{i}".encode(), b"v" * 9)
    e.delete(b"key0")
    logs = read_wal(spark, f"{e.data_dir}/wal").orderBy("wal_id", "pos").collect()
    assert [r["seq"] for r in logs] == sorted(r["seq"] for r in logs) and logs[-1]["value"] is None
    assert read_manifests(spark, f"{e.data_dir}/manifest").count() == e.sstable_count()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("wwwdfr"), st.binary(max_size=2), st.binary(max_size=6)), max_size=14))
def test_store_equals_a_dict(spark, tmp_path_factory, ops):
    config, model = EngineConfig(str(tmp_path_factory.mktemp("s")), 24, 1), {}
    e = Engine(spark, config)
    for op, k, v in ops:
        if op == "w":
            e.put(k, v)
            model[k] = v
        elif op == "d":
            e.delete(k)
            model.pop(k, None)
        elif op == "f":
            e.flush_memtable()
        else:
            e = Engine(spark, config)
    assert {bytes(r["key"]): bytes(r["value"]) for r in e.resolved().collect()} == model
    assert all(e.get(k) == model.get(k) for _, k, _ in ops)


def test_memtable_accounts_exactly():
    t = Memtable()
    t.write(b"a", 1, b"1")
    assert t.size == 3
    t.write(b"a", 1, b"longer")
    assert t.size == 8 and len(t) == 1
    t.write(b"a", 2, None)
    assert t.size == 2 and t[b"a"] == (2, None)


# byte formats

entries = st.dictionaries(st.binary(max_size=12), st.one_of(st.none(), st.binary(max_size=40)), max_size=60).map(lambda d: [(k, 2 if v is None else 1, v) for k, v in sorted(d.items())])


@settings(max_examples=60, deadline=None)
@given(entries, st.integers(40, 400))
def test_sorted_file_round_trip(rows, target):
    data = codec.encode_sstable(rows, target)
    assert list(codec.scan_sstable(data)) == rows
    index, bloom = codec.open_sstable(data)
    assert all(bloom.contains(k) and codec.get_sstable(data, k) == (kind, v) for k, kind, v in rows)
    for k in (b"", b"\x00", b"zzz", b"\xff" * 13):
        assert codec.get_sstable(data, k) == next(((kind, v) for x, kind, v in rows if x == k), None)
    for _, o, n in index:
        assert n <= target or len(codec.decode_block(data[o:o + n])) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2 ** 40), st.binary(max_size=9), st.one_of(st.none(), st.binary(max_size=9)))), st.data())
def test_log_round_trip_and_damage(rows, data):
    raw = b"".join(codec.encode_wal(s, 2 if v is None else 1, k, v) for s, k, v in rows)
    assert len(raw) == sum(29 + len(k) + len(v or b"") for _, k, v in rows)
    assert list(codec.decode_wal(raw)) == [(s, 2 if v is None else 1, k, v) for s, k, v in rows]
    if raw:
        at = data.draw(st.integers(0, len(raw) - 1))
        with pytest.raises(CorruptFormat):
            list(codec.decode_wal(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:]))


def test_formats_reject_what_does_not_follow():
    bloom = codec.Bloom(120, (1,))
    bloom.add(b"alpha")
    raw = bloom.encode()
    assert len(raw) == 43 and codec.Bloom.decode(raw).contains(b"alpha") and len(codec.Bloom().encode()) == 84
    meta = (2, b"alpha", b"omega", 4096)
    both = codec.encode_action(1, 7, meta) + codec.encode_action(2, 42)
    assert list(codec.decode_actions(both)) == [(1, 7, *meta), (2, 42, None, None, None, None)]
    assert codec.decode_index(codec.encode_index([(b"a", 10, 20), (b"m", 30, 40)])) == [(b"a", 10, 20), (b"m", 30, 40)]
    assert codec.decode_footer(codec.encode_footer(10, 20, 30, 40)) == (10, 20, 30, 40)
    state = {"next_sstable_id": 7, "next_wal_id": 3, "next_manifest_id": 2, "next_sequence_id": 11}
    assert codec.decode_state(codec.encode_state(state)) == state and codec.decode_state("") == codec.STATE_DEFAULT
    for bad in (lambda: codec.Bloom.decode(raw + b"x"), lambda: codec.Bloom.decode(b"\0" * 43), lambda: list(codec.decode_actions(b"\0" * 30)), lambda: codec.decode_footer(b"\0" * 40),
                lambda: codec.decode_footer(b"x"), lambda: codec.decode_state("a=1"), lambda: codec.decode_state("next_wal_id=x"), lambda: codec.decode_index(b"\1\0\0\0"), lambda: codec.open_sstable(b"short"),
                lambda: codec.encode_sstable([(b"b", 1, b""), (b"a", 1, b"")]), lambda: codec.decode_block(codec.encode_block([(b"a", 1, b"1")]) + b"x")):
        with pytest.raises(CorruptFormat):
            bad()
    assert codec.read_record(b"\x05\0\0\0" + bytes([7, 11, 0, 0, 0])) == (bytes([7, 11, 0, 0, 0]), 9)


def test_small_files(spark, tmp_path):
    f = Files(spark, str(tmp_path))
    f.write("d/x", b"1")
    f.write("d/x", b"\x00\xff")
    assert f.read("d/x") == b"\x00\xff" and f.read("none") is None and f.list("d") == ["x"]
    f.delete("d/x")
    assert f.list("d") == [] and f.list("nowhere") == []
