"""Named queries over the test tables, each with the SQL that must give the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.functions import scalars as S
from sediment.model import MANIFEST_ADD, MANIFEST_REMOVE, PUT, TOMBSTONE
from sediment.operators import blocks, bloom, manifest, resolve, segments
from sediment.operators.changelog import events_log, with_sizes
from sediment.plans import recovery, workloads
from sediment.session import ship
from sediment.sources import codec
from sediment.sources.files import Files, read_manifests, read_sstables, read_wal, write_manifests, write_sstables, write_wals
from sediment.sources.staging import folder, staged


def _events(spark: SparkSession, d: str, per_segment: int = 50) -> DataFrame:
    return events_log(spark.read.parquet(f"{d}/events.parquet"), per_segment)


def _actions(log: DataFrame) -> DataFrame:
    """A manifest history: every segment added, every third and the last one removed later."""
    meta = segments.segment_meta(log)
    last = log.agg(F.max("seg").alias("_last"))
    adds = meta.select(F.lit(0).cast("long").alias("manifest_id"), F.col("seg").alias("ord"), F.lit(MANIFEST_ADD).alias("action"), F.col("seg").alias("file_id"), "smallest_key", "largest_key", "entries")
    gone = (meta.join(F.broadcast(last), (F.col("seg") % 3 == 0) | (F.col("seg") == F.col("_last")))
            .select(F.lit(1).cast("long").alias("manifest_id"), F.col("seg").alias("ord"), F.lit(MANIFEST_REMOVE).alias("action"), F.col("seg").alias("file_id"),
                    F.lit(None).cast("string").alias("smallest_key"), F.lit(None).cast("string").alias("largest_key"), F.lit(None).cast("long").alias("entries")))
    return adds.unionByName(gone)


def latest_state(spark, d):
    return resolve.resolved(_events(spark, d))


def tombstones(spark, d):
    return resolve.tombstones(_events(spark, d))


def point_get(spark, d):
    return resolve.get(_events(spark, d), "user-00000000000000000007")


def _asked(spark, d):
    """Every key ever written, and one that never was."""
    return _events(spark, d).select("key").distinct().unionByName(spark.range(1).select(F.lit("user-missing").alias("key")))


def multi_get(spark, d):
    return resolve.multi_get(_asked(spark, d), _events(spark, d))


def layered_get(spark, d):
    return resolve.layered_get(_events(spark, d))


def layer_hits(spark, d):
    found = resolve.newest(resolve.layers(_events(spark, d)), ["key"], F.struct("seg", "seq"), ["layer"])
    return found.groupBy("layer", "kind").agg(F.count("*").cast("long").alias("keys"))


def segment_scan(spark, d):
    return resolve.dedupe_segments(_events(spark, d)).select("seg", "key", "kind", "value")


def range_scan(spark, d):
    return resolve.scan(_events(spark, d), "user-00000000000000000003", "user-00000000000000000012")


def segment_meta(spark, d):
    return segments.segment_meta(_events(spark, d))


def memtable_size(spark, d):
    return segments.memtable_sizes(_events(spark, d))


def flush(spark, d):
    return segments.flush_oldest(_events(spark, d)).select("seg", "key", "kind", "value")


def manifest_live(spark, d):
    return manifest.live(_actions(_events(spark, d)))


def manifest_next_id(spark, d):
    a = _actions(_events(spark, d))
    return manifest.next_file_id(a).join(manifest.next_manifest_id(a), F.lit(True))


def manifest_compact(spark, d):
    return manifest.compact(_actions(_events(spark, d)))


def current_state(spark, d):
    return recovery.current_state(_events(spark, d))


def wal_replay(spark, d):
    return recovery.replay_summary(_events(spark, d))


def recover(spark, d):
    return recovery.recovered(_events(spark, d))


def _orders(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    key = S.make_key(F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("seq"), key.alias("key"), F.col("o_orderpriority").alias("value"))


ROTATE_AT = 65536


def rotation(spark, d):
    return segments.rotate_distinct(with_sizes(_orders(spark, d)), ROTATE_AT).select("seg", "last_seq", "bytes")


def rotation_overwrites(spark, d):
    ship(spark)
    return segments.rotation_points(with_sizes(_events(spark, d)), 2048).select("seg", "last_seq", "bytes")


def block_index(spark, d):
    return blocks.pack_blocks(resolve.dedupe_segments(_events(spark, d, 1000)))


def block_floor(spark, d):
    e = _events(spark, d)
    keys = e.select("key").distinct()
    index = keys.where(F.substring("key", -1, 1) == "7").select(F.col("key").alias("first_key"))
    return blocks.floor_lookup(keys, index)


def bloom_get(spark, d):
    held = staged(resolve.dedupe_segments(_events(spark, d)), "held")
    return bloom.filtered_get(held, bloom.build(held), _asked(spark, d)).select("seg", "key", "kind", "value")


def bloom_passing(spark, d):
    """What the sketches let through of ten times the keys that there are: all held ones, and few others."""
    held = staged(resolve.dedupe_segments(_events(spark, d)).select("seg", "key"), "held")
    asked = _asked(spark, d)
    others = asked.select(F.explode(F.array(*[F.concat("key", F.lit(f"-{i}")) for i in range(9)])).alias("key"))
    got = bloom.tally(held, bloom.build(held), asked.unionByName(others))
    room = asked.count() * 10
    return got.select("seg", "held", (F.col("held") - F.col("found")).alias("missed"), (F.col("passed") - F.col("found") <= 0.05 * room).alias("few_false"))


def _files(spark) -> Files:
    return Files(ship(spark), folder(spark, "byte-files"))


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "binary"})


def wal_files(spark, d):
    """The change log written as log files and replayed from them."""
    files = _files(spark)
    write_wals(_events(spark, d, 1000), files, "wal")
    return _as_text(read_wal(spark, f"{files.root}/wal"))


def sstable_files(spark, d):
    """Sorted segments written as segment files and scanned."""
    files = _files(spark)
    write_sstables(resolve.dedupe_segments(_events(spark, d, 1000)).withColumnRenamed("seg", "file_id"), files, "sst")
    return _as_text(read_sstables(spark, f"{files.root}/sst"))


def manifest_files(spark, d):
    """The manifest history written as files, read back and folded, level and size among its fields."""
    log, files = _events(spark, d), _files(spark)
    sizes = segments.memtable_sizes(log).select(F.col("seg").alias("file_id"), F.col("bytes").alias("file_size"))
    acts = _actions(log).join(sizes, "file_id").withColumn("level", (F.col("file_id") % 3).cast("int")).drop("entries")
    write_manifests(acts, files, "manifest")
    return _as_text(manifest.live(read_manifests(spark, f"{files.root}/manifest")))


def current_file(spark, d):
    """The four next ids written to the pointer file, replaced once, and read back."""
    files, row = _files(spark), recovery.current_state(_events(spark, d)).first().asDict()
    files.write("CURRENT", codec.encode_state(dict.fromkeys(row, 0)).encode())
    files.write("CURRENT", codec.encode_state(row).encode())
    state = codec.decode_state(files.read("CURRENT").decode())
    return spark.createDataFrame([tuple(state[k] for k in row)], ", ".join(f"{k} long" for k in row))


def crash_verify(spark, d):
    e = _events(spark, d)
    acked = e.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("v")).where(F.col("v.kind") == PUT).select("key", "v.value")
    return resolve.unanswered(acked, e).agg(F.count("*").cast("long").alias("mismatches"))


def random_index(spark, d):
    return workloads.reads(spark, 20000, 20000)


def mixed_workload(spark, d):
    return (workloads.mixed(spark, 20000, 10000).groupBy("action")
            .agg(F.count("*").cast("long").alias("ops"), F.countDistinct("index").cast("long").alias("distinct_keys"), F.sum("index").cast("long").alias("index_sum")))


def value_gen(spark, d):
    i = F.col("id")
    return spark.range(2000).select(S.make_key(i).alias("key"), F.hex(S.make_value(i, 64)).alias("value_hex"))


def write_workload(spark, d):
    """The published write load: closed-form end state at a 1 MiB threshold."""
    sized = spark.range(20000).select((F.col("id") + 1).alias("seq"), (F.octet_length(S.make_key(F.col("id"))) + 1 + 256).cast("long").alias("size"))
    return segments.rotate_distinct(sized, 1 << 20).select("seg", "last_seq", "bytes")


def read_workload(spark, d):
    """Pseudo-random batch gets against loaded orders, as many as there are keys and at least 20,000: (op, index, value)."""
    o = _orders(spark, d).select((F.col("seq")).alias("index"), "value")
    keys = o.count()
    return workloads.reads(spark, max(20000, keys), keys).join(o, "index", "left").select("op", "index", "value")


def hot_index(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    hint = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("key_hash"), F.floor(F.col("event_id") / 50).cast("long").alias("page_id"))
    return workloads.publish(hint("click"), hint("view"))


def wal_checksum(spark, d):
    """XXH3 over each put's key and value, and whether a flipped byte is noticed."""
    payload = F.concat(F.col("key").cast("binary"), F.coalesce(F.col("value"), F.lit("")).cast("binary"))
    e = _events(ship(spark), d).select("seq", payload.alias("b"), F.concat(payload, F.lit(b"\x01")).alias("bad"))
    return e.select("seq", S.xxh3("b").alias("checksum"), (S.xxh3("b") != S.xxh3("bad")).alias("tamper_seen"))


_CL = """cl as (select floor(event_id/{n})::bigint seg, (event_id+1)::bigint seq, case when event_type='error' then 2 else 1 end kind,
 'user-'||lpad(user_id::varchar,20,'0') as key, case when event_type<>'error' then props end as value from events)"""
CL = _CL.format(n=50)
SST = "sst as (select seg,key,kind,value from (select *, row_number() over (partition by seg,key order by seq desc) r from cl) where r=1)"
TOP = "top as (select * from (select *, row_number() over (partition by key order by seg desc, seq desc) r from cl) where r=1)"
META = "meta as (select seg, min(key) smallest_key, max(key) largest_key, count(*)::bigint entries from sst group by seg)"
ACTS = """acts as (select 0 manifest_id, seg ord, 1 action, seg file_id, smallest_key, largest_key, entries from meta
 union all select 1, seg, 2, seg, null, null, null from meta where seg%3=0 or seg=(select max(seg) from cl))"""
LIVE = "live as (select * from (select *, row_number() over (partition by file_id order by manifest_id desc, ord desc) r from acts) where r=1 and action=1)"
_MULL = "((op::hugeint*6364136223846793005::hugeint+1442695040888963407::hugeint)%18446744073709551616::hugeint)"
_FOLD = """with recursive o as (select row_number() over (order by seq) i, * from ({src})),
 f as (select i, seq, size::bigint as acc, 0::bigint as seg, (size>={t}) as cut from o where i=1
  union all select o.i, o.seq, (case when f.cut then o.size else f.acc+o.size end)::bigint, (f.seg+case when f.cut then 1 else 0 end)::bigint,
  (case when f.cut then o.size else f.acc+o.size end)>={t} from f join o on o.i=f.i+1)
 select seg, max(seq)::bigint last_seq, max(acc)::bigint bytes from f group by seg"""

CATALOGUE = {
    "kv_latest_state": (latest_state, f"with {CL}, {TOP} select key, value from top where kind=1"),
    "kv_tombstones": (tombstones, f"with {CL}, {TOP} select key from top where kind=2"),
    "kv_point_get": (point_get, f"with {CL}, {TOP} select key, value from top where kind=1 and key='user-00000000000000000007'"),
    "kv_multi_get": (multi_get, f"with {CL}, {TOP}, asked as (select distinct key from cl union all select 'user-missing') select a.key, t.value from asked a left join top t on t.key=a.key and t.kind=1"),
    "kv_layered_get": (layered_get, f"with {CL}, {TOP}, m as (select max(seg) m from cl) select key, value, seg, case when seg=m then 'active' when seg>=m-4 then 'immutable' else 'sstable' end as layer from top, m where kind=1"),
    "kv_layer_hits": (layer_hits, f"with {CL}, {TOP}, m as (select max(seg) m from cl) select case when seg=m then 'active' when seg>=m-4 then 'immutable' else 'sstable' end as layer, kind, count(*)::bigint as keys from top, m group by 1,2"),
    "kv_segment_scan": (segment_scan, f"with {CL}, {SST} select seg,key,kind,value from sst"),
    "kv_range_scan": (range_scan, f"with {CL}, {TOP} select key, value from top where kind=1 and key>='user-00000000000000000003' and key<'user-00000000000000000012'"),
    "kv_segment_meta": (segment_meta, f"with {CL}, {SST}, {META} select * from meta"),
    "kv_memtable_size": (memtable_size, f"with {CL}, {SST} select seg, count(*)::bigint as entries, sum(strlen(key)+1+coalesce(strlen(value),0))::bigint as bytes from sst group by seg"),
    "kv_flush": (flush, f"with {CL}, {SST} select seg,key,kind,value from sst where seg=greatest((select max(seg) from cl)-4,0) and seg<(select max(seg) from cl)"),
    "kv_manifest_live": (manifest_live, f"with {CL}, {SST}, {META}, {ACTS}, {LIVE} select file_id, smallest_key, largest_key, entries from live"),
    "kv_manifest_next_id": (manifest_next_id, f"with {CL}, {SST}, {META}, {ACTS}, {LIVE} select (select coalesce(max(file_id)+1,0)::bigint from live) as next_sstable_id, (select coalesce(max(manifest_id)+1,0)::bigint from acts) as next_manifest_id"),
    "kv_manifest_compact": (manifest_compact, f"with {CL}, {SST}, {META}, {ACTS}, {LIVE} select 2::bigint as manifest_id, (row_number() over (order by file_id)-1)::bigint as ord, 1 as action, file_id, smallest_key, largest_key, entries from live"),
    "kv_current_state": (current_state, f"with {CL} select greatest(max(seg)-4,0)::bigint as next_sstable_id, (max(seg)+1)::bigint as next_wal_id, 1::bigint as next_manifest_id, (max(seq)+1)::bigint as next_sequence_id from cl"),
    "kv_wal_replay": (wal_replay, f"with {CL} select seg, count(*)::bigint as records, min(seq) as min_seq, max(seq) as max_seq, sum(29+strlen(key)+coalesce(strlen(value),0))::bigint as log_bytes from cl group by seg"),
    "kv_recovery": (recover, f"with {CL}, late as (select * from cl where seg>=(select max(seg) from cl)-4), t as (select *, row_number() over (partition by key order by seg desc, seq desc) r from late) select key, value from t where r=1 and kind=1"),
    "kv_rotation": (rotation, _FOLD.format(t=ROTATE_AT, src="select o_orderkey as seq, 24+1+strlen(o_orderpriority) as size from orders")),
    "kv_rotation_overwrites": (rotation_overwrites, f"""with recursive {CL}, o as (select row_number() over (order by seq) i, seq, (strlen(key)+1+coalesce(strlen(value),0))::bigint as size,
  lag(seq) over (partition by key order by seq) as old_seq, lag(strlen(key)+1+coalesce(strlen(value),0)) over (partition by key order by seq) as old_size from cl),
 f as (select i, seq, size as acc, 0::bigint as seg, size>=2048 as cut, seq as opened from o where i=1
  union all select o.i, o.seq, (case when f.cut then o.size else f.acc+o.size-case when o.old_seq>=f.opened then o.old_size else 0 end end)::bigint, (f.seg+case when f.cut then 1 else 0 end)::bigint,
  (case when f.cut then o.size else f.acc+o.size-case when o.old_seq>=f.opened then o.old_size else 0 end end)>=2048, case when f.cut then o.seq else f.opened end from f join o on o.i=f.i+1)
 select seg, max(seq)::bigint as last_seq, arg_max(acc, seq)::bigint as bytes from f group by seg"""),
    "kv_block_index": (block_index, f"""with recursive {_CL.format(n=1000)}, {SST}, o as (select seg, key, (9+strlen(key)+coalesce(strlen(value),0))::bigint as size, row_number() over (partition by seg order by key) i from sst),
 f as (select seg, i, key as first_key, 0::bigint as block_id, (4+size)::bigint as bytes, 1::bigint as entries from o where i=1
  union all select o.seg, o.i, case when f.bytes+o.size>4096 then o.key else f.first_key end, (f.block_id+case when f.bytes+o.size>4096 then 1 else 0 end)::bigint,
  (case when f.bytes+o.size>4096 then 4+o.size else f.bytes+o.size end)::bigint, (case when f.bytes+o.size>4096 then 1 else f.entries+1 end)::bigint from f join o on o.seg=f.seg and o.i=f.i+1)
 select seg, block_id, first_key, max(entries)::bigint as entries, max(bytes)::bigint as bytes from f group by seg, block_id, first_key"""),
    "kv_block_floor": (block_floor, f"with {CL}, k as (select distinct key from cl), x as (select key as first_key from k where right(key,1)='7') select k.key, x.first_key from k asof left join x on k.key>=x.first_key"),
    "kv_bloom_get": (bloom_get, f"with {CL}, {SST} select seg, key, kind, value from sst"),
    "kv_bloom_passing": (bloom_passing, f"with {CL}, {SST} select seg, count(*)::bigint as held, 0::bigint as missed, true as few_false from sst group by seg"),
    "kv_wal_files": (wal_files, f"with {_CL.format(n=1000)} select seg as wal_id, (row_number() over (partition by seg order by seq)-1)::bigint as pos, seq, kind, key, value from cl"),
    "kv_sstable_files": (sstable_files, f"with {_CL.format(n=1000)}, {SST} select seg as file_id, key, kind, value from sst"),
    "kv_manifest_files": (manifest_files, f"with {CL}, {SST}, {META}, {ACTS}, {LIVE}, b as (select seg, sum(strlen(key)+1+coalesce(strlen(value),0))::bigint as file_size from sst group by seg) select file_id, (file_id%3)::bigint as level, smallest_key, largest_key, file_size from live join b on b.seg=file_id"),
    "kv_current_file": (current_file, f"with {CL} select greatest(max(seg)-4,0)::bigint as next_sstable_id, (max(seg)+1)::bigint as next_wal_id, 1::bigint as next_manifest_id, (max(seq)+1)::bigint as next_sequence_id from cl"),
    "kv_crash_verify": (crash_verify, f"with {CL}, {TOP}, acked as (select key, arg_max(kind,seq) k, arg_max(value,seq) filter (where true) v from cl group by key) select count(*)::bigint as mismatches from acked a left join top t on t.key=a.key and t.kind=1 where a.k=1 and (t.key is null or a.v is distinct from t.value)"),
    "kv_random_index": (random_index, f"select op, ({_MULL}%20000)::bigint as index from range(20000) t(op)"),
    "kv_mixed_workload": (mixed_workload, f"with m as (select case when op%100<50 then 'get' else 'put' end as action, case when op%100<50 then ({_MULL}%10000)::bigint else op+10000 end as index from range(20000) t(op)) select action, count(*)::bigint as ops, count(distinct index)::bigint as distinct_keys, sum(index)::bigint as index_sum from m group by action"),
    "kv_value_gen": (value_gen, "select 'key-'||lpad(i::varchar,20,'0') as key, hex(('value-'||lpad(i::varchar,20,'0')||':')::blob)||(select string_agg(printf('%02X',((i+o)%251)::int),'' order by o) from range(27,64) r(o)) as value_hex from range(2000) t(i)"),
    "kv_write_workload": (write_workload, "with w as (select i+1 as seq, (i//3732)::bigint as seg from range(20000) t(i)) select seg, max(seq)::bigint as last_seq, (count(*)*281)::bigint as bytes from w group by seg"),
    "kv_read_workload": (read_workload, f"with n as (select count(*)::bigint as n from orders), r as (select op, ({_MULL}%n)::bigint as index from (select unnest(range(greatest(20000, n))) as op, n from n)) select r.op, r.index, o.o_orderpriority as value from r left join orders o on o.o_orderkey=r.index"),
    "kv_hot_index": (hot_index, "select user_id as key_hash, floor(event_id/50)::bigint as page_id from events where event_type='click' union all select user_id, floor(event_id/50)::bigint from events where event_type='view'"),
    "kv_wal_checksum": (wal_checksum, None),
}
