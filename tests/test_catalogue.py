import pytest

from sediment.plans.catalogue import CATALOGUE
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", [k for k, (_, sql) in CATALOGUE.items() if sql])
def test_query_matches_sql(spark, name):
    query, sql = CATALOGUE[name]
    compare(spark, query, sql)


def test_rotation_with_overwrites_matches_a_plain_fold(spark):
    from sediment.operators.changelog import events_log, with_sizes

    log = with_sizes(events_log(spark.read.parquet(f"{DATA}/events.parquet"))).orderBy("seq").collect()
    want, held, total, seg = [], {}, 0, 0
    for r in log:
        total += r["size"] - held.get(r["key"], 0)
        held[r["key"]] = r["size"]
        if total >= 2048:
            want.append((seg, r["seq"], total))
            held, total, seg = {}, 0, seg + 1
    if held:
        want.append((seg, log[-1]["seq"], total))
    got = [tuple(r) for r in CATALOGUE["kv_rotation_overwrites"][0](spark, DATA).orderBy("seg").collect()]
    assert got == want


def test_checksums_are_those_of_the_library(spark):
    import xxhash

    from sediment.model import WAL_CHECKSUM_SEED
    from sediment.operators.changelog import events_log

    got = {r["seq"]: r for r in CATALOGUE["kv_wal_checksum"][0](spark, DATA).collect()}
    log = events_log(spark.read.parquet(f"{DATA}/events.parquet")).collect()
    assert len(got) == len(log) and all(r["tamper_seen"] for r in got.values())
    for r in log:
        want = xxhash.xxh3_64_intdigest((r["key"] + (r["value"] or "")).encode(), seed=WAL_CHECKSUM_SEED)
        assert got[r["seq"]]["checksum"] % 2 ** 64 == want
