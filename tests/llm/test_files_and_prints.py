import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from sediment.llm import imatch, warc
from sediment.llm.catalogue import ORACLES, QUERIES
from sediment.llm.common import new_path
from tests.llm.conftest import ROWS
from tests.oracle import compare


def test_op7_equals_sql(spark, small):
    compare(spark, QUERIES["op7_warc"], ORACLES["op7_warc"], small)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunks_round_trip(payload, size):
    assert warc.dechunk(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcX0\r\n\r\n", b"-1\r\n"])
def test_damaged_chunks(body):
    with pytest.raises(ValueError):
        warc.dechunk(body)


def pages(spark):
    long = "".join(f"<p>{i}</p>" for i in range(30000))
    rows = [(1, "http://a/ b\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 1000), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "é", "日本" * 600),
            (10, "u", long), (None, "u", "y" * 2000), (11, "u", "z" * 5000), (11, "u", "z" * 5000), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 3000)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, type string"), rows


def test_odd_pages_round_trip(spark):
    df, rows = pages(spark)
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (-1 if r["page_id"] is None else r["page_id"]))
    want = []
    for i, _, h in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        body = (h or "").encode()
        m = max((r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None), default=None)
        again = len(body) >= 1000 and m != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", m if again else None, None))
    assert [tuple(r) for r in got] == want
    assert warc.round_trip(df.where("1 = 0")).count() == 0


def test_segments_are_cut_and_joined(spark):
    df, rows = pages(spark)
    path = new_path(spark, "warc")
    warc.write_warc(df, path, segment_bytes=700)
    found = warc.read_records(spark, path)
    assert found.where("type = 'continuation'").count() > 100
    whole = {r["record_id"].split(":")[2]: r for r in warc.payloads(warc.reassemble(found.orderBy("block"))).collect()}
    assert bytes(whole["10"]["payload"]) == rows[7][2].encode() and whole["8"]["type"] == "revisit"
    lost = warc.payloads(warc.reassemble(found.where("segment is null or segment != 2"))).where("error is not null").collect()
    assert lost and all(r["payload"] is None and r["error"] in ("missing or repeated segment", "no total length") for r in lost)
    short = warc.payloads(warc.reassemble(found.withColumn("total_length", found["total_length"] + 1))).where("error = 'wrong total length'")
    assert short.count() > 0


def test_damaged_records_raise():
    for bad in (b"", b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


def test_imatch_equals_brute_force_edits(spark, small):
    got = QUERIES["op5_imatch"](spark, small).toPandas().set_index("doc_id")
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    for k, (i, t) in enumerate(zip(docs.doc_id, docs.text)):
        n = docs.text[(k + 1) % len(docs)]
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert got.n_chars[i] == len(t) and got.edited_sha256[i] == hashlib.sha256(e.encode()).hexdigest()
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    prints = docs.assign(fp=docs.doc_id.map(got.fingerprint)).groupby("text").fp.nunique()
    assert (prints == 1).all() and got.fingerprint.nunique() == docs.text.nunique()
    assert (got.near_edited > got.near_next).mean() > 0.75


def test_imatch_parts_follow_the_lexicons(spark):
    """Fingerprints against a plain computation of the same parts."""
    import xxhash
    texts = ["alpha beta gamma", "beta gamma alpha alpha", "alpha beta delta", "unseen", "Alpha, BETA; gamma!", "gamma epsilon"] * 2
    texts += [f"filler{i} pad{i}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lex = imatch.lexicon(df, len(texts))
    held = {r["term"]: r["mark"] for r in lex.collect()}
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(df, ["doc_id"], "text", lex).collect()}

    def blank_or(marks):
        seed = 42
        for m in marks:
            seed = xxhash.xxh64_intdigest(int(m).to_bytes(8, "little"), seed)
        return f"{seed:016x}"[8:] if marks else imatch.BLANK
    for i, t in enumerate(texts):
        marks = sorted({held[w] for w in t.lower().replace(",", "").replace(";", "").replace("!", "").split() if w in held})
        parts, shift = [blank_or(marks)], 0
        for bits, count in imatch.LEVELS:
            parts += [blank_or([m for m in marks if m >> shift & (1 << bits) - 1 == k]) for k in range(count)]
            shift += bits
        if marks:
            assert got[i] == "".join(parts)
    assert got[0] == got[1] == got[4] and got[0] != got[2]


def test_imatch_of_odd_documents(spark, odd, empty):
    got = imatch.edits(odd).toPandas()
    assert len(got) == len(ROWS) and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got[got.doc_id == 9].fingerprint.nunique() == 1 and got[got.doc_id.isin([1, 3])].fingerprint.nunique() == 1
    assert imatch.edits(empty).count() == 0
    one = imatch.edits(odd.where("doc_id = 5")).collect()[0]
    assert one["near_next"] == 1.0


def test_imatch_runs_no_python(spark, odd):
    plan = imatch.edits(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_keeps_columns_and_clean_documents(spark, small):
    import corpus_pipeline as P
    from sediment.llm.common import stage, table
    docs = table(spark, small, "documents").selectExpr("*", "1 as accepted", "2 as predicted", "'a' as _mark")
    labels = {r["doc_id"]: r for r in table(spark, small, "labels").collect()}
    seen = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, function in P.STAGES[:3]:
        before = docs.columns
        docs = stage(function(spark, docs, small), name)
        assert docs.columns == before
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert seen[-1] < seen[-2]
    good = {i for i in seen[0] & set(labels) if labels[i]["quality"] == 1}
    assert len(good - seen[1]) <= 0.01 * len(good)
    clean = {i for i in seen[1] & set(labels) if labels[i]["toxic"] == 0}
    assert len(clean - seen[2]) <= 0.02 * len(clean)
    pieces = P.packing_stage(spark, docs, small)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == seen[3]


def test_pipeline_stages_on_odd_documents(spark, odd, empty, tmp_path):
    import corpus_pipeline as P
    spark.createDataFrame([(5, 1, 0), (9, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for _, function in P.STAGES:
            out = function(spark, docs, str(tmp_path))
            assert out.count() >= 0
