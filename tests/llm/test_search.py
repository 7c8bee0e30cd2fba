import math

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from sediment.llm import simhash, similar, topk
from sediment.llm.catalogue import ORACLES, QUERIES
from tests.llm.conftest import ROWS
from tests.oracle import compare


def test_op3_equals_sql(spark, small):
    compare(spark, QUERIES["op3_top_k"], ORACLES["op3_top_k"], small)


def brute_top(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        qv = min((v for i, v in ok if i == q), key=lambda v: np.array(v, "<f8").tobytes())
        s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "ties", "few", "large"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    v = {"clusters": rng.normal(0, 0.1, (700, 6)) + rng.integers(0, 4, (700, 1)), "ties": rng.integers(0, 2, (600, 4)) / 4, "few": rng.normal(size=(4, 3)), "large": rng.normal(0, 3e4, (300, 3))}[kind]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 3), (903, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (904, []), (905, [0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=50).collect())
    assert got == brute_top(rows, 5, 50)


@pytest.mark.parametrize("rows", [
    [(i, []) for i in range(0, 300, 20)],
    [(100, [1e7, 1e7]), (200, [3.0, -2.0]), (201, [0.25, 0.5]), (300, [1e-3, 1.0])],
    [(i, [float(i), -1.0]) for i in range(0, 2500)],
])
def test_top_k_of_empty_and_large_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, k=5, every=100).collect()) == brute_top(rows, 5, 100)


def test_top_k_beyond_64_bits(spark):
    most, least = (1 << 63) - 1, -(1 << 63)
    for big in (1e9, 1e200):
        rows = [(0, [big]), (1, [big]), (2, [2 * big]), (3, [-big]), (4, [0.0])]
        got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect())
        assert got == [(0, 1, 1, most), (0, 2, 2, most), (0, 3, 4, 0), (0, 4, 3, least)]


def test_rings_follow_the_root_of_the_vectors():
    for n in (1, 5000, 10 ** 6, 10 ** 9):
        p, r = topk.layout(n)
        assert p * r <= 2 * max(64, math.isqrt(n)) and p * r >= 0.4 * math.isqrt(n)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 120), st.integers(0, 3), st.integers(0, 10 ** 6), st.integers(1, 6))
def test_trees_find_every_link(n, distance, seed, shards):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = base[rng.integers(0, 6, n)].copy()
    for _ in range(3):
        fp ^= np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)
    fp = np.unique(fp)
    old, simhash.LEAF = simhash.LEAF, 4
    try:
        found = simhash._Links(len(fp), most=16)
        rows, at, home = simhash.place(simhash.top_tree(fp[::2], shards), fp, distance)
        assert home.sum() == len(fp)
        for s in range(at.max() + 1):
            some = rows[at == s]
            simhash.search(fp, some[home[at == s]], some, distance, found)
    finally:
        simhash.LEAF = old
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp) <= distance)
    assert found.labels().tolist() == joined(len(fp), near.tolist())


def test_simhash_of_odd_documents(spark, odd, empty):
    got = sorted(((-1 if r[0] is None else r[0]), r[1], r[2]) for r in simhash.near_duplicates(odd).collect())
    fp = [slow_fingerprint(r[1]) for r in ROWS]
    root = joined(len(ROWS), [(a, b) for a in range(len(ROWS)) for b in range(len(ROWS)) if (fp[a] ^ fp[b]).bit_count() <= 2])
    least = {}
    for (i, *_), g in zip(ROWS, root):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((-1 if r[0] is None else r[0]), f"{f:016x}", least.get(g)) for r, f, g in zip(ROWS, fp, root))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_many_shards_in_spark_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 63, 150, dtype=np.uint64)[rng.integers(0, 150, 900)]
    for _ in range(3):
        fp ^= np.where(rng.random(900) < 0.5, np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp) <= 2)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp.view(np.int64))], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, 2, shard=40).collect()}
    assert [got[i] for i in range(900)] == joined(900, near.tolist())


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(300, 301)]
    got = {r["fp"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "fp long, to long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 300: 300, 301: 300}


def test_components_of_shuffled_chains(spark):
    """Random names, so that the least one is far from most; a hop a round would take far over a hundred."""
    name = np.random.default_rng(3).permutation(10 ** 6)[:3000] - 500_000
    edges = [(int(name[i]), int(name[j])) for i in range(2000) for j in range(i + 1, min(i + 4, 2000))] + [(int(name[i]), int(name[i + 1])) for i in range(2000, 2999)]
    got = {r["fp"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "fp long, to long")).collect()}
    assert got == {**{int(x): int(name[:2000].min()) for x in name[:2000]}, **{int(x): int(name[2000:].min()) for x in name[2000:]}}


def jaccard_classes(texts, ids):
    s = [set(similar.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    alike = [(a, b) for a in range(len(s)) for b in range(a) if (not s[a] and not s[b]) or (s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9)]
    return joined(len(s), alike)


def odds(n):
    """Chances of 0 to n heads among n coins."""
    return np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0 ** n


def test_candidate_bound_reaches_pairs_at_the_similarity():
    """The binomial tail beyond the bound, with the chance that a majority bit differs by enumeration."""
    for a in [*range(4, 48), 100, 200]:
        for b in {a, a + 1, a + 2, int(a * 1.25)}:
            c = -(-4 * (a + b) // 9)  # least common shingles of 0.8
            if not c <= a <= b <= 1.25 * a:
                continue
            s = np.arange(c + 1)
            up = [np.array([odds(m - c)[2 * (k + np.arange(m - c + 1)) > m].sum() for k in s]) for m in (a, b)]
            p = float((odds(c) * (up[0] * (1 - up[1]) + up[1] * (1 - up[0]))).sum())
            reach = similar.WIDE_REACH[a <= similar.SHORT]
            assert sum(math.comb(256, k) * p ** k * (1 - p) ** (256 - k) for k in range(reach + 1, 257)) < 1e-10, (a, b)


def test_candidates_in_large_places_are_those_within_the_bound(spark):
    """Among many texts of a place, whose first 64 bits alone would rule some pairs out."""
    rng = np.random.default_rng(2)
    w = rng.integers(0, 1 << 63, (60, 4), dtype=np.uint64)
    w[20:40] = w[:20]
    w[20:40, 0] ^= np.uint64((1 << 30) - 1)  # 30 bits apart, all in the first word
    w[40:] = w[:20]
    w[40:, 1:] ^= np.uint64((1 << 30) - 1)  # 90 bits apart: near for short texts only
    n = np.where(np.arange(60) % 2, 10, 300)
    found = similar._Links(60)
    similar.met_within(w, n, found, step=7)
    a, b = np.triu_indices(60, 1)
    ok = similar.within(w[a], w[b], n[a], n[b])
    assert found.labels().tolist() == joined(60, zip(a[ok].tolist(), b[ok].tolist())) and ok.sum() >= 30
    rows = [(7, i, int(m), x.astype("<u8").tobytes()) for i, (m, x) in enumerate(zip(n, w))]
    stars = similar.candidates(spark.createDataFrame(rows, "place long, key long, n int, wide binary").coalesce(1)).collect()
    assert joined(60, [tuple(r) for r in stars]) == joined(60, zip(a[ok].tolist(), b[ok].tolist()))


def test_similar_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(words, int(rng.integers(6, 220))))
        for e in (0, 0, 1, 2, 3, 6, 30):
            t = list(base)
            for p in rng.integers(0, len(t), e):
                t[p] = str(rng.choice(words))
            texts.append(" ".join(t))
    texts += ["", None, "one", "one", "two words"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    want = jaccard_classes(texts, range(len(texts)))
    old = similar.BLOCK, similar.PLACE, similar.LEADERS
    similar.BLOCK, similar.PLACE, similar.LEADERS = 3, 4, 1
    try:
        got = {r["doc_id"]: r["class_id"] for r in similar.classes(df).collect()}
    finally:
        similar.BLOCK, similar.PLACE, similar.LEADERS = old
    assert [got[i] for i in range(len(texts))] == want
    kept = similar.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_vantage_point_shards_link_all_close_prints(spark, monkeypatch):
    """Made fingerprints over many shards; some are equal under different keys."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    rng = np.random.default_rng(8)
    w = rng.integers(0, 1 << 63, (600, 4), dtype=np.uint64)
    for i in range(200, 500):
        w[i, 0] = w[i - 200, 0]
        for bit in rng.integers(0, 64, i % 4):
            w[i, 0] ^= np.uint64(1) << np.uint64(bit)
    apart = np.bitwise_count(w[:, None, 0] ^ w[None, :, 0])
    want = joined(600, zip(*(x.tolist() for x in np.nonzero(apart <= 2))))
    rows = [(i, 9, x.astype("<u8").tobytes()) for i, x in enumerate(w)]
    stars = similar.near_prints(spark.createDataFrame([*rows, (600, 0, bytes(32))], "key long, n int, wide binary")).collect()
    assert joined(600, [tuple(r) for r in stars]) == want and len(set(want)) < 450
    assert similar.near_prints(spark.createDataFrame([], "key long, n int, wide binary")).count() == 0


def test_near_copies_are_found_by_the_vantage_point_trees(spark, monkeypatch):
    """Long texts whose fingerprints are close are joined even if they meet nowhere else."""
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(similar, "met_by_place", lambda distinct: similar.meetings(distinct).where("false"))
    rng = np.random.default_rng(10)
    texts = []
    for _ in range(12):
        base = [f"w{i}" for i in rng.integers(0, 5000, 2000)]
        for edits in (0, 1, 1, 40):
            t = list(base)
            for p in rng.integers(0, len(t), edits):
                t[p] = f"x{rng.integers(10 ** 6)}"
            texts.append(" ".join(t))
    sets = [similar.shingle_set(t.encode(), 5) for t in texts]
    prints = [simhash.fingerprint(x) for x in sets]
    close = [(a, b) for a in range(len(sets)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= similar.NEAR]
    assert len(close) >= 10 and all(len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in close)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in similar.classes(df).collect()}
    want = joined(len(texts), close)
    assert [got[i] for i in range(len(texts))] == want


def test_large_families_are_compared_whole(spark, monkeypatch):
    """A hub's near copies, a chain of edits, and texts that only share a passage, in one family."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    base, texts = list(rng.choice(words, 150)), []
    for i in range(60):
        t = list(base)
        t[int(rng.integers(150))] = f"x{i}"
        texts.append(" ".join(t))
    t = list(base)
    for i in range(40):  # each a step further from the base
        t[(i * 29) % 150] = f"y{i}"
        texts.append(" ".join(t))
    texts += [" ".join([*base[:100], *rng.choice(words, 50)]) for _ in range(30)]
    sets = [similar.shingle_set(t.encode(), 5) for t in texts]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    distinct = similar.sketches(held, 5).select("key", "doc_id", "mark")
    families = distinct.selectExpr("key as fp", "1L as label")
    links = [tuple(r) for r in similar.verified(held, families, distinct, 5, 0.8).collect()]
    place = {r["key"]: r["doc_id"] for r in distinct.collect()}
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    assert joined(len(texts), [(place[a], place[b]) for a, b in links]) == joined(len(texts), alike)


def test_dedup_keeps_one_of_rows_that_repeat(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(4, long), (4, long), (7, long), (4, "else"), (4, "else"), (None, "alone"), (None, "alone"), (9, "single words here")]
    kept = similar.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(4, long), (4, "else"), (None, "alone"), (9, "single words here")], key=str)


def test_dedup_without_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
    assert similar.deduplicated(odd).count() == 9


def test_dedup_of_odd_documents(spark, odd, empty):
    kept = similar.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect())
    assert ids == [-1, 1, 5, 11, 13, 15, 17, 19, 21]
    assert similar.deduplicated(empty).count() == 0
