import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from sediment.llm import lm, nbest, quality, tokens, toxicity
from sediment.llm.catalogue import PIECES, QUERIES, TOKENIZER
from sediment.llm.common import crc_mod, table
from tests.llm.conftest import ROWS


def labelled(small):
    return pq.read_table(f"{small}/labels.parquet").to_pandas()


# n-best segmentation

def every_segmentation(p, s):
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
        else:
            for j, c, x in p.edges(s, i):
                go(j, score + c, ids + x)
    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text("the an.,!é日\n", min_size=1, max_size=9))
def test_search_equals_brute_force(text):
    p = nbest.pieces(PIECES, 4)
    escaped = nbest.SIGN + text.replace(" ", nbest.SIGN)
    want = [round(s, 6) for s, _ in every_segmentation(p, escaped)[:4]]
    assert [round(s, 6) for s, _ in p.search(escaped)] == want
    found = p.segment(text)
    assert [round(s, 6) for s, _ in found] == want and len({ids for _, ids in found}) == len(found)
    assert all(p.decode(ids) == text.encode() for _, ids in found)


@settings(max_examples=40, deadline=None)
@given(st.text("the an.,!é日\n", min_size=1, max_size=40))
def test_long_stretches_are_searched_alike(text):
    p, old = nbest.pieces(PIECES, 4), nbest.LONG
    want = p.search(text)
    try:
        nbest.LONG = 0
        assert p.search(text) == want
    finally:
        nbest.LONG = old


def test_the_tree_holds_every_piece_and_nothing_else():
    p, found, open_ = nbest.pieces(PIECES, 4), {}, [("", nbest.pieces(PIECES, 4).tree)]
    while open_:
        s, node = open_.pop()
        for c, (after, score, ids) in node.items():
            if ids is not None:
                found[s + c] = score, ids
            assert ids is not None or after
            open_.append((s + c, after))
    assert found == p.piece_ids


def test_one_very_long_stretch_is_searched():
    p = nbest.pieces(PIECES, 3)
    text = "supercalifragilistic" * 5000
    assert len(p.stretches(text)) == 1 and len(found := p.segment(text)) == 3
    assert all(p.decode(ids) == text.encode() for _, ids in found) and found[0][0] >= found[1][0] >= found[2][0]


def test_op10_round_trips(spark, small):
    got = QUERIES["op10_nbest"](spark, small).toPandas()
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas()
    crc = {i: zlib.crc32(t.encode()) for i, t in zip(docs.doc_id, docs.text)}
    assert got.round_trip.all() and (got.decoded_crc32 == got.doc_id.map(crc)).all()
    ranked = got.sort_values(["doc_id", "rank"])
    assert set(got["rank"]) == {1, 2, 3} and (ranked.groupby("doc_id").score.diff().dropna() <= 0).all()


def test_no_piece_is_cut():
    p = nbest.pieces(PIECES, 4)
    assert "².".isalpha() is False and p.piece["²."][0] > p.piece["²"][0] + p.piece["."][0]
    assert "²." in p.stretches("x².") and p.stretches("km² a½b, ³.")[0] == nbest.SIGN + "km"
    whole = [s for s in p.piece if nbest.SIGN not in s]
    assert len(whole) > 10_000 and all(p.stretches("x " + s)[1:] == [nbest.SIGN + s] for s in whole)
    got = p.search(nbest.SIGN + "x².")[0]
    assert math.isclose(sum(p.search(s)[0][0] for s in p.stretches("x².")), got[0], rel_tol=1e-6)


def test_nbest_of_odd_documents(spark, odd, empty):
    got = nbest.encode(odd, PIECES, 2).toPandas()
    assert len(got[got.doc_id.isin([1, 3])]) == 2 and got[got.doc_id == 3].ids.iloc[0] == b""
    assert got.round_trip.all() and len(got[got.doc_id == 9]) == 4
    assert nbest.encode(empty, PIECES).count() == 0


# quality

def test_kth_key_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(0, 1e3, 500), rng.normal(0, 1e-9, 100), np.zeros(20), -rng.random(50)]), 9)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    order = np.sort(x)[::-1]
    for k in (1, 2, 300, 599, len(x)):
        assert quality.kth_key(df, "v", k) == order[k - 1]
    assert quality.kth_key(df, "v", len(x) + 1) is None


def test_quality_holds_out(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 3) != 0))
    got = quality.weigh(docs, model, ["doc_id"]).toPandas().merge(labelled(small), on="doc_id")
    out = got[[zlib.crc32(str(i).encode()) % 3 == 0 for i in got.doc_id]]
    assert out.accepted[out.quality == 1].mean() >= 0.97 and out.accepted[out.quality == 0].mean() <= 0.2


def test_op9_draws_a_quarter(spark, small):
    got = QUERIES["op9_quality"](spark, small).toPandas()
    assert got.sampled.sum() == len(got) // 4
    assert got.gumbel_key[got.sampled].min() >= got.gumbel_key[~got.sampled].max()
    noise = got.gumbel_key - got.log_weight
    assert abs(noise.mean() - 0.5772) < 0.15  # the mean of a standard Gumbel variable


def test_op9_weights_equal_a_plain_version(spark, small):
    """Counts, ratios and sums of n-grams by dictionaries, a text at a time."""
    from collections import Counter
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas()
    labels = labelled(small)
    by = labels.dropna(subset=["quality"]).groupby("doc_id").quality.min()
    n, kinds = quality.BUCKETS, range(quality.KINDS)

    def grams(text):
        out, core0, shape0 = [], 0, 0
        for i, chunk in enumerate((text or "").encode().split()):
            core, shape = quality.describe(chunk)
            if i and core == core0:
                shape = quality.SAME
            pair = lambda a, b: ((a + 1) * 2654435761 + b * 40503 >> 8) % n
            out += [(0, core), (1, pair(core0, core)), (2, pair(shape0, shape))]
            core0, shape0 = core, shape
        return out

    raw, target, held = Counter(), Counter(), {}
    for i, t in zip(docs.doc_id, docs.text):
        held[i] = grams(t)
        raw.update(held[i])
        if by.get(i) == 1:
            target.update(held[i])
    raws, targets = ([sum(c for (j, _), c in counts.items() if j == k) for k in kinds] for counts in (raw, target))
    weight = 20.0 * n / 64

    def ratio(f):
        p = (raw[f] + 1) / (raws[f[0]] + n)
        return math.log((target[f] + weight * p) / (targets[f[0]] + weight) / p)

    got = QUERIES["op9_quality"](spark, small).toPandas().set_index("doc_id")
    for i, g in held.items():
        assert math.isclose(got.log_weight[i], sum(map(ratio, g)), rel_tol=1e-7, abs_tol=1e-6) and got.n_features[i] == len(g)


def test_draw_takes_exactly_k(spark):
    rows = [(None, f"text {i // 2}", float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, mark string, log_weight double")
    for k in (0, 1, 100, 133, 399, 400, 500):
        assert quality.resample(df, k, ["doc_id", "mark"]).where("sampled").count() == min(k, 400)
    same = spark.createDataFrame([(None, "t", 1.0)] * 50, "doc_id long, mark string, log_weight double")
    assert quality.resample(same, 7, ["doc_id", "mark"]).where("sampled").count() == 7


def test_quality_of_odd_documents(spark, odd, empty):
    none = spark.createDataFrame([(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, none)
    got = quality.weigh(odd, model, ["doc_id"])
    assert got.where("accepted").count() == len(ROWS)
    labels = spark.createDataFrame([(5, 1), (5, 0), (9, 1), (11, 0), (99, 1)], "doc_id long, quality int")
    drawn = quality.resample(quality.weigh(odd, quality.fit(odd, labels), ["doc_id", "score"]), 4, ["doc_id"])
    assert drawn.count() == len(ROWS) and drawn.where("sampled").count() == 4
    assert quality.resample(quality.weigh(empty, model, ["doc_id"]), 3, ["doc_id"]).count() == 0


# toxicity

def test_op4_holds_out():
    rng = np.random.default_rng(0)
    bad = {"en": ["loser", "scum"], "de": ["loweiung", "loweier"]}
    texts, toxic, langs = [], [], []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        words = [f"{'a' if lang == 'en' else 'ü'}{rng.integers(0, 3000)}" for _ in range(rng.integers(5, 60))]
        y = int(rng.random() < 0.3)
        for _ in range(2 * y):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad[lang])))
        texts.append(" ".join(words).encode())
        toxic.append(y)
        langs.append(lang)
    y = np.array(toxic)
    model = toxicity.train(texts[:600], y[:600], langs[:600])
    p = model.scores(texts[600:]) >= 0.5
    assert p[y[600:] == 1].mean() >= 0.95 and p[y[600:] == 0].mean() <= 0.08
    assert model.scores([b"", b"loweiheit " * 3])[0] < 0.5 < model.scores([b"", b"loweiheit " * 3])[1]


def test_toxicity_query_on_small_tables(spark, small):
    got = QUERIES["op4_toxicity"](spark, small).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got.merge(labelled(small), on="doc_id")
    trained = m[~m.held_out]
    assert trained.predicted[trained.toxic == 1].mean() >= 0.9 and trained.predicted[trained.toxic == 0].mean() <= 0.1


def test_toxicity_of_odd_documents(spark, odd, empty):
    for rows in ([], [(5, 1)], [(5, 1), (5, 0), (9, 0), (None, 1), (11, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.score(odd, toxicity.fit(odd, labels)).toPandas()
        assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert toxicity.score(empty, toxicity.fit(odd, labels)).count() == 0


# language model

def test_op2_counts_and_base(spark, small):
    from collections import Counter
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id}
    words = {i: t.encode().lower().split() for i, t in zip(docs.doc_id, docs.text)}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    old, lm.HOT = lm.HOT, 5000  # words beyond it take the join
    try:
        got = QUERIES["op2_lm"](spark, small).toPandas().set_index("doc_id")
    finally:
        lm.HOT = old
    assert (got.train_tokens == n).all()
    for i, ws in words.items():
        k = [c[w] for w in ws] + [ends]
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[i], len(k), sum(x > 0 for x in k))
        assert math.isclose(r.base_score, sum(math.log10((x + 1) / (n + v + 1)) for x in k), rel_tol=1e-9)
    seen = got[~got.held_out]
    assert seen.score.sum() > seen.base_score.sum() and np.isfinite(got.score).all()


def test_training_predicts_each_token_once():
    firsts = lm.firsts_of(TOKENIZER)
    for text in (b"", b"one", b"unheard-of antidisestablishmentarianism " * 7, b"word and another " * 3000):
        line = firsts.line(text)
        got = lm.tiles(line, 99_999)
        target = got[:, 1:].reshape(-1)
        assert target[target >= 0].tolist() == [*line.tolist(), 99_999] and (got[1:, 0] == got[:-1, -1]).all() and got[0, 0] == 99_999


def test_shards_train_on_the_same_batches_however_windows_arrive():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, lm.CLASSES, 60)
    windows = rng.integers(0, 60, (lm.POOL + 300, lm.WINDOW + 1))
    w = lm.first_weights(np.full(lm.CLASSES, 1 / lm.CLASSES))
    out = []
    for cut in (1, 700):
        t = lm.ShardTraining(w, classes)
        for part in np.array_split(windows, cut):
            t.add(part)
        out.append(t.close())
    assert (out[0] == out[1]).all() and t.n == len(windows)


def test_company_of_ids_covers_all_text(spark):
    from collections import Counter
    firsts = lm.firsts_of(TOKENIZER)
    end = lm.vocabulary(firsts.enc)[1]
    texts = ["the cat sat on the mat " * 90 + "unheard-of zyxwv", "", "a dog", "the end of the unheard-of"]
    want, words = Counter(), Counter()
    for t in texts:
        line = [end, *firsts.line(t.encode()).tolist(), end]
        words.update(t.encode().split())
        for i, a in enumerate(line):
            for j in (*range(i - lm.COMPANY, i), *range(i + 1, i + lm.COMPANY + 1)):
                if 0 <= j < len(line):
                    want[a, int(lm.mark_of(np.array([line[j]]))[0])] += 1
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = lm.gather(df, TOKENIZER).groupBy("kind", "key").sum("n").collect()
    got = Counter()
    for r in rows:
        if r["kind"] == 2:
            cell = int.from_bytes(bytes(r["key"]), "little")
            got[cell // lm.MARKS, cell % lm.MARKS] += r["sum(n)"]
    # beyond a text's end the ends that part texts keep each other company
    assert {k: n for k, n in got.items() if k[0] != end and k[1] != int(lm.mark_of(np.array([end]))[0])} == {k: n for k, n in want.items() if k[0] != end and k[1] != int(lm.mark_of(np.array([end]))[0])}
    assert {bytes(r["key"]): r["sum(n)"] for r in rows if r["kind"] == 0} == dict(words)
    assert sum(r["sum(n)"] for r in rows if r["kind"] == 1) == len(texts)


def plain_scorer(rng, size, classes, firsts, first, more, last, after):
    return lm.Scorer(lm.first_weights(np.full(lm.CLASSES, 1 / lm.CLASSES)), classes, size - 2, firsts, np.concatenate([first, more, last]), np.ones(size, bool), after)


def test_windows_score_each_token_once():
    rng = np.random.default_rng(2)
    size = 50
    classes = rng.integers(0, lm.CLASSES, size)
    one = np.ones(size)
    s = plain_scorer(rng, size, classes, one, one, one, one, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    lengths = np.array([2, 3, lm.WINDOW, lm.WINDOW + 1, lm.WINDOW + 2, 2 * lm.WINDOW, 5 * lm.WINDOW + 7])
    lines = rng.integers(0, size, lengths.sum())
    got = s.class_logs(lines, lengths)
    want, at = [], 0
    for n in lengths:
        line = lines[at:at + n]
        want += plain_logs(s, line)
        at += n
    assert np.allclose(got, want, atol=1e-4)


def plain_logs(s, line):
    """Natural log of each next id's class, a token at a time."""
    out = []
    for t in range(len(line) - 1):
        k = 0 if t < lm.WINDOW else -(-(t + 1 - lm.WINDOW) // lm.STRIDE)
        x = (s.x[line[k * lm.STRIDE:t + 1]] + s.w["p"][:t + 1 - k * lm.STRIDE])[None]
        y, _ = lm.attend(s.w, x)
        z = y[0, -1] @ s.w["g"] + s.w["b"]
        out.append(z[s.classes[line[t + 1]]] - np.log(np.exp(z).sum()))
    return out


def test_gradient_of_attention():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, lm.CLASSES, 40)
    w = {k: x.astype(np.float64) for k, x in lm.first_weights(np.full(lm.CLASSES, 1 / lm.CLASSES)).items()}
    windows = rng.integers(0, 40, (3, lm.WINDOW + 1))
    windows[0, 20:] = -1
    g, _ = lm.step(w, classes, windows)
    for name in lm.SHAPES:
        at = tuple(int(i) for i in np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        x = w[name][at]
        w[name][at] = x + 1e-5
        up = lm.step(w, classes, windows)[1]
        w[name][at] = x - 1e-5
        down = lm.step(w, classes, windows)[1]
        w[name][at] = x
        assert math.isclose(g[name][at], (up - down) / 2e-5, rel_tol=2e-2), name


def test_spelling_is_a_distribution():
    """Known words and one-id new words of a class add up to no more than the class; what follows an id adds up to one."""
    rng = np.random.default_rng(6)
    size = 700
    classes = rng.integers(0, 4, size)
    firsts, first = rng.integers(1, 20, size), rng.integers(0, 3, size)
    more = rng.integers(0, 3, size)
    follow = lm.buckets(more)
    cells, times = np.unique(5 * lm.FOLLOW + follow[rng.integers(0, size, 60)], return_counts=True)
    s = plain_scorer(rng, size, classes, firsts, first, more, first, (cells, times))
    for k in range(4):
        ids = np.flatnonzero(classes == k)
        known = np.exp(s.known[k]) * firsts[ids].sum()
        new = np.exp(s.new[k]) * np.exp(s.begin[ids] + s.over[ids]).sum()
        assert known + new <= 1 + 1e-9 and np.exp(s.known[k]) * firsts[ids].sum() + np.exp(s.new[k]) > 0.99
    x = np.array([[5, j] for j in range(size)]).reshape(-1)
    fresh = s.words(x, np.full(size, 2))[1] * math.log(10) - s.new[classes[5]]
    goes_on = np.exp(fresh - s.begin[5] - s.on[5] - s.over)
    assert math.isclose(goes_on.sum(), 1, rel_tol=1e-6)


def test_whole_score_equals_a_plain_version(spark, odd, monkeypatch):
    from collections import Counter
    from pyspark.sql import functions as F
    made = []

    class Kept(lm.Scorer):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(args)

    monkeypatch.setattr(lm, "Scorer", Kept)
    learns = lambda i: i is None or i % 3 != 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "HOT", 3)
        # a subclass made here can't reach the workers, so the model is rebuilt as the plain class there
        m.setattr(Kept, "__reduce__", lambda self: (lm_scorer, made[-1]))
        got = lm.score(odd, F.expr("coalesce(doc_id % 3 != 0, true)"), TOKENIZER).toPandas()
    w, classes, end, firsts, spelled, final, (cells, times) = made[-1]
    s = lm_scorer(*made[-1])
    size, enc = len(classes), lm.encoder(TOKENIZER)
    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in ROWS]
    c = Counter(x for i, t in texts if learns(i) for x in t)
    ends = sum(learns(i) for i, _ in texts)
    first, more, last = spelled.reshape(3, size)
    follow, after = lm.buckets(more), dict(zip(cells.tolist(), times.tolist()))
    q = (more + 0.02) / (more + 0.02).sum()
    share = lambda x, k: q[x] / q[follow == k].sum()
    mass = Counter()
    for cell, n in after.items():
        mass[cell // lm.FOLLOW] += n
    want = []
    for i, t in texts:
        ids = [np.frombuffer(enc[x], enc.dtype).astype(int).tolist() or [end + 1] for x in t] + [[end]]
        logs = plain_logs(s, np.array([end, *[x[0] for x in ids]]))
        total = 0.0
        for log, x, n in zip(logs, ids, [*[c[x] for x in t], ends]):
            k = classes[x[0]]
            p = s.begin[x[0]]
            for a, b in zip(x, x[1:]):
                f = follow[b]
                p += s.on[a] + math.log((after.get(a * lm.FOLLOW + f, 0) + lm.WEIGHT * q[follow == f].sum()) / (mass[a] + lm.WEIGHT) * share(b, f))
            p += s.over[x[-1]] + s.new[k]
            total += (log + (np.logaddexp(s.known[k] + math.log(n), p) if n else p)) / math.log(10)
        want.append((-1 if i is None else i, total))
    have = sorted(zip(got.doc_id.fillna(-1).astype(int), got.score))
    for (i, x), (j, y) in zip(have, sorted(want)):
        assert i == j and math.isclose(x, y, rel_tol=1e-4), (i, x, y)


def lm_scorer(*args):
    return _Scorer(*args)


_Scorer = lm.Scorer


def test_scores_do_not_depend_on_partitions_or_on_what_is_broadcast(spark, odd, small, monkeypatch):
    from pyspark.sql import functions as F
    docs = table(spark, small, "documents").where("n_chars < 3000").unionByName(odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars")))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    got = []
    for parts, hot in ((1, lm.HOT), (7, 50)):
        monkeypatch.setattr(lm, "HOT", hot)
        p = lm.score(docs.repartition(parts), crc_mod("doc_id", 7) != 2, TOKENIZER).toPandas()
        got.append(p.sort_values(["doc_id", "n_tokens", "score"]).score.to_numpy())
    assert np.allclose(*got, rtol=1e-6)


def test_op2_reads_and_predicts_every_id(spark, odd, tmp_path, monkeypatch):
    """The query against a plain version in which each id of a text is a position of the attention model."""
    from collections import Counter
    made = []

    class Kept(lm.Scorer):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(args)

    odd.select("doc_id", "text", "lang", "source").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "Scorer", Kept)
        m.setattr(lm, "HOT", 3)
        m.setattr(Kept, "__reduce__", lambda self: (lm_scorer, made[-1]))
        got = QUERIES["op2_lm"](spark, str(tmp_path)).toPandas()
    classes, end, _, spelled, _, (cells, times) = made[-1][1:]
    s, size, enc = lm_scorer(*made[-1]), len(classes), lm.encoder(TOKENIZER)
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in ROWS]
    c = Counter(x for i, t in texts if learns(i) for x in t)
    ends = sum(learns(i) for i, _ in texts)
    more = spelled.reshape(3, size)[1] + 0.02
    follow, after, mass = lm.buckets(more - 0.02), dict(zip(cells.tolist(), times.tolist())), Counter()
    of_bucket, of_class = np.bincount(follow, more), np.bincount(classes, more)
    for cell, n in after.items():
        mass[cell // lm.FOLLOW] += n
    want = []
    for i, t in texts:
        ids = [np.frombuffer(enc[x], enc.dtype).astype(int).tolist() or [end + 1] for x in t] + [[end]]
        logs = iter(plain_logs(s, np.array([end, *(y for x in ids for y in x)])))
        total = 0.0
        for x, n in zip(ids, [*[c[x] for x in t], ends]):
            log, k = next(logs), classes[x[0]]
            p = s.begin[x[0]] + s.new[k] + s.over[x[-1]]
            for a, b in zip(x, x[1:]):
                seen = after.get(a * lm.FOLLOW + follow[b], 0) * more[b] / of_bucket[follow[b]]
                p += s.on[a] + math.log((seen + lm.WEIGHT * math.exp(next(logs)) * more[b] / of_class[classes[b]]) / (mass[a] + lm.WEIGHT))
            total += (log + (np.logaddexp(s.known[k] + math.log(n), p) if n else p)) / math.log(10)
        assert next(logs, None) is None
        want.append((-1 if i is None else i, total))
    have = sorted(zip(got.doc_id.fillna(-1).astype(int), got.score))
    for (i, x), (j, y) in zip(have, sorted(want)):
        assert i == j and math.isclose(x, y, rel_tol=1e-4), (i, x, y)


def test_training_reads_all_ids_of_all_texts(spark):
    texts = ["the unheard-of antidisestablishmentarianism " * 90 + "zyxwv", "", "a dog's end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    enc = lm.encoder(TOKENIZER)
    end = lm.vocabulary(enc)[1]
    rows = lm.gather(df, TOKENIZER, inside=True).collect()
    lines = sorted(np.frombuffer(r["line"], lm.line_type(end + 2)).tolist() for r in rows if r["kind"] == 3)
    assert lines == sorted(np.frombuffer(enc.encode(t.encode()), enc.dtype).tolist() for t in texts)
    near = np.zeros(end + 2, np.int64)
    for r in rows:
        if r["kind"] == 2:
            near[int.from_bytes(bytes(r["key"]), "little") // lm.MARKS] += r["n"]
    near[end] = 0
    assert (near == 2 * lm.COMPANY * np.bincount(np.concatenate(lines).astype(int), minlength=end + 2)).all()


def test_ids_inside_words_are_a_distribution():
    """Whatever the context says of classes, what may follow an id adds up to one."""
    rng = np.random.default_rng(6)
    size = 700
    classes, firsts, first, more = rng.integers(0, 4, size), rng.integers(1, 20, size), rng.integers(0, 3, size), rng.integers(0, 3, size)
    cells, times = np.unique(5 * lm.FOLLOW + lm.buckets(more)[rng.integers(0, size, 60)], return_counts=True)
    s = plain_scorer(rng, size, classes, firsts, first, more, first, (cells, times))
    _, fixed, t, part = s.parts(np.array([[5, j] for j in range(size)]).reshape(-1), np.full(size, 2))
    context = rng.dirichlet(np.ones(4))
    assert math.isclose((np.exp(fixed[1::2] - s.on[5] - s.over) * (t[1::2] + part[1::2] * context[classes])).sum(), 1, rel_tol=1e-6)


def test_scores_of_every_id_do_not_depend_on_partitions_or_on_what_is_broadcast(spark, odd, small, monkeypatch):
    from pyspark.sql import functions as F
    docs = table(spark, small, "documents").where("n_chars < 1500").unionByName(odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars")))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 10_000)
    got = []
    for parts, hot in ((1, lm.HOT), (7, 50)):
        monkeypatch.setattr(lm, "HOT", hot)
        p = lm.score(docs.repartition(parts), crc_mod("doc_id", 7) != 2, TOKENIZER, inside=True).toPandas()
        got.append(p.sort_values(["doc_id", "n_tokens", "score"]).score.to_numpy())
    assert np.allclose(*got, rtol=1e-6)


@pytest.mark.parametrize("training", ["true", "false"])
def test_every_id_of_odd_documents(spark, odd, empty, training):
    from pyspark.sql import functions as F
    got = lm.score(odd, F.expr(training), TOKENIZER, inside=True).toPandas()
    assert len(got) == len(ROWS) and np.isfinite(got.score).all() and np.isfinite(got.base_score).all()
    assert lm.score(empty, F.lit(True), TOKENIZER, inside=True).count() == 0


@pytest.mark.parametrize("training", ["true", "false"])
def test_lm_of_odd_documents(spark, odd, empty, training):
    from pyspark.sql import functions as F
    got = lm.score(odd, F.expr(training), TOKENIZER).toPandas()
    assert len(got) == len(ROWS) and np.isfinite(got.score).all() and np.isfinite(got.base_score).all()
    assert sorted(got.n_tokens) == sorted(len((r[1] or "").encode().split()) + 1 for r in ROWS)
    assert lm.score(empty, F.lit(True), TOKENIZER).count() == 0


@pytest.mark.parametrize("texts", [[b""], [b"", b" \n", b""], [b"A b\x0ba  \x0c", b"", "\u00c9T\u00c9 \x1c\x85 a".encode(), b"\t\rzz", b"a"]])
def test_words_are_those_of_each_text(texts):
    which, words, per_text = lm.split_words(texts)
    words = [words[i].as_py() for i in which.tolist()]
    want = [t.lower().split() for t in texts]
    assert words == [w for t in want for w in t] and per_text.tolist() == [len(t) for t in want]


@pytest.mark.parametrize("kind", ["_MetWhole", "WholeMemo"])
def test_new_words_are_tokenized_together(kind, monkeypatch):
    class Counted(tokens.Encoder):
        calls = 0

        def __missing__(self, word):
            Counted.calls += 1
            return super().__missing__(word)

    enc, plain = Counted(TOKENIZER), lm.encoder(TOKENIZER)
    rng = np.random.default_rng(4)
    words = list({bytes(rng.integers(97, 123, 9).tolist()) + end for end in (b"", b",", b".") for _ in range(3000)})
    size, end, none = lm.vocabulary(plain)
    if kind == "_MetWhole":
        firsts = lm.Firsts(enc)
        met = lm._MetWhole(firsts, end)
        numbers = np.array([met[w] for w in words])
        ids, n = met.ids(numbers)
    else:
        ones = np.ones(size)
        s = lm.Scorer(lm.first_weights(np.full(lm.CLASSES, 1 / lm.CLASSES)), np.arange(size) % lm.CLASSES, end, ones, np.tile(ones, 3), ones > 0, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        memo = lm.WholeMemo(enc, s, {}, 1)
        numbers = []
        for i in range(0, len(words), 4500):  # what is new is put behind what is there
            numbers += [memo[w] for w in words[i:i + 4500]]
            memo.settle()
        at = np.array(numbers)
        ids, n = memo.x[lm.ranges(memo.start[at], memo.n[at])], memo.n[at]
    want = [np.frombuffer(plain[w], plain.dtype) for w in words]
    assert n.tolist() == list(map(len, want)) and (ids == np.concatenate(want)).all()
    assert Counted.calls < 100


def test_step_on_one_window():
    rng = np.random.default_rng(6)
    classes, windows = rng.integers(0, lm.CLASSES, 40), rng.integers(0, 40, (1, lm.WINDOW + 1))
    w = lm.first_weights(np.full(lm.CLASSES, 1 / lm.CLASSES))
    one, two = lm.step(w, classes, windows), lm.step(w, classes, np.repeat(windows, 2, 0))
    assert one[1] == pytest.approx(two[1], rel=1e-5)
    for k in lm.SHAPES:
        np.testing.assert_allclose(one[0][k], two[0][k], rtol=1e-3, atol=1e-5)


def test_every_pair_has_its_rank():
    m = tokens.Encoder(TOKENIZER).merges
    a, b = m.keys[:-1] // m.size, m.keys[:-1] % m.size
    assert (m.slots < 0).any() and (m.rank(a, b) == m.ranks[:-1]).all()
    other = np.random.default_rng(8).integers(0, m.size, (2, 50_000))
    known = dict(zip(m.keys.tolist(), m.ranks.tolist()))
    assert m.rank(*other).tolist() == [known.get(k, tokens.NEVER) for k in (other[0] * m.size + other[1]).tolist()]
