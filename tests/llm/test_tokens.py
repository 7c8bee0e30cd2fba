import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sediment.llm import common, packing, quality, token_store, tokens, toxicity
from sediment.llm.catalogue import QUERIES, TOKENIZER
from sediment.llm.common import new_path
from sediment.llm.tokens import Encoder
from tests.llm.conftest import ROWS


def library(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=200), st.integers(1, 9))
def test_coding_round_trip(values, step):
    control, data = token_store.pack(np.array(values, "<u4"))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert token_store.unpack(control, data, len(values), step).tolist() == values


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.characters()), max_size=40).filter(lambda s: "\ud800" > max(s, default="") or not any("\ud800" <= c <= "\udfff" for c in s)))
def test_encoder_equals_library(text):
    e = test_encoder_equals_library.e
    assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


test_encoder_equals_library.e = Encoder(TOKENIZER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abeZÀéŊ0129.,'<|- "), st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"])), max_size=90), max_size=12), st.integers(0, 5))
def test_merging_together_equals_library(texts, room):
    e, old = Encoder(TOKENIZER) if room else test_encoder_equals_library.e, (tokens.MEMO_CHUNKS, tokens.TOGETHER, tokens.LEAST, tokens.GROUP_BYTES)
    try:
        tokens.MEMO_CHUNKS, tokens.TOGETHER, tokens.LEAST, tokens.GROUP_BYTES = room if room else old[0], 7, 1, 300
        got = e.encode_all([t.encode() for t in texts])
    finally:
        tokens.MEMO_CHUNKS, tokens.TOGETHER, tokens.LEAST, tokens.GROUP_BYTES = old
    assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not e.more


def test_new_words_do_not_reach_the_library_one_by_one(monkeypatch):
    e = Encoder(TOKENIZER)
    monkeypatch.setattr(tokens, "LEAST", 1)
    monkeypatch.setattr(Encoder, "_piece", None)
    assert e.encode_all([b"Plain wrds, qqzx9", "éàzü".encode()])[0]


def test_a_task_drops_what_other_operators_left():
    common.use("nothing")
    quality.text_features(b"two words")
    toxicity.indices([b"two words"])
    tokens.encoder(TOKENIZER).encode(b"two words")
    assert quality._words and toxicity._words and tokens._encoders
    common.use("toxicity")
    assert toxicity._words and not quality._words and not tokens._encoders
    common.use("toxicity")
    assert toxicity._words
    common.use("quality")
    assert not toxicity._words


def test_store_of_odd_documents(spark, odd):
    path = new_path(spark, "store")
    token_store.write_store(odd, path, TOKENIZER, block_tokens=500)
    got = token_store.digests(token_store.read_store(spark, path)).toPandas()
    want = sorted(((-1 if r[0] is None else r[0]), x.tobytes()) for r, x in zip(ROWS, library([r[1] for r in ROWS])))
    n = [len(b) // 4 for _, b in want]
    got = got.assign(doc_id=got.doc_id.fillna(-1).astype(int)).sort_values("start")
    assert got.doc_id.tolist() == [i for i, _ in want]
    assert got.start.tolist() == (np.cumsum(n) - n).tolist() and got.n_tokens.tolist() == n
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(b) for _, b in want)
    blocks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/blocks").orderBy("path").collect()
    firsts = [np.frombuffer(bytes(b["content"]), "<i8", 1, 40)[0] for b in blocks]
    assert len(blocks) > 1 and firsts == sorted(firsts)


def test_empty_store(spark, empty):
    path = new_path(spark, "store")
    token_store.write_store(empty, path, TOKENIZER)
    assert token_store.read_store(spark, path).count() == 0


def test_op1_equals_library(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas().sort_values("doc_id")
    ids = library(docs.text)
    got = QUERIES["op1_token_store"](spark, small).toPandas().sort_values("doc_id")
    n = np.array([len(x) for x in ids])
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.start.tolist() == (n.cumsum() - n).tolist()
    assert got.n_tokens.tolist() == n.tolist() and got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def whole(pieces: pd.DataFrame, docs: dict, window: int):
    assert (pieces.length > 0).all()
    for _, p in pieces.sort_values("offset").groupby("sequence_id"):
        assert p.offset.tolist() == (p.length.cumsum() - p.length).tolist()
        total = int(p.length.sum())
        assert total == window or total & (total - 1) == 0
    for i, p in pieces.sort_values("start").groupby("doc_id"):
        assert p.start.tolist() == (p.length.cumsum() - p.length).tolist() and p.length.sum() == len(docs[i]) == p.doc_tokens.iloc[0]
        assert p.ids_crc32.tolist() == [zlib.crc32(docs[i][s:s + n].tobytes()) for s, n in zip(p.start, p.length)]


def test_op6_covers_every_id_once(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pandas()
    pieces = QUERIES["op6_packing"](spark, small).toPandas()
    by = dict(zip(docs.doc_id, library(docs.text)))
    assert set(pieces.doc_id) == set(by)
    whole(pieces, by, 4096)


def test_packing_of_odd_documents(spark, odd, empty):
    pieces = packing.digests(packing.pack(odd, TOKENIZER, window=64)).toPandas()
    assert pieces.length.sum() == sum(map(len, library([r[1] for r in ROWS])))
    once = pieces[~pieces.doc_id.isin([9]) & pieces.doc_id.notna()]
    sequences = pieces[["sequence_id", "offset"]].drop_duplicates()
    assert len(sequences) == len(pieces) and set(once.doc_id) == {5, 3, 1, 7, 11, 13, 15, 17, 19, 21}
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_neighbours_are_lexical():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 100, (20, 60)).astype(np.uint16) for k in range(1, 5)]
    docs = [d for row in zip(*topics) for d in row]
    df = np.zeros(600)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    shard = packing.Shard(docs, idf, 60.0)
    shard.free[0] = False
    near = [d for d, _ in zip(shard.neighbours(shard.query[0]), range(10))]
    assert all(d % 4 == 0 for d in near)
