"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Documents are tokenized once. Document frequencies and lengths come from the whole
corpus; two heavy terms of a document are its sort key, so that range partitions hold
related documents while a common key still spreads over many partitions. Each task cuts its sorted run into shards of bounded size, builds a BM25
inverted index of each, and fills windows greedily: seed, then its unused neighbours
by falling score, then any unused ones; the last is cut to fit and its rest is the
next seed. Text that fills whole windows by itself needs no neighbours.

Every window but a task's last is exactly full. What a task has left is cut at the
powers of two that add up to it, each a sequence of its own, so nothing is padded.

Defined cases: null text is empty text; each document ends with ``end_id``, so an
empty one is one token; repeated rows and repeated or null ids are packed row by row;
an empty table gives no sequence. Other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sediment.llm.common import stage, text_bytes, use
from sediment.llm.tokens import encoder

SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
QUERY_TERMS = 16
K1, B = 1.2, 0.75
NEIGHBOURS = 64


def prepare(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, k1, k2) of every text, and a task's document frequencies in a row with k1 = -1.

    A document's terms are counted once: for the frequencies, and for its sort key, the
    two terms of greatest count times log id. Ids follow the order of the vocabulary's
    merges, so a high one is a rare term even before the frequencies are known.
    """
    def run(batches):
        use("tokens")
        enc = encoder(tokenizer)
        size, dtype = enc.tokenizer.get_vocab_size(with_added_tokens=True), enc.dtype
        end, rarity = np.array([end_id], dtype).tobytes(), np.log1p(np.arange(size))
        total, n, held = np.zeros(size + 2, np.int64), 0, 0
        for b in batches:
            ids = [x + end for x in enc.encode_all(b.column(1).to_pylist())]
            keys = np.zeros((len(ids), 2), np.int32)
            for row, x in zip(keys, ids):
                t, c = np.unique(np.frombuffer(x, dtype), return_counts=True)
                total[t] += 1
                w = c * rarity[t]
                row[0] = t[w.argmax()]
                if len(t) > 1:
                    w[w.argmax()] = -1
                    row[1] = t[w.argmax()]
                held += c.sum()
            n += len(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1])})
        total[size:] = n, held
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "ids": pa.array([total.astype("<i8").tobytes()], pa.binary()), "k1": pa.array([-1], pa.int32()), "k2": pa.array([-1], pa.int32())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, ids binary, k1 int, k2 int")


def corpus_statistics(prepared: DataFrame, size: int) -> tuple[np.ndarray, int, float]:
    """(documents holding each id, documents, mean length) over all documents: the tasks' vectors summed."""
    def run(batches):
        total = np.zeros(size + 2, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size + 2, np.int64)
    for r in prepared.where("k1 = -1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r["id"]] = r["n"]
    n, held = out[size:].tolist()
    return out[:size], n, held / max(1, n)


class Shard:
    """A BM25 inverted index over one shard's open documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts, owner = [], [], []
        self.query: list[np.ndarray] = []
        for i, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            weight = c * idf[t]
            self.query.append(t[np.argsort(-weight, kind="stable")[:QUERY_TERMS]])
            norm = K1 * (1 - B + B * len(ids) / max(mean, 1))
            terms.append(t)
            counts.append(weight * (K1 + 1) / (c + norm))
            owner.append(np.full(len(t), i, np.int32))
        t = np.concatenate(terms) if terms else np.zeros(0, np.uint16)
        order = np.argsort(t, kind="stable")
        self.terms, starts = np.unique(t[order], return_index=True)
        self.starts = np.append(starts, len(t))
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int32)
        self.weight = np.concatenate(counts)[order].astype(np.float32) if counts else np.zeros(0, np.float32)
        self.free = np.ones(len(docs), bool)
        self.next = 0

    def neighbours(self, query: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score (ties: earlier first), then the rest in order."""
        score = np.zeros(len(self.free), np.float32)
        at = np.searchsorted(self.terms, query)
        for i, q in zip(at, query):
            if i < len(self.terms) and self.terms[i] == q:
                some = slice(self.starts[i], self.starts[i + 1])
                score[self.owner[some]] += self.weight[some]
        score[~self.free] = 0
        while True:
            found = np.flatnonzero(score)
            if not len(found):
                break
            if len(found) > NEIGHBOURS:
                found = found[np.argpartition(-score[found], NEIGHBOURS)[:NEIGHBOURS]]
            found = found[np.lexsort((found, -score[found]))]
            for d in found.tolist():
                if self.free[d]:
                    yield d
            score[found] = 0
        while self.next < len(self.free):
            if self.free[self.next]:
                yield self.next
            self.next += 1


class Packer:
    """Fills windows in a task; pieces are (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, base: int):
        self.window, self.sequence = window, base
        self.open: list[tuple] = []
        self.filled = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id, start: int, ids: np.ndarray, total: int):
        """Puts a piece in the open window; returns the rest if it was cut."""
        room = self.window - self.filled
        self.open.append((doc_id, start, ids[:room], total))
        self.filled += min(room, len(ids))
        if self.filled == self.window:
            self._emit(self.open)
            self.open, self.filled = [], 0
        return (doc_id, start + room, ids[room:], total) if len(ids) > room else None

    def shard(self, docs: list[tuple], idf: np.ndarray, mean: float) -> None:
        tails = []
        for doc_id, ids in docs:
            whole = len(ids) // self.window * self.window
            for s in range(0, whole, self.window):
                self._emit([(doc_id, s, ids[s:s + self.window], len(ids))])
            if whole < len(ids):
                tails.append((doc_id, whole, ids[whole:], len(ids)))
        index = Shard([t[2] for t in tails], idf, mean)
        rest, query = None, self.open and self._terms(self.open[0][2], idf)
        left = len(tails)
        while left or rest is not None:
            if rest is not None:
                seed, query = rest, self._terms(rest[2], idf)
                rest = self.add(*seed)
                continue
            if not self.open:  # a new seed: the first unused document
                d = next(index.neighbours(np.zeros(0, np.int64)))
                query, left = index.query[d], left - 1
                index.free[d] = False
                rest = self.add(*tails[d])
                continue
            for d in index.neighbours(query):
                index.free[d] = False
                left -= 1
                rest = self.add(*tails[d])
                if not self.open or rest is not None:
                    break

    @staticmethod
    def _terms(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
        t, c = np.unique(ids, return_counts=True)
        return t[np.argsort(-(c * idf[t]), kind="stable")[:QUERY_TERMS]]

    def close(self) -> None:
        """Cuts what is left at the powers of two that add up to it."""
        pieces, left = self.open, self.filled
        while left:
            size = 1 << left.bit_length() - 1
            taken, held = [], 0
            while held < size:
                doc_id, start, ids, total = pieces[0]
                n = min(size - held, len(ids))
                taken.append((doc_id, start, ids[:n], total))
                held += n
                pieces = pieces[1:] if n == len(ids) else [(doc_id, start + n, ids[n:], total), *pieces[1:]]
            self._emit(taken)
            left -= size
        self.open, self.filled = [], 0

    def batch(self) -> pa.RecordBatch:
        got, self.out = self.out, []
        cols = list(zip(*got)) or [()] * 6
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "ids": pa.array([np.asarray(x).astype("<u4").tobytes() for x in cols[2]], pa.binary()),
            "doc_tokens": pa.array(cols[3], pa.int64()), "sequence_id": pa.array(cols[4], pa.int64()), "offset": pa.array(cols[5], pa.int64())})


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian u32), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    size, dtype = enc.tokenizer.get_vocab_size(with_added_tokens=True), enc.dtype.str
    tokens = stage(prepare(docs, tokenizer, end_id), "packing-ids")
    df, n, mean = corpus_statistics(tokens, size)
    at = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))

    def run(batches):
        from pyspark import TaskContext

        idf, packer = at.value, Packer(window, TaskContext.get().partitionId() << 40)
        docs, held = [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(x, dtype)
                docs.append((i, ids))
                held += len(ids)
                if len(docs) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    packer.shard(docs, idf, mean)
                    docs, held = [], 0
                    yield packer.batch()
        packer.shard(docs, idf, mean)
        packer.close()
        yield packer.batch()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = tokens.where("k1 >= 0").repartitionByRange(parts, "k1", "k2", "doc_id", F.xxhash64("ids")).sortWithinPartitions("k1", "k2", "doc_id", "ids")
    return near.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the length and crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
