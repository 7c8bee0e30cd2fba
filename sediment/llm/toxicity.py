"""Convolutional toxicity classifier: hashed words, several filter widths, max pooling.

A word (lower case, outer punctuation off) is the sum of the hashed embeddings of
itself and of its first four, five and six letters, which inflected forms share.
Filters of widths 1, 2 and 3 slide over all words of a text, each filter's greatest
response is kept, and a linear layer gives the logit. As an embedding only enters
through the filters, scoring multiplies the two once for all buckets and then only
gathers and adds. Training is numpy on the driver, over a bounded sample.

Thresholds are calibrated by language. The language is guessed from the text by a
naive Bayes model over the same hashed words, fitted on the same sample: a score never
sees the lang column. Each language's threshold is subtracted from the logit, so that
0.5 is the threshold for every text.

Defined cases: null text is empty, and an empty text scores by the bias alone, as any
text without words; texts of any length are scored whole; repeated rows score alike;
labels that are null are not learned from, and of repeated labels the greater counts;
without any usable label of both classes every score is the share of toxic labels
(0 with none). Other columns of the input are ignored.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sediment.llm.common import keeps, text_bytes, use, with_text

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
FEATURES = 4
#: Labelled documents learned from at most, of each class, and the words of one of them.
SAMPLE = {1: 2000, 0: 3000}
SAMPLE_WORDS = 30_000
#: Passes over the sample, or as many as make LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, BATCH, RATE = 5, 700, 32, 0.01
#: Documents of the sample that have to share a bucket before it is learned.
LEAST_DOCUMENTS = 8
#: Share of the words blanked in a training step, so that no word is learned only in another's company.
DROP = 0.4
#: Labelled texts to one empty one in training.
EMPTY = 8
#: What embeddings, filters and output weights lose in a step.
DECAY = 0.005
MEMO_WORDS = 400_000
TOKENS = 100_000
_STRIP = b" .,;:!?\"'()[]{}<>|*#$%&-_"


def features(word: bytes) -> tuple[int, int, int, int]:
    """Buckets of a word and of its beginnings; bucket 0 is padding."""
    w = word.decode("utf-8", "replace").lower()
    h = lambda tag, x: zlib.crc32(f"{tag}{x}".encode()) % (BUCKETS - 1) + 1
    return h("w", w), h("4", w[:4]), h("5", w[:5]), h("6", w[:6])


class Words(dict):
    """chunk -> row of its features; grows as chunks are met, up to a bound."""

    def __init__(self):
        self.rows, self.count = np.zeros((1 << 16, FEATURES), np.int32), 1

    def __missing__(self, chunk: bytes) -> int:
        core = chunk.strip(_STRIP) or chunk
        if core != chunk:
            at = self[core]
        else:
            at = self.count
            if at == len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = features(core)
            self.count += 1
        self[chunk] = at
        return at


_words = Words()


def _forget() -> None:
    global _words
    _words = Words()


keeps("toxicity", _forget)


def indices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows in use, each text's words as positions among them, and text starts.

    Every text is followed by two paddings (row 0), so that filters don't cross texts.
    """
    global _words
    if len(_words) > MEMO_WORDS:
        _words = Words()
    parts, starts, at = [], [], 0
    for t in texts:
        chunks = t.split()
        parts.append(np.fromiter(map(_words.__getitem__, chunks), np.int64, len(chunks)))
        parts.append(np.zeros(2, np.int64))
        starts.append(at)
        at += len(chunks) + 2
    every = np.concatenate(parts)
    used, back = np.unique(every, return_inverse=True)
    return _words.rows[used], back, np.array(starts)


@dataclass
class Model:
    table: np.ndarray  # buckets x (filter inputs of each width and offset, then languages)
    bias: np.ndarray
    out: np.ndarray
    base: float
    languages: list[str]
    prior: np.ndarray
    threshold: np.ndarray
    constant: float | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated scores of UTF-8 texts; 0.5 is each text's language's threshold."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logits, guess = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logits - self.threshold[guess], -30, 30)))

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows, at, starts = indices(texts)
        ends = np.append(starts[1:], len(at)) if len(starts) else starts
        used = np.zeros((len(rows), self.table.shape[1]), np.float32)
        for f in range(FEATURES):
            used += self.table[rows[:, f]]
        pooled = np.empty((len(texts), len(self.bias)), np.float32)
        tongue = np.empty((len(texts), len(self.languages)), np.float32)
        i = 0
        while i < len(texts):  # groups of texts of about TOKENS words
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + TOKENS, side="right")))
            self._pool(used, at[starts[i]:ends[j - 1]], starts[i:j] - starts[i], pooled[i:j], tongue[i:j])
            i = j
        guess = (tongue + self.prior).argmax(1) if len(texts) else np.zeros(0, int)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base, guess

    def _pool(self, used, at, starts, pooled, tongue):
        first = 0
        got = None
        for i, w in enumerate(WIDTHS):
            for k in range(w):
                x = used[:, first:first + FILTERS][at[k:] if k else at]
                first += FILTERS
                if k == 0:
                    got = x
                else:
                    got[:len(x)] += x
            pooled[:, i * FILTERS:(i + 1) * FILTERS] = np.maximum.reduceat(got, starts, axis=0)
        tongue[:] = np.add.reduceat(used[:, first:][at], starts, axis=0)


def train(texts: list[bytes], toxic: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Fits embeddings, filters, output layer and language thresholds by Adam on log loss."""
    global _words
    _words = Words()  # the order of rows, which the words blanked depend on, is that of these texts alone
    languages = sorted(set(langs)) or ["und"]
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros(0), np.zeros(0), 0.0, languages, np.zeros(1), np.zeros(1), float(toxic.mean()) if len(toxic) else 0.0)
    rng = np.random.default_rng(seed)
    # a text of no known word is no sign of toxicity: a share of empty ones says so
    empty = 4 + len(texts) // EMPTY
    texts, toxic, langs = texts + [b""] * empty, np.append(toxic, np.zeros(empty, np.int64)), langs + [""] * empty
    rows, at, starts = indices(texts)
    ends = np.append(starts[1:], len(at))
    inputs = sum(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), "w": rng.normal(0, 0.3, (DIM, inputs * FILTERS)).astype(np.float32),
         "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "v": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
    seen = np.zeros(BUCKETS, np.int64)
    for a, b in zip(starts, ends):
        seen[np.unique(rows[at[a:b]])] += 1
    rare = seen < LEAST_DOCUMENTS
    rare[0] = True
    p["e"][rare] = 0
    m = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())).astype(np.float32)
    check = rng.random(len(texts)) < 0.2  # thresholds are set on these, which aren't trained on
    check[-empty:] = False
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, int((~check).sum()))))):
        order = rng.permutation(np.flatnonzero(~check))
        for some in (order[i:i + BATCH] for i in range(0, len(order), BATCH)):
            step += 1
            gone = rng.random(len(rows)) < DROP
            g = {k: np.zeros_like(x) for k, x in p.items()}
            logit = np.empty(len(some), np.float32)
            keep = []
            for n, d in enumerate(some):
                idx = at[starts[d]:ends[d]]
                idx = np.where(gone[idx], 0, idx)
                e = p["e"][rows[idx]].sum(1)
                z = e @ p["w"]
                pos = np.empty(len(p["b"]), np.int64)
                top = np.empty(len(p["b"]), np.float32)
                first = 0
                for i, w in enumerate(WIDTHS):
                    got = z[:, first * FILTERS:(first + 1) * FILTERS].copy()
                    for k in range(1, w):
                        got[:len(z) - k] += z[k:, (first + k) * FILTERS:(first + k + 1) * FILTERS]
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    pos[cols] = got.argmax(0)
                    top[cols] = got[pos[cols], np.arange(FILTERS)]
                    first += w
                h = np.maximum(top + p["b"], 0)
                logit[n] = h @ p["v"] + p["c"][0]
                keep.append((idx, e, pos, h))
            slope = (1 / (1 + np.exp(-logit)) - toxic[some]) * weight[some] / len(some)
            buckets, pulls = [], []
            for s, (idx, e, pos, h) in zip(slope, keep):
                g["v"] += s * h
                g["c"] += s
                dh = s * p["v"] * (h > 0)
                g["b"] += dh
                first = 0
                for i, w in enumerate(WIDTHS):
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    for k in range(w):
                        # a filter's gradient reaches only the words under its greatest response
                        q = pos[cols] + k
                        d = np.where(q < len(idx), dh[cols], 0)
                        q = np.minimum(q, len(idx) - 1)
                        col = slice((first + k) * FILTERS, (first + k + 1) * FILTERS)
                        g["w"][:, col] += (e[q] * d[:, None]).T
                        buckets.append(rows[idx[q]])
                        pulls.append((p["w"][:, col] * d).T)
                    first += w
            buckets, pulls = np.concatenate(buckets), np.concatenate(pulls)
            for f in range(FEATURES):
                np.add.at(g["e"], buckets[:, f], pulls)
            g["e"][rare] = 0
            for k, x in p.items():
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                x *= 1 - (DECAY if k in ("e", "w", "v") else 0)
                x -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    # languages: naive Bayes over hashed buckets
    counts = np.ones((BUCKETS, len(languages)))
    share = np.array([langs.count(x) for x in languages], float)
    for d, x in enumerate(langs[:-empty]):
        counts[:, languages.index(x)] += np.bincount(rows[at[starts[d]:ends[d]]][:, 0], minlength=BUCKETS)
    tongue = np.log(counts / counts.sum(0)).astype(np.float32)
    tongue[0] = 0
    only_words = np.zeros((BUCKETS, len(languages)), np.float32)
    only_words += tongue / FEATURES
    table = np.hstack([p["e"] @ p["w"], only_words]).astype(np.float32)
    table[0] = 0
    model = Model(table, p["b"], p["v"], float(p["c"][0]), languages, np.log(share / share.sum()).astype(np.float32), np.zeros(len(languages)))
    logits, guess = model.logits(texts)
    for i in range(len(languages)):
        some = check & (guess == i)
        for best_of in (some, check):  # a language with too few of either class takes the common threshold
            y, x = toxic[best_of], logits[best_of]
            if (y == 1).sum() >= 5 and (y == 0).sum() >= 5:
                model.threshold[i] = cut(x, y)
                break
    return model


def cut(logits: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the best balanced accuracy, in the middle of its gap."""
    order = np.argsort(logits)
    x, t = logits[order], y[order]
    below = np.concatenate([[0], np.cumsum(t == 0)]) / max(1, (t == 0).sum())
    above = 1 - np.concatenate([[0], np.cumsum(t == 1)]) / max(1, (t == 1).sum())
    gain = below + above
    i = int(np.median(np.flatnonzero(gain >= gain.max() - 1e-12)))
    return float(x[0] - 1 if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Learns from a sample of labelled documents: ``SAMPLE`` of each class, in hash order.

    Documents beyond SAMPLE_WORDS words aren't in the sample, which bounds its size.
    """
    use("toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for value, most in SAMPLE.items():
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = texts.join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= 16 * SAMPLE_WORDS).collect()  # at most sum(SAMPLE) ids, short texts
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["text"])))
    rows = [r for r in rows if len(r["text"].split()) <= SAMPLE_WORDS]
    return train([bytes(r["text"]) for r in rows], np.array([r["toxic"] for r in rows], np.int64), [r["lang"] for r in rows])


def score(docs: DataFrame, model: Model, carry: list = ()) -> DataFrame:
    """(doc_id, or the columns to carry; score, predicted) of every whole text."""
    at = docs.sparkSession.sparkContext.broadcast(model)
    plan, kinds = with_text(docs, [F.col("doc_id").cast("long").alias("doc_id")] if not carry else [F.col(c) if isinstance(c, str) else c for c in carry])

    def run(batches):
        use("toxicity")
        for b in batches:
            texts = [t.as_py() for t in b.column(b.num_columns - 1)]
            s = at.value.scores(texts).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    return plan.mapInArrow(run, f"{kinds}score double, predicted int")
