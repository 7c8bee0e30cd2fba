"""Quality by importance resampling: hashed n-gram models of target and raw text.

A text's features are the hashed n-grams of its words' lower-case cores, one word and two
words, and hashed pairs of neighbouring word shapes. A shape is a word's case, its outer
signs and whether it repeats the word before it, so that wording and form are modelled.
Raw counts come from every document, target counts from a bounded sample of documents
labelled good. A text's log importance weight is the sum, over its features, of the log
ratio of the two smoothed distributions; each of the three kinds has its own.

The classifier accepts a text whose mean log ratio reaches a threshold, set on the
labelled sample. ``resample`` draws exactly k texts without replacement in proportion to
their weights: Gumbel noise, a hash of the row's id and text, is added to the log weights
and the k highest win. The k-th key is found by counting keys into ranges, 2^16 at a
time, so no task or driver holds the keys.

Defined cases: null text is empty; a text without words has weight and mean 0; texts
of any length count whole; rows of equal id and text weigh alike and share their noise,
and rows that tie at the k-th key are taken in the order in which they are staged until k
are drawn; null labels aren't learned from and of repeated labels the smaller counts;
without good labels every ratio is 0 and all is accepted; an empty table gives no row.
Other columns of the input are ignored.
"""
from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sediment.llm.common import keeps, stage, text_bytes, use, with_text

#: Buckets of each kind of feature.
BUCKETS, KINDS = 1 << 16, 3
SHAPES = 1 << 12
#: Labelled documents learned from at most, of each class, and bytes of one of them.
SAMPLE = {1: 6000, 0: 3000}
SAMPLE_BYTES = 500_000
#: Share of the sample's good documents that the threshold keeps at least.
KEEP = 0.999
MEMO_WORDS = 400_000
SAME = 1
_OUTER = re.compile(rb"^([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)(.*?)([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)$", re.S)


def describe(chunk: bytes) -> tuple[int, int]:
    """(core bucket, shape) of a word; shape SAME is kept for repetition."""
    head, core, tail = _OUTER.match(chunk).groups()
    word = core.decode("utf-8", "replace")
    case = "l" if word == word.lower() else "u" if word == word.upper() and len(word) > 1 else "t" if word[1:] == word[1:].lower() else "m"
    digits = "d" if any(c.isdigit() for c in word) else ""
    empty = "" if word else "e"
    shape = zlib.crc32(head[:4] + b"|" + (case + digits + empty).encode() + b"|" + tail[:4]) % (SHAPES - 2) + 2
    return zlib.crc32(word.lower().encode()) % BUCKETS, shape


class Words(dict):
    """chunk -> row of (core bucket, shape)."""

    def __init__(self):
        self.rows, self.count = np.zeros((1 << 16, 2), np.int32), 0

    def __missing__(self, chunk: bytes) -> int:
        at = self.count
        if at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = describe(chunk)
        self.count += 1
        self[chunk] = at
        return at


_words = Words()


def _forget() -> None:
    global _words
    _words = Words()


keeps("quality", _forget)


def text_features(text: bytes) -> np.ndarray:
    """Feature numbers of a text: cores in [0, BUCKETS), then pairs of cores, then pairs of shapes."""
    global _words
    if len(_words) > MEMO_WORDS:
        _words = Words()
    chunks = text.split()
    at = np.fromiter(map(_words.__getitem__, chunks), np.int64, len(chunks))
    core, shape = _words.rows[at].T
    same = np.zeros(len(at), bool)
    same[1:] = core[1:] == core[:-1]
    shape, core = np.where(same, SAME, shape).astype(np.int64), core.astype(np.int64)
    return np.concatenate([core, BUCKETS + paired(core), 2 * BUCKETS + paired(shape)])


def paired(x: np.ndarray) -> np.ndarray:
    """The bucket of each number with the one before it; 0 is before the first."""
    before = np.concatenate([[0], x[:-1]])[:len(x)]
    return ((before + 1) * 2654435761 + x * 40503 >> 8) % BUCKETS


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float

    def weigh(self, text: bytes) -> tuple[float, int]:
        """(log importance weight, features) of a text."""
        f = text_features(text)
        return float(self.ratio[f].sum()), len(f)


def raw_counts(docs: DataFrame) -> np.ndarray:
    """Feature counts of all documents: one vector a task, summed."""
    def run(batches):
        use("quality")
        total = np.zeros(KINDS * BUCKETS, np.int64)
        held, n = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(text_features(t.as_py()))
                n += len(held[-1])
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=KINDS * BUCKETS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=KINDS * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"f": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(KINDS * BUCKETS, np.int64)
    got = docs.select(text_bytes().alias("text")).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # at most KINDS * BUCKETS
    out[got["f"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Raw model over all documents, target model and threshold over the labelled sample."""
    use("quality")
    raw = raw_counts(docs)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = None
    for value, most in SAMPLE.items():
        some = known.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= SAMPLE_BYTES)

    def describe_all(batches):  # only feature numbers reach the driver
        use("quality")
        for b in batches:
            t = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"f": pa.array([np.asarray(text_features(x), "<i4").tobytes() for x in t], pa.binary()), "quality": b.column(1), "doc_id": b.column(2)})

    rows = texts.select("text", "quality", "doc_id").mapInArrow(describe_all, "f binary, quality int, doc_id long").collect()  # at most sum(SAMPLE) ids
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    found = [(np.frombuffer(r["f"], "<i4"), r["quality"]) for r in rows]
    if not any(q == 1 for _, q in found):
        return Model(np.zeros(KINDS * BUCKETS), -np.inf)

    def counted(rows):
        target = np.zeros(KINDS * BUCKETS, np.int64)
        for f, q in rows:
            if q == 1:
                target += np.bincount(f, minlength=KINDS * BUCKETS)
        return target

    # the threshold is set on means under models that have not seen the text: a text's own rare n-grams look good to its own model
    halves = [found[0::2], found[1::2]]
    means = [(mean_ratio(ratio, f), q) for own, other in (halves, halves[::-1]) for ratio in [log_ratio(counted(other), raw)] for f, q in own]
    return Model(log_ratio(counted(found), raw), choose(means))


def mean_ratio(ratio: np.ndarray, f: np.ndarray) -> float:
    return float(ratio[f].mean()) if len(f) else 0.0


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw per feature; each kind is a distribution, smoothed towards raw."""
    out = np.empty(KINDS * BUCKETS)
    for kind in (slice(i * BUCKETS, (i + 1) * BUCKETS) for i in range(KINDS)):
        p = (raw[kind] + 1) / (raw[kind] + 1).sum()
        weight = 20.0 * BUCKETS / 64
        q = (target[kind] + weight * p) / (target[kind].sum() + weight)
        out[kind] = np.log(q / p)
    return out


def choose(found: list[tuple[float, int]]) -> float:
    """The threshold on the mean log ratio: the best cut that keeps KEEP of the good sample."""
    mean, y = np.array([m for m, _ in found]), np.array([q for _, q in found])
    most = np.quantile(mean[y == 1], 1 - KEEP)
    bad = mean[(y == 0) & (mean < most)]
    return float((bad.max() + most) / 2) if len(bad) else float(most) - 1e-9


def weigh(docs: DataFrame, model: Model, carry: list = ()) -> DataFrame:
    """(carry..., log_weight, n_features, mean_ratio, accepted) of every text."""
    at = docs.sparkSession.sparkContext.broadcast(model)
    plan, kinds = with_text(docs, [F.col(c) if isinstance(c, str) else c for c in carry])

    def run(batches):
        use("quality")
        m = at.value
        for b in batches:
            got = [m.weigh(t.as_py()) for t in b.column(b.num_columns - 1)]
            w, n = np.array([g[0] for g in got]), np.array([g[1] for g in got], np.int64)
            mean = w / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(w), pa.array(n), pa.array(mean), pa.array((mean >= m.threshold) | (n == 0))], [*b.schema.names[:-1], "log_weight", "n_features", "mean_ratio", "accepted"])

    return plan.mapInArrow(run, f"{kinds}log_weight double, n_features long, mean_ratio double, accepted boolean")


def gumbel(*cols, seed: int = 42):
    """Standard Gumbel noise from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_long(ordered: DataFrame, k: int) -> int | None:
    """The exact k-th largest of the only column, a long, or None with fewer rows; counts it by 16 bits at a time."""
    name, low, left = ordered.columns[0], None, k
    for shift in (48, 32, 16, 0):
        some = ordered if low is None else ordered.where(F.shiftright(name, shift + 16) == low)
        ranges = sorted(((r["b"], r["n"]) for r in some.groupBy(F.shiftright(name, shift).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 2^16
        for b, n in ranges:
            if left <= n:
                low = b
                break
            left -= n
        else:
            return None
    return low


def kth_key(keys: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest double of a column, or None with fewer rows."""
    def order(batches):
        for b in batches:
            bits = b.column(0).to_numpy(zero_copy_only=False).astype("<f8").view(np.int64)
            yield pa.RecordBatch.from_pydict({"o": pa.array(np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits))})

    low = kth_long(keys.select((F.col(column).cast("double") + F.lit(0.0)).alias("key")).mapInArrow(order, "o long"), k)
    if low is None:
        return None
    bits = low if low >= 0 else ~(low ^ -(1 << 63))
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def resample(weighed: DataFrame, k: int | Column, by: list[str], seed: int = 42, log_weight: Column | str = "log_weight") -> DataFrame:
    """Adds ``gumbel_key`` and ``sampled``: the Gumbel top-k of the rows, by log weight.

    ``by`` names what the noise is a hash of; k is a number, or a condition whose rows it counts.
    """
    log_weight = F.col(log_weight) if isinstance(log_weight, str) else log_weight
    keyed = stage(weighed.withColumn("gumbel_key", log_weight + gumbel(*by, seed=seed)).withColumn("_row", F.monotonically_increasing_id()), "quality-keys")
    if isinstance(k, Column):
        k = keyed.where(k).count()
    at = kth_key(keyed.select("gumbel_key"), "gumbel_key", k) if k > 0 else None
    if at is None:  # none, or all
        return keyed.withColumn("sampled", F.lit(k > 0)).drop("_row")
    key = F.col("gumbel_key") + F.lit(0.0)
    above, ties = keyed.agg(F.count_if(key > at), F.count_if(key == at)).first()
    won = key >= at
    if above + ties > k:
        last = -kth_long(keyed.where(key == at).select((-F.col("_row")).alias("o")), k - above)
        won = (key > at) | ((key == at) & (F.col("_row") <= last))
    return keyed.withColumn("sampled", won).drop("_row")
