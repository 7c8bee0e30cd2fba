"""Exact top-k inner products through a pivot-distance index.

Inner products become distances: each vector x gets one more component,
sqrt(M - |x|^2) with M the greatest squared length, and a query gets 0 there, so that
|q' - x'|^2 = |q|^2 + M - 2 q.x and the nearest are the highest scoring. Each vector
is keyed by its nearest pivot and its distance r from it; the distances of a pivot
fall into rings, annuli that are sorted by distance and cut into blocks of ``BLOCK``
vectors, each with the least and greatest of its distances. For a query at distance D
from a pivot, no vector of an annulus [low, high] is nearer than max(0, D - high, low - D).

Search expands rings by rising bound. The first round takes the nearest rings that
hold ``FIRST`` vectors, which gives each query its k-th score; the second takes those
further rings whose bound does not exceed that distance, and in them those blocks
whose bound does not, and stops there. Rings are joined with the query vectors that need
them, in blocks of both, and every block keeps its k best per query. Distances only
choose rings and blocks; scores are exact integers.

Pivots and rings come from a bounded sample and only affect how much is skipped: all
vectors are indexed and the result is exact, so recall is 1. There are about as many
rings as the square root of the vectors, so the table of rings that every task holds and
what one ring holds both grow with the root of the input.

Defined cases: a vector that is null, or has a null or non-finite component, or no id,
takes no part; shorter vectors count as padded with zeros; candidates with a query's
own id are its own row; repeated ids are separate candidates, and a repeated query id
asks with its least vector; an empty table gives no row; vectors without components score
0; a score beyond a signed 64-bit integer is the greatest or least one, and such scores
tie; vectors whose squared length is no finite double are not ruled out by distance.
Other columns of the input are ignored.
"""
from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sediment.llm.common import stage

#: Pivots at most, rings of a pivot at least, and vectors that place both.
PIVOTS, RINGS, SAMPLE = 1024, 8, 8192
FIRST = 1024
BLOCK, QUERY_BLOCK = 1024, 256
EXACT = 2.0 ** 53


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v, dim, norm): v holds floor(scale * x) as little-endian doubles, which are integers."""
    def run(batches):
        for b in batches:
            ids, vs, dims, norms = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(v * scale) + 0.0
                ids.append(i)
                vs.append(v.astype("<f8").tobytes())
                dims.append(len(v))
                norms.append(float(v @ v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], ["vec_id", "v", "dim", "norm"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary, dim int, norm double")


def layout(n: int) -> tuple[int, int]:
    """(pivots, rings of each) for n vectors: about the root of n rings in all, and at least 64."""
    root = max(64, math.isqrt(n))
    pivots = min(PIVOTS, max(8, root // 16))
    return pivots, max(RINGS, root // pivots)


def matrix(blobs, dim: int) -> np.ndarray:
    """Rows of doubles, zero-padded to ``dim``."""
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, "<f8")
        out[i, :len(v)] = v
    return out


class Pivots:
    """Pivot points in the augmented space and each pivot's ring borders."""

    def __init__(self, sample: np.ndarray, greatest: float, pivots: int, rings: int, steps: int = 5):
        self.greatest, self.rings = greatest, rings
        self.bounded = bool(np.isfinite(8 * greatest))
        if not self.bounded:  # distances say nothing: one pivot, one ring
            self.points, self.borders = np.zeros((1, sample.shape[1] + 1)), np.zeros((1, rings - 1))
            return
        x = np.hstack([sample, np.sqrt(np.maximum(0, greatest - (sample ** 2).sum(1)))[:, None]])
        p = x[np.unique(np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int))]
        for _ in range(steps):
            near = self._far(x, p).argmin(1)
            p = np.array([x[near == j].mean(0) if (near == j).any() else p[j] for j in range(len(p))])
        self.points = p
        d = self._far(x, p)
        near, r = d.argmin(1), d.min(1)
        self.borders = np.array([np.quantile(r[near == j], np.arange(1, rings) / rings) if (near == j).any() else np.zeros(rings - 1) for j in range(len(p))])

    @staticmethod
    def _far(x, p):
        return np.sqrt(np.maximum(0, (x ** 2).sum(1)[:, None] + (p ** 2).sum(1) - 2 * x @ p.T))

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        if not self.bounded:
            return np.zeros((len(v), 1))
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.greatest - (v ** 2).sum(1)))
        return self._far(np.hstack([v, last[:, None]]), self.points)

    def key(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ring number, distance from the nearest pivot) of each vector."""
        d = self.distances(v, False)
        near, r = d.argmin(1), d.min(1)
        inner = (r[:, None] > self.borders[near]).sum(1)
        return near * self.rings + inner, r


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; beyond signed 64 bits the greatest or least such integer."""
    most = (np.abs(q).max(initial=0) or 0) * (np.abs(x).max(initial=0) or 0) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    least, greatest = -(1 << 63), (1 << 63) - 1
    whole, x = np.empty((len(q), len(x)), np.int64), [[int(b) for b in s] for s in x]
    for i, r in enumerate(q):
        r = [int(a) for a in r]
        whole[i] = [min(greatest, max(least, sum(map(operator.mul, r, s)))) for s in x]
    return whole


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    clean = stage(quantized(vectors, id_col, vector_col), "topk-vectors")
    n, dim, greatest = clean.agg(F.count("*"), F.max("dim"), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots, per_pivot = layout(n)
    # by a threshold on a hash first, so that tasks send about as many rows as are taken
    u = F.xxhash64("vec_id", "v")
    some = clean.where(u <= min((1 << 63) - 1, int(2 * SAMPLE / n * (1 << 64)) - (1 << 63))).orderBy(u, "vec_id", "v").limit(SAMPLE)
    sample = matrix([r["v"] for r in some.collect()], dim)
    at = spark.sparkContext.broadcast(Pivots(sample, greatest, pivots, per_pivot))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches):
        for b in batches:
            ring, r = at.value.key(matrix(b.column(1).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ring.astype(np.int32)), pa.array(r)], ["vec_id", "v", "ring", "r"])

    index = stage(clean.select("vec_id", "v").mapInArrow(keyed, "vec_id long, v binary, ring int, r double")
                  .repartitionByRange(parts, "ring", "r", "vec_id").sortWithinPartitions("ring", "r", "vec_id"), "topk-index")
    # about the root of n rows
    table = sorted(tuple(r) for r in index.groupBy("ring").agg(F.min("r"), F.max("r"), F.count("*")).collect())
    rings = np.array([t[0] for t in table])
    low, high, held = (np.array([t[i] for t in table], float) for i in (1, 2, 3))

    def blocks(size):
        """Runs of a ring's vectors, by distance, as one row: ids, matrix, least and greatest distance."""
        def run(batches):
            ids, vs, rs, now = [], [], [], None

            def row():
                return pa.RecordBatch.from_pydict({"ring": pa.array([now], pa.int32()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "m": pa.array([matrix(vs, dim).tobytes()], pa.binary()),
                                                   "low": pa.array([min(rs)], pa.float64()), "high": pa.array([max(rs)], pa.float64())})

            for b in batches:
                for i, v, g, r in zip(*(c.to_pylist() for c in b.columns)):
                    if ids and (g != now or len(ids) >= size):
                        yield row()
                        ids, vs, rs = [], [], []
                    now = g
                    ids.append(i)
                    vs.append(v)
                    rs.append(r)
            if ids:
                yield row()
        return run

    kinds = "ring int, ids binary, m binary, low double, high double"
    blocked = stage(index.select("vec_id", "v", "ring", "r").mapInArrow(blocks(BLOCK), kinds), "topk-blocks")
    asked = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "ring", "r")).alias("x")).select("vec_id", "x.v", "x.ring", "x.r")
    asked = asked.repartitionByRange(parts, "ring", "vec_id").sortWithinPartitions("ring", "vec_id")
    queries = stage(asked.mapInArrow(blocks(QUERY_BLOCK), kinds).select("ring", "ids", "m"), "topk-queries")

    def vectors_of(raw, ids):
        return np.frombuffer(raw, "<f8").reshape(len(ids), dim)

    def reach(m, s):
        """How far from each query a vector of score s or more can be: a hair of slack for rounding, never less than the bound."""
        if not at.value.bounded:
            return np.full(len(m), np.inf)
        far = np.sqrt(np.maximum(0, (m ** 2).sum(1) + at.value.greatest - 2 * s))
        return far * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(at.value.greatest))

    def bounds(m):
        d = at.value.distances(m, True)[:, rings // per_pivot]
        return np.maximum(0, np.maximum(d - high, low - d))

    def nearest(lb):
        """The first round's rings: by rising bound until FIRST vectors are held."""
        order = np.argsort(lb, axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        want = np.zeros(lb.shape, bool)
        np.put_along_axis(want, order, before < FIRST, axis=1)
        return want

    def ask(limits):
        """(ring, qids, q, least) of the query vectors that each ring has to answer, and the least score of use."""
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    ids = np.frombuffer(r["ids"], "<i8")
                    m = vectors_of(r["m"], ids)
                    lb = bounds(m)
                    want, s = nearest(lb), np.full(len(ids), -np.inf)
                    if limits:  # no k-th score yet: every ring
                        s = np.frombuffer(r["kth"], "<f8")
                        want = (lb <= reach(m, s)[:, None]) & ~want
                    use = np.flatnonzero(want.any(0))
                    for some in (use[i:i + 16] for i in range(0, len(use), 16)):
                        yield pa.RecordBatch.from_pydict({"ring": pa.array(rings[some].astype(np.int32)), "qids": pa.array([ids[want[:, j]].tobytes() for j in some], pa.binary()), "q": pa.array([m[want[:, j]].tobytes() for j in some], pa.binary()),
                                                          "least": pa.array([s[want[:, j]].tobytes() for j in some], pa.binary())})
        return run

    def answer(batches):
        for b in batches:
            for r in b.to_pylist():
                qi, xi, least = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["least"], "<f8")
                q = vectors_of(r["q"], qi)
                d = at.value.distances(q, True)[:, r["ring"] // per_pivot]
                near = np.maximum(d - r["high"], r["low"] - d) <= reach(q, least)
                if not near.any():
                    continue
                qi, q, least = qi[near], q[near], least[near]
                s = inner(q, vectors_of(r["m"], xi))
                rows = []
                for i, own in enumerate(qi):
                    other = np.flatnonzero((xi != own) & (s[i] >= least[i]))
                    top = other[best(s[i, other], xi[other], k)]
                    rows.append((np.full(len(top), own), xi[top], s[i, top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    def answers(work):
        # a block of queries is asked of many rings, so the work's size on disk says little of what a broadcast would hold
        return stage(stage(work, "topk-work").join(blocked.hint("merge"), "ring").mapInArrow(answer, out), "topk-found")

    def ranked(found):
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    work = "ring int, qids binary, q binary, least binary"
    first = answers(queries.mapInArrow(ask(False), work))
    kth = ranked(first).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("s")).alias("s"))

    def attach(batches):
        for b in batches:
            got = b.to_pylist()
            yield pa.RecordBatch.from_pydict({"ids": pa.array([r["ids"] for r in got], pa.binary()), "m": pa.array([r["m"] for r in got], pa.binary()),
                                              "kth": pa.array([np.array([(dict(zip(r["known"], r["scores"]))).get(i, -np.inf) for i in np.frombuffer(r["ids"], "<i8").tolist()], "<f8").tobytes() for r in got], pa.binary())})

    def opened(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(ids), r["block"])), "query_id": pa.array(ids)})

    numbered = stage(queries.select("ids", "m", F.monotonically_increasing_id().alias("block")), "topk-numbered")
    known = (numbered.select("block", "ids").mapInArrow(opened, "block long, query_id long").join(kth.where("s is not null"), "query_id")
             .groupBy("block").agg(F.collect_list("query_id").alias("known"), F.collect_list(F.col("s").cast("double")).alias("scores")))
    empty = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<double>)")
    limited = numbered.join(known, "block", "left").select("ids", "m", F.coalesce("known", empty[0]).alias("known"), F.coalesce("scores", empty[1]).alias("scores")).mapInArrow(attach, "ids binary, m binary, kth binary")
    second = answers(limited.mapInArrow(ask(True), work))
    return ranked(first.unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
