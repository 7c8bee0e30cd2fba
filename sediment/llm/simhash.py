"""SimHash fingerprints, and exact links between close ones through vantage-point trees.

Fingerprints of equal text collapse before anything is compared. A top tree, built on
the driver from a sample of one in a thousand or 20,000, splits Hamming space into shards: each node holds a
vantage fingerprint and a radius. Every fingerprint has one home shard, and is also
sent to each shard that the triangle bound can't rule out for it, so every pair within
the distance meets in the home shard of either one. A shard's task searches its home
fingerprints with a tree of its own, all queries of a node at once, and returns a star
to each local group's smallest member instead of its pairs. Labels then flow over the
stars until they settle; each round is staged and no join input is an aggregate, so
that Spark can split a hub's partition.

The sample only places the shards' borders: results don't depend on it.

Defined cases: null text is empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle make one shingle; repeated rows and ids
keep a row each; a null doc_id can join a component and doesn't name it (a component
of null ids alone has a null id); an empty table gives no row. Other columns of the
input are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sediment.llm.common import new_path, scratch, stage, text_bytes

SEED = 42
#: Fingerprints that a shard is meant to hold; fingerprints in the top tree's sample at least, and for each shard.
SHARD, SAMPLE, PER_SHARD = 8192, 20_000, 8
LEAF = 256


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of lower-cased UTF-8 text, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - width + 1
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[width - 1:] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """64 bits, each set if over half the hashes have it; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        total += np.unpackbits(hashes[i:i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def top_tree(sample: np.ndarray, shards: int, next_id: list[int] | None = None):
    """Nested (vantage, radius, inside, outside); a leaf is its shard's number."""
    next_id = next_id if next_id is not None else [0]
    if shards > 1 and len(sample) > 1:
        # of a few candidates, the vantage whose border zone holds fewest
        best = None
        for v in sample[:: max(1, len(sample) // 16)][:16]:
            d = np.bitwise_count(sample ^ v).astype(np.int64)
            r = int(np.median(d))
            share = (d <= r).mean()
            if share < 1:
                border = (np.abs(d - r) <= 2).mean() + abs(share - 0.5)
                if best is None or border < best[0]:
                    best = (border, v, r, d)
        if best:
            _, v, r, d = best
            return (v, r, top_tree(sample[d <= r], shards // 2, next_id), top_tree(sample[d > r], shards - shards // 2, next_id))
    next_id[0] += 1
    return next_id[0] - 1


def place(tree, fp: np.ndarray, distance: int):
    """(row, shard, home) of every shard each fingerprint has to reach."""
    out = []

    def walk(node, rows, home):
        if not len(rows):
            return
        if isinstance(node, int):
            out.append((rows, np.full(len(rows), node, np.int32), home))
            return
        v, r, inside, outside = node
        d = np.bitwise_count(fp[rows] ^ v).astype(np.int64)
        a, b = d - distance <= r, d + distance > r
        walk(inside, rows[a], home[a] & (d[a] <= r))
        walk(outside, rows[b], home[b] & (d[b] > r))

    walk(tree, np.arange(len(fp)), np.ones(len(fp), bool))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)]


def settle(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component of the graph with edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class _Links:
    """Collects index pairs and folds them into stars before they grow large."""

    def __init__(self, n: int, most: int = 1 << 20):
        self.n, self.most, self.parts, self.held = n, most, [], 0

    def add(self, a, b):
        self.parts.append((a, b))
        self.held += len(a)
        if self.held > self.most:
            label = self.labels()
            own = np.flatnonzero(label != np.arange(self.n))
            self.parts, self.held = [(own, label[own])], len(own)
            self.most = max(self.most, 2 * len(own))

    def labels(self) -> np.ndarray:
        a, b = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 2
        return settle(a, b, self.n)


def search(fp: np.ndarray, home: np.ndarray, queries: np.ndarray, distance: int, links: _Links, check=None) -> None:
    """Links each query (an index) to each home fingerprint within the distance, if ``check`` holds for the pair."""
    if not len(home) or not len(queries):
        return
    if len(home) > LEAF and len(queries) > 1:
        v = fp[home[len(home) // 2]]
        d = np.bitwise_count(fp[home] ^ v).astype(np.int64)
        r = int(np.median(d))
        near = d <= r
        if 0 < near.sum() < len(home):
            q = np.bitwise_count(fp[queries] ^ v).astype(np.int64)
            search(fp, home[near], queries[q - distance <= r], distance, links, check)
            search(fp, home[~near], queries[q + distance > r], distance, links, check)
            return
    h = fp[home]
    for i in range(0, len(queries), 2048):
        q = queries[i:i + 2048]
        for j in range(0, len(h), 2048):
            x, y = np.nonzero(np.bitwise_count(fp[q][:, None] ^ h[None, j:j + 2048]) <= distance)
            x, y = q[x], home[j + y]
            real = x != y if check is None else (x != y) & check(x, y)
            links.add(x[real], y[real])


def links(distinct: DataFrame, count: int, distance: int, shard: int = SHARD) -> DataFrame:
    """(fp, to): stars that span every group of distinct fingerprints linked within a shard."""
    spark = distinct.sparkSession
    shards = max(1, -(-count // shard))
    # by a threshold on a hash, a thousandth of the fingerprints once they are many, so shards stay as large as they are meant
    want = max(SAMPLE, PER_SHARD * shards)
    some = distinct.select("fp").where(F.xxhash64("fp") <= min((1 << 63) - 1, int(want / max(1, count) * (1 << 64)) - (1 << 63)))
    sample = np.sort(np.array([r["fp"] for r in some.collect()], np.int64).view(np.uint64))
    sample = np.random.default_rng(1).permutation(sample)
    tree = spark.sparkContext.broadcast(top_tree(sample, shards))

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            rows, at, home = place(tree.value, fp.view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(fp[rows]), pa.array(home)], ["shard", "fp", "home"])

    def solve(batches):
        def one(parts):
            fp = np.concatenate([p[0] for p in parts])
            home = np.flatnonzero(np.concatenate([p[1] for p in parts]))
            bits, found = fp.view(np.uint64), _Links(len(fp))
            search(bits, home, np.arange(len(fp)), distance, found)
            label = found.labels()
            own = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[label[own]])], ["fp", "to"])

        parts, now = [], None
        for b in batches:
            at, fp, home = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(np.diff(at)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(at)]):
                if s == e:
                    continue
                if parts and at[s] != now:
                    yield one(parts)
                    parts = []
                now = at[s]
                parts.append((fp[s:e], home[s:e]))
        if parts:
            yield one(parts)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread_out = distinct.select("fp").mapInArrow(spread, "shard int, fp long, home boolean")
    return spread_out.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(solve, "fp long, to long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) of every fingerprint on an edge: the smallest one reachable.

    Each round takes the least label among neighbours, hands it to the label that a node
    had as well, and then takes that label's own label, so labels halve their distance and
    rounds grow with the logarithm of a component's diameter. Labels only fall, so it ends.
    """
    spark = edges.sparkSession
    with scratch(spark) as kept:
        both = stage(edges.select(F.col("fp").alias("a"), F.col("to").alias("b")).unionByName(edges.select(F.col("to").alias("a"), F.col("fp").alias("b"))), "simhash-edges")
        kept.append(new_path(spark, "simhash-labels"))
        labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "fp"), "simhash-labels", kept[0])
        state = None
        while True:
            now = labels.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,0)"))).first()
            if tuple(now) == state:
                return labels
            state, path = tuple(now), new_path(spark, "simhash-labels")
            with scratch(spark) as round_kept:
                round_kept.append(path)
                labels = hop(both, labels, path)
            kept[0] = path


def hop(both: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """One round of ``components``."""
    # the label of each neighbour, then the least of them with one's own
    none = F.lit(None).cast("long")
    far = both.join(labels, both["b"] == labels["fp"]).select("a", "label", none.alias("old"))
    near = stage(far.unionByName(labels.select(F.col("fp").alias("a"), "label", F.col("label").alias("old"))).groupBy("a").agg(F.min("label").alias("label"), F.max("old").alias("old")), "simhash-near")
    # a node's old label is hooked to the least one that the node has met
    hooked = near.select("a", "label").unionByName(near.where("label < old").select(F.col("old").alias("a"), "label"))
    least = stage(hooked.groupBy("a").agg(F.min("label").alias("label")), "simhash-round")
    jump = least.select(F.col("a").alias("at"), F.col("label").alias("next"))
    return stage(least.join(jump, least["label"] == jump["at"]).select(F.col("a").alias("fp"), F.least("label", "next").alias("label")), "simhash-labels", path)


def classes(fps: DataFrame, distance: int = 2, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): the smallest doc_id reachable over links."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    count = distinct.count()
    if not count:
        return fps.withColumn("component_id", F.col("doc_id"))
    labels = components(links(distinct, count, distance, shard))
    named = stage(distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-named")
    least = stage(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    of = stage(named.join(least, "label").select("fp", "component_id"), "simhash-of")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    fps = stage(fingerprints(docs, width), "simhash-fingerprints", new_path(docs.sparkSession, "simhash-fingerprints"))
    return classes(fps, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
