"""Near copies by word shingles: SimHash finds candidates, exact Jaccard similarity links them.

Candidates come from two searches. Fingerprints of 64 bits at most ``NEAR`` apart are found
as ``simhash`` does: a top vantage-point tree as shard map, replicas for border zones, local
trees, stars instead of pairs; no such pair is missed, whatever the texts.

For texts of which a fifth may differ, fingerprints of 64 bits are up to 18 bits apart,
and at that radius a vantage-point tree over all fingerprints can't rule any branch
out: the border zone is wider than the spread of random distances. So for what is further
apart the shards that are searched come from the texts: each text has ``ANCHORS`` anchors, its least
shingles under as many hash orders, and two texts of similarity s share one with
probability 1 - (1 - s) ** ANCHORS, 1 - 4e-9 at 0.8. Texts meet per anchor and class of
size, which splits common anchors. There all pairs are compared by 256 bits of the same
kind, which keep texts apart that share little but a common passage. Pairs at 0.8 differ
in up to 0.16 of their bits (0.19 of four shingles and five), so by the binomial tail at
most 2e-11 of them are out of reach, 1e-12 if short: far fewer than share no anchor.

Linked texts form candidate families, and only one text of each set of shingles in them is
read again. A family is cut into blocks; each block is compared whole, and with the
family's ``LEADERS``, all intersections at once. What these links don't join to the
family's largest part yet is then compared with all of it, block by block; two blocks of
that part have nothing left to decide. So a family of F texts of which U stay apart costs
F + U * F / BLOCK rows, not F * F. Links are those of exact similarity, and the classes
are their components. Texts with the same shingles collapse first, so groups of copies
cost nothing; no pair of a group is ever written, only links that joined two parts.

Whole texts are shuffled only if more than ``BROADCAST_ROWS`` rows have to be looked up or
left out; up to that their names are broadcast, 16 bytes each.

Defined cases: null text is empty; texts without words are alike and like no other; fewer
words than a shingle make one shingle; repeated rows and ids keep a row each in
``classes``, and ``deduplicated`` keeps one row; a null doc_id is kept only if all ids of
its class are null, and then one row stays; an empty table gives no row. Columns of any
other name are carried and never read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sediment.llm import simhash
from sediment.llm.common import new_path, renamed, scratch, stage, text_bytes, use
from sediment.llm.simhash import _Links, components, fingerprint, settle, shingle_hashes

#: Bits of 64 by which fingerprints differ that the vantage-point trees link, as in ``simhash.near_duplicates``.
NEAR = 2
ANCHORS = 12
#: Bits of 256 by which candidates may differ; the second where a text has at most SHORT shingles.
WIDE_REACH, SHORT = (84, 96), 24
#: Ratio of the borders of classes of size; texts of a family that are compared in one task with as many others;
#: those of a family that all its others are compared with first.
SIZES, BLOCK, LEADERS = 1.25 ** 4, 512, 32
#: Texts of a place that are compared in one task.
PLACE = 8192
#: Rows of names, of 16 bytes, that are broadcast at most; beyond it texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
BUFFER = 1 << 16
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (1 << 64) - 1 for i in range(ANCHORS)], np.uint64)


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(raw, width))


def anchors(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each hash order."""
    out = np.empty(ANCHORS, np.uint64)
    for i, m in enumerate(_MIX):
        x = shingles * m
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        out[i] = x.min()
    return out


def wide(shingles: np.ndarray) -> bytes:
    """A 256-bit fingerprint; its first 64 bits are ``simhash.fingerprint``."""
    words, x = [], shingles
    for m in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        if m:
            x = shingles * np.uint64(m)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        words.append(fingerprint(x))
    return np.array(words, "<u8").tobytes()


def within(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs of wide fingerprints are candidates."""
    limit = np.where(np.minimum(na, nb) <= SHORT, WIDE_REACH[1], WIDE_REACH[0])
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= limit


def met_within(w: np.ndarray, n: np.ndarray, found: _Links, step: int = 1024) -> None:
    """Links all pairs of candidates of one place, a block of rows against a block of rows at a time."""
    for i in range(0, len(w), step):
        for j in range(i, len(w), step):
            a, b = w[i:i + step], w[j:j + step]
            apart = np.zeros((len(a), len(b)), np.uint16)
            for k in range(w.shape[1]):
                apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
            short = (n[i:i + step] <= SHORT)[:, None] | (n[j:j + step] <= SHORT)
            x, y = np.nonzero(apart <= np.where(short, WIDE_REACH[1], WIDE_REACH[0]))
            some = i + x < j + y
            found.add(i + x[some], j + y[some])


def unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("mark"), text_bytes().alias("text"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, key, n, wide, anchors) of every row; rows with one key have the same shingles."""
    def run(batches):
        from xxhash import xxh3_64_intdigest

        use("similar")
        for b in batches:
            key, n, fp, spots = [], [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                fp.append(wide(s))
                key.append(xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                spots.append(anchors(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(spots, pa.binary())],
                                             ["doc_id", "mark", "key", "n", "wide", "anchors"])

    return marked(docs).mapInArrow(run, "doc_id long, mark long, key long, n int, wide binary, anchors binary")


def meetings(distinct: DataFrame) -> DataFrame:
    """(place, key, n, wide): each text at its anchors, with its class of size and, if it reaches there, the next."""
    def run(batches):
        for b in batches:
            key, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            spots = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(len(n), ANCHORS)
            # a text of n shingles is alike to none beyond 1.25 n, so few texts reach into the next class
            size, up = (np.floor(np.log(n * f) / np.log(SIZES)).astype(np.uint64) for f in (1.0, 1.25 + 1e-9))
            for some, at in ((np.arange(len(n)), size), (np.flatnonzero(up > size), up)):
                place = spots[some] ^ (np.arange(ANCHORS, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)) ^ (at[some] * np.uint64(0xD6E8FEB86659FD93))[:, None]
                rows = pa.array(np.repeat(some, ANCHORS))
                yield pa.RecordBatch.from_arrays([pa.array(place.reshape(-1).view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows)], ["place", "key", "n", "wide"])

    return distinct.where("n > 0").select("key", "n", "wide", "anchors").mapInArrow(run, "place long, key long, n int, wide binary")


def met_by_place(distinct: DataFrame) -> DataFrame:
    """``meetings`` dealt out by place; a place of more than ``PLACE`` texts is cut into blocks, and each pair of blocks is a place."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = meetings(distinct)
    hot = stage(met.groupBy("place").agg(F.ceil(F.count("*") / PLACE).cast("int").alias("blocks")).where("blocks > 1"), "similar-hot")
    held = hot.count()
    if held:
        met = met.join(F.broadcast(hot) if held <= BROADCAST_ROWS else hot, "place", "left")
        own = F.pmod(F.xxhash64("key"), "blocks")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.withColumn("own", own).withColumn("other", other)
        place = F.when(F.col("blocks").isNull(), F.col("place")).otherwise(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")))
        met = met.select(place.alias("place"), "key", "n", "wide")
    return met.repartition(parts, "place").sortWithinPartitions("place", "key")


def candidates(met: DataFrame) -> DataFrame:
    """(fp, to): stars over the keys that meet within reach; input sorted by place and key."""
    def solve(place, key, n, w):
        a, b = [], []
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sizes = np.diff(np.append(starts, len(place)))
        for gap in range(1, 6):  # small places, all at once
            i = np.flatnonzero(place[gap:] == place[:-gap])
            i = i[np.repeat(sizes, sizes)[i] <= 6]
            a.append(i)
            b.append(i + gap)
        a, b = [np.concatenate(a)], [np.concatenate(b)]
        ok = within(w[a[0]], w[b[0]], n[a[0]], n[b[0]])
        a, b = [a[0][ok]], [b[0][ok]]
        for s, m in zip(starts[sizes > 6], sizes[sizes > 6]):
            found, every = _Links(int(m)), np.arange(m)
            met_within(w[s:s + m], n[s:s + m], found)
            label = found.labels()
            own = np.flatnonzero(label != every)
            a.append(s + own)
            b.append(s + label[own])
        # stars to the least key of each place, the same one wherever it takes part
        label = settle(np.concatenate(a), np.concatenate(b), len(place))
        own = np.flatnonzero(label != np.arange(len(place)))
        pair = np.unique(np.stack([key[own], key[label[own]]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["fp", "to"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append([*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)), unpacked(b.column(3))])
            n += b.num_rows
            if n >= BUFFER:
                cols = [np.concatenate(c) for c in zip(*held)]
                last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last place may go on
                if last:
                    yield solve(*(c[:last] for c in cols))
                held, n = [[c[last:] for c in cols]], len(cols[0]) - last
        if n:
            yield solve(*(np.concatenate(c) for c in zip(*held)))

    return met.mapInArrow(run, "fp long, to long").distinct()


def near_prints(distinct: DataFrame) -> DataFrame:
    """(fp, to): stars over the keys whose first 64 bits are linked within ``NEAR``, by the shards of a vantage-point tree."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(unpacked(b.column(1))[:, 0].view(np.int64))], ["key", "print"])

    prints = stage(distinct.where("n > 0").select("key", "wide").mapInArrow(run, "key long, print long"), "similar-prints")
    least = stage(prints.groupBy("print").agg(F.min("key").alias("least")), "similar-least")
    same = prints.join(least, "print").where("key > least").select(F.col("key").alias("fp"), F.col("least").alias("to"))
    count = least.count()
    if not count:
        return same
    stars = stage(simhash.links(least.select(F.col("print").alias("fp")), count, NEAR, simhash.SHARD), "similar-stars")
    ends = [least.select(F.col("print").alias(c), F.col("least").alias(f"{c}_key")) for c in ("fp", "to")]
    return same.unionByName(stars.join(ends[0], "fp").join(ends[1], "to").select(F.col("fp_key").alias("fp"), F.col("to_key").alias("to")))


def linked(sets: list[np.ndarray], similarity: float, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the texts of a block that exact similarity joins, from all its intersections at once."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # only shingles of two texts or more meet
    owner, column = np.repeat(np.arange(m), sizes)[shared], column[shared]
    column = (np.cumsum(times > 1) - 1)[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        some = slice(*np.searchsorted(column, [low, low + step]))
        held = np.zeros((m, step), np.float32)
        held[owner[some], column[some] - low] = 1
        both += held @ held.T
    a, b = np.nonzero(both >= similarity * (sizes[:, None] + sizes - both) - 1e-6)
    label = settle(a, b, m)
    own = np.flatnonzero(label != np.arange(m))
    return own, label[own]


def few(names: DataFrame) -> DataFrame:
    """A staged table of (doc_id, mark, small columns), marked for broadcast if its counted rows allow it."""
    return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names


def compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """(fp, to): exact links within each group of (label, i, j) among rows of (label, i, j, key, shingles)."""
    def solve(batches):
        def one(rows):
            by = {r[0]: r for r in rows}  # a leader is also in its own block
            if len(by) < 2:
                return None
            rows = list(by.values())
            key = np.array([r[0] for r in rows], np.int64)
            a, b = linked([np.frombuffer(r[1], np.uint64) for r in rows], similarity)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(key[a], key[b])), pa.array(np.minimum(key[a], key[b]))], ["fp", "to"]) if len(a) else None

        rows, now = [], None
        for b in batches:
            for *at, key, s in zip(*(c.to_pylist() for c in b.columns)):
                if at != now:
                    if (got := one(rows)) is not None:
                        yield got
                    rows, now = [], at
                rows.append((key, s))
        if (got := one(rows)) is not None:
            yield got

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("label", "i", "j", "key", "shingles").repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j", "key").mapInArrow(solve, "fp long, to long").distinct()


def verified(docs: DataFrame, families: DataFrame, distinct: DataFrame, width: int, similarity: float) -> DataFrame:
    """(fp, to): exact links that join the keys of each candidate family as far as they are alike."""
    sizes = stage(families.groupBy("label").agg(F.count("*").alias("size")), "similar-sizes")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block_of = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    members = stage(families.join(sizes, "label").select(F.col("fp").alias("key"), "label", blocks("size").alias("blocks")), "similar-members")
    named = stage(distinct.select("key", "doc_id", "mark").join(members, "key"), "similar-named")
    d, n = marked(docs).alias("d"), few(named).alias("n")
    texts = d.join(n, F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.mark") == F.col("n.mark"))).select("n.key", "n.label", "n.blocks", "d.text")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingle_set(t.as_py(), width).tobytes() for t in b.column(3)], pa.binary())], ["key", "label", "blocks", "shingles"])

    held = stage(texts.mapInArrow(sets, "key long, label long, blocks int, shingles binary"), "similar-sets")
    large = held.where("blocks > 1")
    own = held.withColumn("i", block_of("blocks")).withColumn("j", F.lit(0))
    if large.isEmpty():
        return compared(own, similarity)
    # about LEADERS of each family, by a threshold on a hash, and no group in one place
    leads = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks") * max(1, BLOCK // LEADERS)) == 0
    spread = large.where(leads).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.lit(0))
    first = stage(compared(own.unionByName(spread), similarity), "similar-first")
    # what is still apart in a large family is compared with all of it
    parts = components(first)
    split = stage(large.join(parts.select(F.col("fp").alias("key"), F.col("label").alias("part")), "key", "left").select("label", "key", "shingles", F.coalesce("part", "key").alias("part")), "similar-parts")
    by_part = stage(split.groupBy("label", "part").agg(F.count("*").alias("size")), "similar-part-sizes")
    main = by_part.groupBy("label").agg(F.max(F.struct("size", "part")).alias("x"), F.sum("size").alias("all")).select("label", F.col("x.part").alias("main"), F.col("x.size").alias("inner"), (F.col("all") - F.col("x.size")).alias("outer"))
    apart = stage(main.where("outer > 0").select("label", "main", blocks("inner").alias("inside"), blocks("outer").alias("outside")), "similar-apart")
    rest = split.join(apart, "label")
    # blocks are numbered from 0 for what is apart, then on for the largest part
    rest = rest.withColumn("own", F.when(F.col("part") == F.col("main"), F.col("outside") + block_of("inside")).otherwise(block_of("outside")))
    last = F.col("outside") + F.when(F.col("part") == F.col("main"), 0).otherwise(F.col("inside")) - 1
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    second = compared(rest.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "shingles"), similarity)
    return first.unionByName(second)


def classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, mark, class_id, kept_mark) of every row.

    Rows are alike if their texts' sets of ``width``-word shingles have a Jaccard
    similarity of ``similarity`` or more, and a class is what likeness connects.
    ``class_id`` is its smallest doc_id, null if all are null; (class_id, kept_mark)
    names the text that stands for the class.
    """
    spark = docs.sparkSession
    rows = stage(sketches(docs, width), "similar-sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n", "wide", "anchors")).alias("x")
    distinct = stage(rows.groupBy("key").agg(least).select("key", "x.doc_id", "x.mark", "x.n", "x.wide", "x.anchors"), "similar-distinct")
    found = candidates(met_by_place(distinct)).unionByName(near_prints(distinct))
    families = components(stage(found, "similar-candidates"))
    links = stage(verified(docs, families, distinct, width, similarity), "similar-links")
    labels = components(links)
    named = stage(distinct.join(labels.withColumnRenamed("fp", "key"), "key", "left").select("key", "doc_id", "mark", F.coalesce("label", "key").alias("label")), "similar-labels")
    kept = stage(named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x")).select("label", F.col("x.doc_id").alias("class_id"), F.col("x.mark").alias("kept_mark")), "similar-kept")
    of = stage(named.join(kept, "label").select("key", "class_id", "kept_mark"), "similar-of")
    return rows.select("doc_id", "mark", "key").join(of, "key").select("doc_id", "mark", "class_id", "kept_mark")


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest doc_id."""
    spark = docs.sparkSession
    keeper = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("kept_mark"))
    with scratch(spark) as kept:
        found = classes(docs, width, similarity).groupBy("doc_id", "mark").agg(F.max(keeper).alias("keeper"), F.count("*").alias("rows"))
        kept.append(new_path(spark, "similar-out"))
        names = stage(found.where("not keeper or rows > 1"), "similar-out", kept[0])
    d = docs.select(*renamed(docs), F.xxhash64(text_bytes()).alias("_mark"), F.col("doc_id").cast("long").alias("_id"))

    def met(by: DataFrame, how: str) -> DataFrame:
        by = few(by.select("doc_id", "mark"))
        return d.join(by, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark")), how)

    rows, again = met(names, "left_anti"), names.where("keeper")
    if not again.isEmpty():  # rows that repeat whole in id and text: one of them stays
        rows = rows.unionByName(met(again, "left_semi").dropDuplicates(["_id", "_mark"]))
    return rows.drop("_id", "_mark").toDF(*docs.columns)
