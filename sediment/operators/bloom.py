"""Membership sketches: false positives, never false negatives.

Every probe is tested against every segment's sketch. Sketches are sliced by bit: row i
holds bit i of 64 segments in a word, so that a probe's rows, and-ed, say at once which
segments let it through. Tiles of segments and probes are independent of each other, and
a task holds one tile of bounded size.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from sediment.session import ship
from sediment.sources.staging import staged

#: Of a tile: bits of its sketches, probes; and how many groups of probes there are if each has LEAST.
TILE_BITS, TILE_PROBES, GROUPS, LEAST = 1 << 25, 1 << 17, 24, 4096
#: Segments and probes that are tested together: a matrix that stays in a core's cache.
STRIP, CHUNK = 4096, 2048
_SKETCH, _PROBE, _ENTRY = 0, 1, 2


def hashed(key: Column, hashes: int, mask: int = -1) -> Column:
    """A key's hashes under independent seeds; a sketch of 2**k bits takes the last k of each."""
    kind = "int" if 0 <= mask < 1 << 31 else "long"
    return F.array(*[F.xxhash64(F.lit(s), key).bitwiseAND(F.lit(mask).cast("long")).cast(kind) for s in range(hashes)])


def sized_bits(distinct: int, rate: float = 0.01) -> int:
    """Bits for a false-positive rate, so that the sketch follows the segment's size."""
    return max(64, math.ceil(-max(1, distinct) * math.log(rate) / math.log(2) ** 2))


def build(entries: DataFrame, rate: float = 0.01, hashes: int = 7, by: str = "seg") -> DataFrame:
    """(seg, bits, sketch): each segment's bits, whose number is the power of two that its entries ask for."""
    per_entry = -math.log(rate) / math.log(2) ** 2
    sizes = entries.groupBy(by).agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(64.0), F.count("*") * per_entry)))).cast("long").alias("bits"))
    ship(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held = None  # the open segment and its bytes
        for b in batches:
            if not b.num_rows:
                continue
            new = np.diff(b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), prepend=-1) != 0
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            names, bits = b.column(0).take(pa.array(first)).to_pylist(), b.column(1).to_numpy()[first]
            at = np.concatenate([[0], np.cumsum(bits)])
            spots = (b.column(2).flatten().to_numpy().reshape(-1, hashes) & (bits[of] - 1)[:, None]) + at[of][:, None]
            packed = np.zeros(at[-1] >> 3, np.uint8)
            np.bitwise_or.at(packed, (spots >> 3).ravel(), np.left_shift(1, spots & 7).astype(np.uint8).ravel())
            maps = [packed[low >> 3:high >> 3] for low, high in zip(at, at[1:])]
            if held is not None and names[0] == now:
                maps[0] |= held
            elif held is not None:
                names, maps = [now, *names], [held, *maps]
            now, held = names[-1], maps[-1].copy()
            if len(names) > 1:
                yield record(names[:-1], maps[:-1])
        if held is not None:
            yield record([now], [held])

    def record(names, maps):
        return pa.RecordBatch.from_pydict({by: pa.array(names, kind), "bits": pa.array([8 * len(m) for m in maps], pa.int64()), "sketch": pa.array([m.tobytes() for m in maps], pa.binary())})

    kind = _arrow(entries, by)
    rows = entries.select(by, "key").join(sizes, by).repartition(by).sortWithinPartitions(by).select(by, "bits", hashed(F.col("key"), hashes))
    return staged(rows.mapInArrow(run, f"{by} {entries.schema[by].dataType.simpleString()}, bits long, sketch binary"), "sketches")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def sliced(maps: np.ndarray) -> np.ndarray:
    """Row i: bit i of every sketch, as words; ``maps`` has a row of bytes for each sketch."""
    n, wide = maps.shape
    padded = -(-n // 64) * 64 if n > 8 else 8
    maps = np.concatenate([maps, np.zeros((padded - n, wide), np.uint8)])
    out = np.empty((8 * wide, padded // 8), np.uint8)
    step = max(1, (1 << 22) // padded // 8)
    for c in range(0, wide, step):
        out[8 * c:8 * (c + step)] = np.packbits(np.unpackbits(maps[:, c:c + step], axis=1, bitorder="little"), axis=0, bitorder="little").T
    return out.view(np.uint64) if padded > 8 else out


def let_through(slices: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each probe, with the bits of the segments that have all its positions."""
    got = slices[at[:, 0]]
    other = np.empty_like(got)
    for j in range(1, at.shape[1]):
        np.take(slices, at[:, j], axis=0, out=other, mode="clip")
        got &= other
    return got


def column_counts(got: np.ndarray) -> np.ndarray:
    """How many rows have each bit: numbers of one bit a row are added in halves, a plane for each binary digit."""
    planes = [got]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.concatenate([p, np.zeros_like(p[:1])]) for p in planes]
        half, carry, out = len(planes[0]) // 2, None, []
        for p in planes:
            a, b = p[:half], p[half:]
            x = a ^ b
            out.append(x if carry is None else x ^ carry)
            carry = a & b if carry is None else (a & b) | (x & carry)
        planes = [*out, carry]
    return sum(np.unpackbits(np.ascontiguousarray(p[0]).view(np.uint8), bitorder="little").astype(np.int64) << k for k, p in enumerate(planes))


class Tile:
    """Some segments' sketches, some probes, and those entries that are of both."""

    def __init__(self, rows: pa.Table, by: str):
        what = rows["what"].to_numpy()
        sketches, probes, self.entries = (rows.filter(pa.array(what == w)) for w in (_SKETCH, _PROBE, _ENTRY))
        self.keys, self.times, self.n = probes["key"].combine_chunks(), probes["times"].to_numpy(), probes.num_rows
        at = probes["at"].combine_chunks()
        self._at = at.flatten().to_numpy().reshape(self.n, -1) if self.n else np.zeros((0, 1), np.int64)
        bits = sketches["bits"].to_numpy()
        order = np.argsort(bits, kind="stable")
        sketches = sketches.take(pa.array(order))
        self.bits, self.segs, self._maps = bits[order], sketches[by].combine_chunks(), sketches["sketch"]
        find = lambda name, among: pc.fill_null(pc.index_in(self.entries[name], value_set=among), -1).to_numpy()
        self.seg_of, self.probe_of = find(by, self.segs), find("key", self.keys)

    def tests(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first segment, segments, first probe, bits) of all segments by all probes."""
        edges = [0, *(np.flatnonzero(np.diff(self.bits)) + 1), len(self.bits)] if len(self.bits) else []
        for low, high in zip(edges, edges[1:]):
            bits = int(self.bits[low])
            step = max(8, min(STRIP, TILE_BITS // bits))
            for s in range(low, high, step):
                n = min(step, high - s)
                slices = sliced(np.frombuffer(b"".join(self._maps.slice(s, n).to_pylist()), np.uint8).reshape(n, bits // 8))
                for p in range(0, self.n, CHUNK):
                    yield s, n, p, let_through(slices, self._at[p:p + CHUNK] & (bits - 1))

    def found(self) -> Callable[[int, int, int, np.ndarray], np.ndarray]:
        """A function of what ``tests`` yields: which entries are among the pairs that were let through."""
        known = np.flatnonzero((self.seg_of >= 0) & (self.probe_of >= 0))
        known = known[np.argsort(self.seg_of[known], kind="stable")]
        segs = self.seg_of[known]
        last: list = [None, None, None]

        def of(s, n, p, got):
            if last[0] != s:  # a strip's entries, by probe
                here = known[np.searchsorted(segs, s):np.searchsorted(segs, s + n)]
                here = here[np.argsort(self.probe_of[here], kind="stable")]
                last[:] = s, here, self.probe_of[here]
            here = last[1][np.searchsorted(last[2], p):np.searchsorted(last[2], p + len(got))]
            column = self.seg_of[here] - s
            return here[(got.view(np.uint8)[self.probe_of[here] - p, column >> 3] >> (column & 7) & 1).astype(bool)]
        return of


def _by_tile(sketch: DataFrame, probes: DataFrame, entries: DataFrame | None, hashes: int, by: str, run, schema: str | StructType, whole: bool = False) -> DataFrame:
    """``run`` on every tile: record batches of ``schema``; ``whole``: with the entries' rows."""
    asked = staged(probes.groupBy("key").agg(F.count("*").cast("long").alias("times")), "probes")
    total = sketch.agg(F.sum("bits").alias("all"), F.max("bits").alias("most")).first()
    n = asked.count()
    blocks, groups = max(1, -(-(total["all"] or 0) // TILE_BITS)), max(1, -(-n // TILE_PROBES), min(GROUPS, -(-n // LEAST)))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(by)), F.lit(blocks))
    group = F.pmod(F.xxhash64(F.lit("group"), F.col("key")), F.lit(groups))
    key, seg = probes.schema["key"].dataType.simpleString(), sketch.schema[by].dataType.simpleString()
    wanted = {"tile": "long", "what": "int", by: seg, "bits": "long", "sketch": "binary", "key": key, "times": "long", "at": None, "row": entries.select(F.struct(*entries.columns)).schema[0].dataType if whole else None}

    mask = (total["most"] or 64) - 1
    wanted["at"] = "array<int>" if mask < 1 << 31 else "array<long>"
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))

    def shaped(df: DataFrame, what: int) -> DataFrame:
        return df.select(*[F.lit(what).alias(c) if c == "what" else (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items() if t is not None])

    rows = shaped(sketch.withColumn("_g", every(groups)).withColumn("tile", block * groups + F.col("_g")), _SKETCH).unionByName(
        shaped(asked.withColumn("at", hashed(F.col("key"), hashes, mask)).withColumn("_b", every(blocks)).withColumn("tile", F.col("_b") * groups + group), _PROBE))
    if entries is not None:
        rows = rows.unionByName(shaped(entries.select(by, "key", *[F.struct(*entries.columns).alias("row")] * whole, (block * groups + group).alias("tile")), _ENTRY))
    ship(sketch.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            tiles = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tiles)) + 1), len(tiles)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if held and tiles[low] != now:
                    yield from run(Tile(pa.Table.from_batches(held), by))
                    held = []
                now = tiles[low]
                held.append(b.slice(low, high - low))
        if held:
            yield from run(Tile(pa.Table.from_batches(held), by))

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(over, schema)


def passing(sketch: DataFrame, probes: DataFrame, hashes: int = 7, by: str = "seg") -> DataFrame:
    """(seg, key) of distinct probe keys whose every bit a segment's sketch has."""
    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        for s, n, p, got in tile.tests():
            row, column = np.nonzero(np.unpackbits(got.view(np.uint8), axis=1, bitorder="little"))
            if len(row):
                yield pa.RecordBatch.from_arrays([tile.segs.take(pa.array(column + s)), tile.keys.take(pa.array(row + p))], [by, "key"])

    return _by_tile(sketch, probes, None, hashes, by, run, StructType([sketch.schema[by], probes.schema["key"]]))


def tally(entries: DataFrame, sketch: DataFrame, probes: DataFrame, hashes: int = 7, by: str = "seg") -> DataFrame:
    """(seg, held, found, passed): a segment's entries, those let through, and all distinct probe keys let through.

    What is let through is counted where it is tested, not written out pair by pair.
    """
    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        n = len(tile.segs)
        passed, found, of = np.zeros(n, np.int64), np.zeros(n, np.int64), tile.found()
        for s, k, p, got in tile.tests():
            passed[s:s + k] += column_counts(got)[:k]
            np.add.at(found, tile.seg_of[of(s, k, p, got)], 1)
        held = np.bincount(tile.seg_of[tile.seg_of >= 0], minlength=n)
        yield pa.RecordBatch.from_arrays([tile.segs, *map(pa.array, (held, found, passed))], [by, "held", "found", "passed"])

    parts = _by_tile(sketch, probes, entries.select(by, "key"), hashes, by, run, f"{by} {sketch.schema[by].dataType.simpleString()}, held long, found long, passed long")
    return parts.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("held", "found", "passed")])


def filtered_get(entries: DataFrame, sketch: DataFrame, probes: DataFrame, hashes: int = 7, by: str = "seg") -> DataFrame:
    """Probes that a segment's sketch lets through, then looked up exactly among its entries."""
    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        of, rows = tile.found(), tile.entries["row"].combine_chunks()
        for test in tile.tests():
            at = of(*test)
            if len(at):
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(np.repeat(at, tile.times[tile.probe_of[at]])))], ["row"])

    entries, probes = entries.where("key is not null"), probes.select("key").where("key is not null")
    schema = entries.select(F.struct(*entries.columns).alias("row")).schema
    return _by_tile(sketch, probes, entries, hashes, by, run, schema, whole=True).select("row.key", f"row.{by}", *[f"row.{c}" for c in entries.columns if c not in ("key", by)])
