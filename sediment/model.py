"""Schemas, constants and errors shared by every layer of the engine.

A stored version is one row ``(seg, seq, kind, key, value)``: ``seg`` is the log
segment it was written to, ``seq`` its global write order, ``kind`` says put or
tombstone, and ``value`` is null exactly for tombstones (an empty value is a put).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the on-disk formats.
PUT, TOMBSTONE = 1, 2
WAL_PUT, WAL_DELETE = 1, 2
MANIFEST_ADD, MANIFEST_REMOVE = 1, 2
BLOOM_MAGIC = 13_794_972_908_406_357_291
SSTABLE_MAGIC = 16_526_283_467_865_491_390
MANIFEST_MAGIC = 6_682_300_802_753_684_889
WAL_CHECKSUM_SEED = 0xD6E8FEB86659FD93
BLOCK_BYTES = 4096
ENTRY_HEADER = 9
WAL_OVERHEAD = 29
KIND_BYTES = 1
BLOOM_BITS, BLOOM_HASHES = 256, 4

CHANGELOG = T.StructType([
    T.StructField("seg", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.IntegerType()),
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
ENTRY = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.BinaryType())])
META = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("level", T.LongType()), T.StructField("smallest_key", T.BinaryType()),
    T.StructField("largest_key", T.BinaryType()), T.StructField("file_size", T.LongType())])
ACTION = T.StructType([T.StructField("manifest_id", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("action", T.IntegerType())] + META.fields)


@dataclass(frozen=True)
class EngineConfig:
    """Where a store lives and when it rotates (bytes) and flushes (queued segments)."""

    data_dir: str
    memtable_threshold: int = 4096
    maximum_memtables: int = 4


class EngineError(Exception):
    """Base of the engine's errors."""


class CorruptFormat(EngineError):
    """Bytes that don't follow the format."""


class CorruptBloomFilter(CorruptFormat):
    """A membership sketch that doesn't follow the format."""


class ChecksumMismatch(CorruptFormat):
    """A log record whose checksum doesn't match its bytes."""
