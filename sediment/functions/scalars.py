"""Scalar columns over keys and values, all JVM-side except the XXH3 checksum."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType

from sediment.model import ENTRY_HEADER, KIND_BYTES, PUT, WAL_CHECKSUM_SEED, WAL_OVERHEAD


def to_key(c) -> Column:
    """UTF-8 bytes of a string column; binary passes through unchanged."""
    return F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary")


def key_size(key: Column) -> Column:
    return F.octet_length(key).cast("long")


def value_size(value: Column) -> Column:
    """Kind byte plus payload; a tombstone (null) is the kind byte alone."""
    return F.lit(KIND_BYTES).cast("long") + F.coalesce(F.octet_length(value), F.lit(0))


def memory_size(key: Column, value: Column) -> Column:
    return key_size(key) + value_size(value)


def block_entry_size(key: Column, value: Column) -> Column:
    return F.lit(ENTRY_HEADER).cast("long") + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def wal_record_size(key: Column, value: Column) -> Column:
    return F.lit(WAL_OVERHEAD).cast("long") + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def visible(kind: Column, value: Column) -> Column:
    """The value a reader sees: null for a tombstone."""
    return F.when(kind == PUT, value)


def make_key(i: Column) -> Column:
    """Zero-padded, so that byte order is numeric order."""
    return F.concat(F.lit("key-"), F.lpad(i.cast("string"), 20, "0"))


def make_value(i: Column, length: int) -> Column:
    """``value-<i>:`` then bytes ``(i + offset) % 251``, cut to ``length``."""
    head = F.encode(F.concat(F.lit("value-"), F.lpad(i.cast("string"), 20, "0"), F.lit(":")), "utf-8")
    if length <= 27:
        return F.substring(head, 1, length)
    tail = F.transform(F.sequence(F.lit(27), F.lit(length - 1)), lambda o: F.lpad(F.hex((i + o) % 251), 2, "0"))
    return F.concat(head, F.unhex(F.array_join(tail, "")))


def pseudo_random_index(op: Column, n: int) -> Column:
    """One step of a 64-bit linear congruence, reduced to ``[0, n)``; 0 when n is 0."""
    if n == 0:
        return F.lit(0).cast("long")
    # fixed values of the workload generator
    mixed = F.pmod(op.cast("decimal(20,0)") * F.lit("6364136223846793005").cast("decimal(20,0)") + F.lit("1442695040888963407").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)"))
    return F.pmod(mixed, F.lit(n).cast("decimal(20,0)")).cast("long")


def bit_words(size: Column) -> Column:
    return F.ceil(size / 64)


def segment_name(i: Column) -> Column:
    return F.concat(F.lpad(i.cast("string"), 20, "0"), F.lit(".sst"))


def id_of_name(name: Column, pattern: str) -> Column:
    """The number in a file name, null where the name doesn't match."""
    return F.regexp_extract(name, pattern, 1).try_cast("bigint")


def printable(value: Column) -> Column:
    """Bytes as text, with what isn't UTF-8 replaced."""
    return F.make_valid_utf8(value.cast("string"))


@pandas_udf(DecimalType(20, 0))
def xxh3(b: pd.Series) -> pd.Series:
    """XXH3-64 with the log's seed; Spark's own xxhash64 is another function."""
    from decimal import Decimal

    import xxhash

    return b.map(lambda x: None if x is None else Decimal(xxhash.xxh3_64_intdigest(bytes(x), seed=WAL_CHECKSUM_SEED)))
