"""The engine's byte formats: log records, sorted segments, manifests, state text.

Every integer is little-endian. Readers raise CorruptFormat on anything truncated,
trailing or unknown instead of guessing.
"""
from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import xxhash

from sediment import model as M
from sediment.model import ChecksumMismatch, CorruptBloomFilter, CorruptFormat

_REC = struct.Struct("<BQII")
_FRAME = struct.Struct("<IQ")
_ENTRY = struct.Struct("<IBI")
_FOOT = struct.Struct("<5Q")


def take(fmt: str, data: bytes, at: int) -> tuple[tuple, int]:
    """Unpacks ``fmt`` at an offset; returns the values and the next offset."""
    s = struct.Struct("<" + fmt)
    if at < 0 or at + s.size > len(data):
        raise CorruptFormat("truncated input")
    return s.unpack_from(data, at), at + s.size


def take_bytes(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise CorruptFormat("truncated input")
    return data[at:at + n], at + n


def read_record(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """A length-prefixed slice."""
    (n,), at = take("I", data, at)
    return take_bytes(data, at, n)


def checksum(payload: bytes) -> int:
    return xxhash.xxh3_64_intdigest(payload, seed=M.WAL_CHECKSUM_SEED)


def encode_wal(seq: int, kind: int, key: bytes, value: bytes | None) -> bytes:
    body = b"" if kind == M.WAL_DELETE else bytes(value or b"")
    payload = _REC.pack(kind, seq, len(key), len(body)) + key + body
    return _FRAME.pack(len(payload), checksum(payload)) + payload


def decode_wal(data: bytes, tolerate_tail: bool = False) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(seq, kind, key, value) of each record; ``tolerate_tail`` stops at a torn last one."""
    at = 0
    while at < len(data):
        try:
            (n, want), body_at = take("IQ", data, at)
            payload, nxt = take_bytes(data, body_at, n)
        except CorruptFormat:
            if tolerate_tail:
                return
            raise
        if checksum(payload) != want:
            raise ChecksumMismatch("log checksum mismatch")
        (kind, seq, kn, vn), p = take("BQII", payload, 0)
        if kind not in (M.WAL_PUT, M.WAL_DELETE):
            raise CorruptFormat("unknown log record type")
        if kind == M.WAL_DELETE and vn:
            raise CorruptFormat("a delete carries a value")
        if p + kn + vn != len(payload):
            raise CorruptFormat("log record length mismatch")
        yield seq, kind, payload[p:p + kn], None if kind == M.WAL_DELETE else payload[p + kn:]
        at = nxt


@dataclass
class Bloom:
    """The byte-format membership filter; seeds may differ, as they should."""

    size: int = M.BLOOM_BITS
    seeds: tuple[int, ...] = (1, 2, 3, 4)
    bits: bytearray = field(default_factory=bytearray)

    def __post_init__(self):
        self.bits = self.bits or bytearray(-(-self.size // 8))

    def _at(self, key: bytes):
        return [xxhash.xxh3_64_intdigest(key, seed=s) % self.size for s in self.seeds]

    def add(self, key: bytes) -> None:
        for p in self._at(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def contains(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._at(key))

    def encode(self) -> bytes:
        return struct.pack(f"<QQI{len(self.seeds)}Q", M.BLOOM_MAGIC, self.size, len(self.seeds), *self.seeds) + bytes(self.bits)

    @classmethod
    def decode(cls, data: bytes) -> Bloom:
        (magic, size, n), at = take("QQI", data, 0)
        if magic != M.BLOOM_MAGIC or not size or not n:
            raise CorruptBloomFilter("bad magic, size or hash count")
        seeds, at = take(f"{n}Q", data, at)
        if len(data) - at != -(-size // 8):
            raise CorruptBloomFilter("unexpected bitset length")
        return cls(size, seeds, bytearray(data[at:]))


def encode_block(entries: list[tuple[bytes, int, bytes | None]]) -> bytes:
    return struct.pack("<I", len(entries)) + b"".join(_ENTRY.pack(len(k), kind, len(v or b"")) + k + (v or b"") for k, kind, v in entries)


def decode_block(data: bytes) -> list[tuple[bytes, int, bytes | None]]:
    (n,), at = take("I", data, 0)
    out = []
    for _ in range(n):
        (kn, kind, vn), at = take("IBI", data, at)
        k, at = take_bytes(data, at, kn)
        v, at = take_bytes(data, at, vn)
        if kind not in (M.PUT, M.TOMBSTONE):
            raise CorruptFormat("unknown value kind")
        out.append((k, kind, v if kind == M.PUT else None))
    if at != len(data):
        raise CorruptFormat("trailing bytes")
    return out


def encode_index(entries: list[tuple[bytes, int, int]]) -> bytes:
    return struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QQ", o, n) for k, o, n in entries)


def decode_index(data: bytes) -> list[tuple[bytes, int, int]]:
    (n,), at = take("I", data, 0)
    out = []
    for _ in range(n):
        k, at = read_record(data, at)
        (o, size), at = take("QQ", data, at)
        out.append((k, o, size))
    if at != len(data):
        raise CorruptFormat("trailing bytes")
    return out


def encode_footer(index_off: int, index_len: int, bloom_off: int, bloom_len: int) -> bytes:
    return _FOOT.pack(M.SSTABLE_MAGIC, index_off, index_len, bloom_off, bloom_len)


def decode_footer(data: bytes) -> tuple[int, int, int, int]:
    if len(data) != _FOOT.size:
        raise CorruptFormat("footer length")
    magic, *rest = _FOOT.unpack(data)
    if magic != M.SSTABLE_MAGIC:
        raise CorruptFormat("footer magic")
    return tuple(rest)


def encode_sstable(entries: Iterable[tuple[bytes, int, bytes | None]], target: int = M.BLOCK_BYTES, bits: int | None = None) -> bytes:
    """A whole segment file from entries in key order; unsorted input is an error here."""
    entries = list(entries)
    if any(a[0] >= b[0] for a, b in zip(entries, entries[1:])):
        raise CorruptFormat("entries must ascend strictly by key")
    bloom = Bloom(bits or M.BLOOM_BITS)
    out, index, open_, size = bytearray(), [], [], 4

    def close():
        nonlocal open_, size
        if open_:
            block = encode_block(open_)
            index.append((open_[0][0], len(out), len(block)))
            out.extend(block)
            open_, size = [], 4

    for k, kind, v in entries:
        n = M.ENTRY_HEADER + len(k) + len(v or b"")
        if size + n > target:
            close()
        open_.append((k, kind, v))
        size += n
        bloom.add(k)
    close()
    idx, bl, at = encode_index(index), bloom.encode(), len(out)
    return bytes(out) + idx + bl + encode_footer(at, len(idx), at + len(idx), len(bl))


def open_sstable(data: bytes) -> tuple[list[tuple[bytes, int, int]], Bloom]:
    if len(data) < _FOOT.size:
        raise CorruptFormat("segment file too small")
    io, il, bo, bl = decode_footer(data[-_FOOT.size:])
    return decode_index(take_bytes(data, io, il)[0]), Bloom.decode(take_bytes(data, bo, bl)[0])


def scan_sstable(data: bytes) -> Iterator[tuple[bytes, int, bytes | None]]:
    """All entries in key order, tombstones included."""
    for _, o, n in open_sstable(data)[0]:
        yield from decode_block(take_bytes(data, o, n)[0])


def get_sstable(data: bytes, key: bytes) -> tuple[int, bytes | None] | None:
    """(kind, value) of a key, or None: sketch test, floor of the index, one block."""
    from bisect import bisect_right

    index, bloom = open_sstable(data)
    if not bloom.contains(key):
        return None
    i = bisect_right([k for k, _, _ in index], key) - 1
    if i < 0:
        return None
    found = {k: (kind, v) for k, kind, v in decode_block(take_bytes(data, *index[i][1:])[0])}
    return found.get(key)


def encode_meta(file_id: int, level: int, low: bytes, high: bytes, size: int) -> bytes:
    return struct.pack("<QII", file_id, level, len(low)) + low + struct.pack("<I", len(high)) + high + struct.pack("<Q", size)


def encode_action(action: int, file_id: int, meta: tuple | None = None) -> bytes:
    tail = encode_meta(file_id, *meta) if action == M.MANIFEST_ADD else struct.pack("<Q", file_id)
    return struct.pack("<QB", M.MANIFEST_MAGIC, action) + tail


def decode_actions(data: bytes, tolerate_tail: bool = False) -> Iterator[tuple]:
    """(action, file_id, level, smallest, largest, size) rows; removes hold nulls; ``tolerate_tail`` stops at a torn last one."""
    at = 0
    while at < len(data):
        try:
            (magic, action), at = take("QB", data, at)
            (fid,), at = take("Q", data, at)
            rest = (None,) * 4
            if magic == M.MANIFEST_MAGIC and action == M.MANIFEST_ADD:
                rest, at = decode_meta(data, at)
        except CorruptFormat:
            if tolerate_tail:
                return
            raise
        if magic != M.MANIFEST_MAGIC:
            raise CorruptFormat("manifest magic")
        if action not in (M.MANIFEST_ADD, M.MANIFEST_REMOVE):
            raise CorruptFormat("unknown manifest action")
        yield action, fid, *rest


def decode_meta(data: bytes, at: int = 0) -> tuple[tuple[int, bytes, bytes, int], int]:
    """(level, smallest, largest, size) of a segment, and where it ends."""
    (level,), at = take("I", data, at)
    low, at = read_record(data, at)
    high, at = read_record(data, at)
    (size,), at = take("Q", data, at)
    return (level, low, high, size), at


STATE_DEFAULT = {"next_sstable_id": 0, "next_wal_id": 0, "next_manifest_id": 0, "next_sequence_id": 1}


def encode_state(state: dict[str, int]) -> str:
    return "".join(f"{k}={state[k]}\n" for k in STATE_DEFAULT)


def decode_state(text: str) -> dict[str, int]:
    state = dict(STATE_DEFAULT)
    for line in text.splitlines():
        k, eq, v = line.partition("=")
        if not eq or k not in state or not (v.isascii() and v.isdigit()):
            raise CorruptFormat("bad state line")
        state[k] = int(v)
    return state
