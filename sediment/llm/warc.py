"""WARC archives: records cut into segments on writing, reassembled on reading.

Writing puts one record a row: ``response`` with the payload in chunked transfer
framing, or ``revisit`` without it. A record whose block exceeds ``segment_bytes`` is
cut: the first segment keeps the record's type, the others are ``continuation``
records that name it in WARC-Segment-Origin-ID, and the last gives
WARC-Segment-Total-Length. Each record is a gzip member of its own. A member ends
with its length's top byte, which is zero below 16 MiB, and segments are far below
that: that zero byte is what the byte sink puts after each row.

Reading takes records in any order and file: continuations meet by origin id, are
ordered by segment number, must be complete and have the stated total length, and
then the transfer framing is decoded and the payload held against its digest.

Defined cases: null html is an empty payload, a null url an ``urn:``; a null page id
stays null. Rows that share the largest page id of equal payloads are all responses.
Rows that repeat both page id and payload share a record id and are read back as many
times. An empty table gives no record. Damaged records are returned with ``error``
set and no payload. Other columns of the input are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.llm.common import _Shuffles, new_path, stage, text_bytes

SEGMENT_BYTES = 24 * 1024
CHUNK_BYTES = 4096
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, origin_id string, segment int, total_length long, target_uri string, refers_to string, payload_digest string, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """Payload of chunked framing; chunk extensions and trailers are skipped, damage raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            raise ValueError("bad chunk size")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("truncated chunk")
        out.append(body[at:at + n])
        at += n + 2


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = z.compress(head.encode("utf-8")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
    if whole[-1]:
        raise ValueError("a segment of 16 MiB or more")
    return whole[:-1]


def records(record_id: str, kind: str, uri: str, digest: str, payload: bytes, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES):
    """The gzip members, each without its last zero byte, of one record."""
    base = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if kind == "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        base += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    base.append(("Content-Type", "application/http; msgtype=response"))
    cuts = range(0, max(1, len(block)), segment_bytes)
    if len(cuts) == 1:
        yield _member([("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *base], block)
        return
    for i, at in enumerate(cuts, 1):
        head = [("WARC-Type", kind if i == 1 else "continuation"), ("WARC-Record-ID", f"<{record_id}{'' if i == 1 else f':{i}'}>"), ("WARC-Segment-Number", str(i))]
        if i > 1:
            head.append(("WARC-Segment-Origin-ID", f"<{record_id}>"))
        if i == len(cuts):
            head.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _member([*head, *(base if i == 1 else [])], block[at:at + segment_bytes])


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds sha1 and ``response_id``: the page whose response holds this payload, null for a payload of one's own.

    Only digests and ids are grouped, combined map-side. The groups are staged, so
    that the join below them reads two plain shuffles, which Spark splits at a hot digest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("check", F.xxhash64("payload"))
    groups = (p.where(F.octet_length("payload") >= least).groupBy("sha1", "check").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
              .where("n > 1").select("sha1", "check", "response_id", F.lit(True).alias("shared")))
    return p.join(stage(groups, "warc-groups"), ["sha1", "check"], "left")


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes (page_id, url, html) rows as gzipped WARC files under ``path``."""
    def run(batches):
        for b in batches:
            out, held = [], 0
            for r in b.to_pylist():
                pid, sha = "null" if r["page_id"] is None else r["page_id"], r["sha1"]
                name = lambda i: f"urn:x-page:{i}:{sha}"
                revisit = r["shared"] and r["page_id"] != r["response_id"]
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"] or "") or f"urn:x-page:{pid}"
                for m in records(name(pid), "revisit" if revisit else "response", uri, sha, r["payload"], name(r["response_id"]) if revisit else None, segment_bytes):
                    out.append(m)
                    held += len(m)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})
                    out, held = [], 0
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    rows = with_roles(pages).select("page_id", "url", "payload", "sha1", "response_id", "shared").mapInArrow(run, "member binary")
    with _Shuffles(pages.sparkSession):
        rows.select(F.col("member").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").option("compression", "none").text(path)


def members(data: bytes, step: int = 1 << 16):
    """Each gzip member of a file, decompressed."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            part = view[at:at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        if not z.eof:
            raise ValueError("truncated gzip member")
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    end = record.find(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(head["content-length"])
    if len(record) != end + 4 + n + 4:
        raise ValueError("record of the wrong length")
    return head, record[end + 4:end + 4 + n]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it stands in the files, segments apart."""
    def run(batches):
        bare = lambda x: x and x.strip("<>")
        names = [c.split()[0] for c in RECORD.split(", ")]
        schema = pa.schema([(n, t) for n, t in zip(names, [pa.string()] * 3 + [pa.int32(), pa.int64()] + [pa.string()] * 3 + [pa.binary()])])
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for raw in members(content.as_buffer().to_pybytes()):
                    h, block = parse(raw)
                    rows.append((bare(h.get("warc-record-id")), h.get("warc-type"), bare(h.get("warc-segment-origin-id")), int(h["warc-segment-number"]) if "warc-segment-number" in h else None,
                                 int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, h.get("warc-target-uri"), bare(h.get("warc-refers-to")), h.get("warc-payload-digest"), block))
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """(record_id, type, target_uri, refers_to, payload_digest, blocks, error): a record's segments in order."""
    plain = found.where(F.col("segment").isNull()).select("record_id", "type", "target_uri", "refers_to", "payload_digest", F.array("block").alias("blocks"), F.lit(None).cast("string").alias("error"))
    cut = found.where(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin_id", "record_id"))
    heads = F.col("segment") == 1
    part = F.struct("segment", "total_length", "block")
    whole = cut.groupBy("origin").agg(
        F.array_sort(F.collect_set(part)).alias("parts"), F.sum(heads.cast("int")).alias("copies"),
        *[F.max(F.when(heads, F.col(c))).alias(c) for c in ("type", "target_uri", "refers_to", "payload_digest")])
    n = F.size("parts")
    numbers = F.transform("parts", lambda p: p["segment"])
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    error = (F.when(F.coalesce("copies", F.lit(0)) < 1, "no first segment").when(numbers != F.sequence(F.lit(1), n), "missing or repeated segment")
             .when(F.element_at("parts", -1)["total_length"].isNull(), "no total length").when(F.element_at("parts", -1)["total_length"] != size, "wrong total length"))
    blocks = F.transform("parts", lambda p: p["block"])
    joined = whole.select(F.col("origin").alias("record_id"), "type", "target_uri", "refers_to", "payload_digest", F.when(error.isNull(), blocks).alias("blocks"), error.alias("error"),
                          F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy")).drop("copy")
    return plain.unionByName(joined)


def payloads(whole: DataFrame) -> DataFrame:
    """What the HTTP message holds: payload (null for a revisit), its bytes and hex sha1; damage sets ``error``."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                payload = size = digest = None
                error = r["error"]
                if error is None:
                    head, _, body = b"".join(r["blocks"]).partition(b"\r\n\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    try:
                        digest = base64.b32decode(r["payload_digest"].removeprefix("sha1:")).hex()
                        if r["type"] == "revisit":
                            size = int(fields[b"content-length"])
                        else:
                            payload = dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                            size = len(payload)
                            if digest != hashlib.sha1(payload).hexdigest():
                                raise ValueError("payload digest differs")
                    except (ValueError, KeyError, AttributeError) as e:
                        payload, size, digest, error = None, None, None, f"damaged: {e}"
                out.append((r["record_id"], r["type"], r["target_uri"], r["refers_to"], digest, payload, size, error))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["record_id", "type", "target_uri", "refers_to", "payload_digest", "payload", "payload_bytes", "error"])

    return whole.mapInArrow(run, "record_id string, type string, target_uri string, refers_to string, payload_digest string, payload binary, payload_bytes long, error string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of the files under ``path``, with decoded payloads."""
    return payloads(reassemble(read_records(spark, path)))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    r = read_warc(spark, path)
    page = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(3)).try_cast("long")
    return r.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "error")
