"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Files
-----
``<path>/ranks/``: one file, the ids in rank order (most frequent first; ties to the
smaller id) as little-endian unsigned 32-bit integers, then a newline byte.
``<path>/blocks/block=<20 digits>/``: one file a block, blocks and the documents in
them in ascending doc_id order (null first; repeated ids in order of their token ids):

    8 bytes  magic ``SEDTOK01``
    4 x u64  documents, tokens, data bytes, global index of the first token
    i64 x d  doc ids (0 where null)        u8 x d  1 where the doc id is not null
    u32 x d  tokens of each document
    ceil(tokens / 4) control bytes: two bits a token, its byte length less one
    data bytes: each token's rank, little-endian, 1 to 4 bytes; then a newline byte

Control bytes stand apart from the data, so a block decodes with table lookups on
whole arrays: each control byte selects four gather positions and a total length.
Frequent ids have small ranks and take one byte.

Defined cases: null text is empty text; every document ends with ``end_id``, so an
empty one has one token; a document of any length is whole in one block; an empty
table gives a ranks file and no block. Other columns of the input are ignored.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.llm.common import drop_path, new_path, stage, text_bytes, write_bytes
from sediment.llm.tokens import encoder

MAGIC = b"SEDTOK01"
#: A block closes at this many tokens; only a single longer document exceeds it.
BLOCK_TOKENS = 2_000_000
HEAD = "<8s4Q"

# length of each of a control byte's four values; their gather positions (16: a zero byte); their sum
_LEN = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)])
_SUM = _LEN.sum(1)
_TAKE = np.array([[s + b if b < n else 16 for s, n in zip(np.r_[0, row[:-1].cumsum()], row) for b in range(4)] for row in _LEN])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    size = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[:len(r)] = size
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    wide = r.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) <= size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int, step: int = 1 << 16) -> np.ndarray:
    """The n values of a block, by table lookup, ``step`` control bytes at a time."""
    c = np.frombuffer(control, np.uint8)
    if n % 4:  # the last control byte's unused slots read a zero byte each beyond the data
        data = data + b"\0" * (4 - n % 4)
    d = np.frombuffer(data + b"\0" * 17, np.uint8)
    out = np.empty(len(c) * 4, "<u4")
    at = 0
    for i in range(0, len(c), step):
        part = c[i:i + step]
        sums = _SUM[part]
        base = at + np.cumsum(sums) - sums
        take = _TAKE[part]
        got = d[base[:, None] + take]
        got[take == 16] = 0
        out[4 * i:4 * (i + len(part))] = got.reshape(-1).view("<u4") if got.flags.c_contiguous else np.ascontiguousarray(got).reshape(-1).view("<u4")
        at += int(sums.sum())
    return out[:n]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, cuts: list[int] | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens[, bucket]) of every whole text; ids little-endian, u16 or u32 by vocabulary."""
    schema = "doc_id long, ids binary, n_tokens long" + (", bucket int" if cuts is not None else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for b in batches:
            ids = [enc.encode(t.as_py()) + end for t in b.column(1)]
            cols = {"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // width for x in ids], pa.int64())}
            if cuts is not None:
                at = np.searchsorted(np.array(cuts, np.int64), b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
                cols["bucket"] = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, schema)


def quantiles(docs: DataFrame, n: int) -> list[int]:
    """n - 1 ascending cut points of doc_id that balance its rows."""
    at = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else None
    return sorted(set(at or []))


def id_counts(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in all documents: one vector a task is summed, never rows of tokens."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r["id"]] = r["n"]
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes every text and writes the files described above under ``path``."""
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    size, dtype, width = enc.tokenizer.get_vocab_size(with_added_tokens=True), enc.dtype.str, enc.dtype.itemsize
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokenize(docs, tokenizer, end_id, quantiles(docs, 3 * parts))

    def gather(batches):
        """Runs of documents, in order, as rows of about ``block_tokens`` tokens."""
        held, total, bucket, number = [], 0, None, 0

        def row():
            ids, known = [h[0] or 0 for h in held], [h[0] is not None for h in held]
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(bucket << 32) + number], pa.int64()), "docs": pa.array([len(held)], pa.int64()), "tokens": pa.array([total], pa.int64()),
                "doc_ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "known": pa.array([np.array(known, np.uint8).tobytes()], pa.binary()),
                "lengths": pa.array([np.array([len(h[1]) // width for h in held], "<u4").tobytes()], pa.binary()), "ids": pa.array([b"".join([h[1] for h in held])], pa.binary())})

        for b in batches:
            for i, x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = len(x) // width
                if held and (k != bucket or total + n > block_tokens):
                    yield row()
                    number = number + 1 if k == bucket else 0
                    held, total = [], 0
                elif not held:
                    number = 0
                bucket = k
                held.append((i, x))
                total += n
        if held:
            yield row()

    ordered = tokens.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids").select("doc_id", "ids", "bucket")
    staged = new_path(spark, "token-blocks")
    blocks = stage(ordered.mapInArrow(gather, "block long, docs long, tokens long, doc_ids binary, known binary, lengths binary, ids binary"), "token-blocks", staged)
    counts = id_counts(blocks, size, dtype)
    order = np.lexsort((np.arange(size), -counts)).astype("<u4")
    rank = np.empty(size, "<u4")
    rank[order] = np.arange(size, dtype="<u4")
    starts, total = {}, 0
    for r in blocks.select("block", "tokens").orderBy("block").collect():  # one row a block of a million tokens
        starts[r["block"]], total = total, total + r["tokens"]
    at = spark.sparkContext.broadcast((rank, starts))

    def code(batches):
        rank, starts = at.value
        for b in batches:
            for r in b.to_pylist():
                control, data = pack(rank[np.frombuffer(r["ids"], dtype)])
                head = struct.pack(HEAD, MAGIC, r["docs"], r["tokens"], len(data), starts[r["block"]])
                yield pa.RecordBatch.from_pydict({"block": [f"{r['block']:020}"], "payload": pa.array([b"".join([head, r["doc_ids"], r["known"], r["lengths"], control, data])], pa.binary())})

    write_bytes(blocks.mapInArrow(code, "block string, payload binary"), "payload", f"{path}/blocks", "block")
    write_bytes(spark.createDataFrame([(bytearray(order.tobytes()),)], "payload binary").coalesce(1), "payload", f"{path}/ranks")
    drop_path(spark, staged)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a store; ids are little-endian u32 bytes."""
    order = spark.sparkContext.broadcast(bytes(_files(spark, f"{path}/ranks").first()["content"])[:-1])

    def run(batches):
        ids_of = np.frombuffer(order.value, "<u4")
        for b in batches:
            for x in b.column(0):
                raw = x.as_buffer().to_pybytes()
                magic, n, tokens, size, start = struct.unpack_from(HEAD, raw)
                if magic != MAGIC or raw[-1:] != b"\n":
                    raise ValueError("not a token block")
                at = struct.calcsize(HEAD)
                doc_ids, at = np.frombuffer(raw, "<i8", n, at), at + 8 * n
                known, at = np.frombuffer(raw, np.uint8, n, at), at + n
                lengths, at = np.frombuffer(raw, "<u4", n, at).astype(np.int64), at + 4 * n
                quads = -(-tokens // 4)
                if at + quads + size + 1 != len(raw):
                    raise ValueError("token block of the wrong length")
                ids = ids_of[unpack(raw[at:at + quads], raw[at + quads:-1], tokens)]
                ends = np.cumsum(lengths)
                begins, view = ends - lengths, memoryview(ids).cast("B")
                for i in range(0, n, 4096):
                    some = slice(i, i + 4096)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids[some], pa.int64(), mask=known[some] == 0), "start": pa.array(begins[some] + start, pa.int64()),
                        "ids": pa.array([view[4 * s:4 * e] for s, e in zip(begins[some].tolist(), ends[some].tolist())], pa.binary())})

    return _files(spark, f"{path}/blocks").mapInArrow(run, "doc_id long, start long, ids binary")


def digests(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store that was read back, computed by the JVM."""
    return store.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
