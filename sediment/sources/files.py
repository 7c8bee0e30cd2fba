"""Byte-format files as DataFrames, and small files on any store that Spark reaches."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.session import ship
from sediment.sources import codec
from sediment.sources.staging import folder as shared


def _decoded(spark: SparkSession, path: str, glob: str, rows, schema: str) -> DataFrame:
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(rows(name, bytes(content))), columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def read_wal(spark: SparkSession, path: str, tolerate_tail: bool = False) -> DataFrame:
    """(wal_id, pos, seq, kind, key, value) of every log file; ids compare as numbers."""
    def rows(name, data):
        wal = int(name.rsplit("wal_", 1)[1].split(".")[0])
        for i, r in enumerate(codec.decode_wal(data, tolerate_tail)):
            yield wal, i, *r
    return _decoded(spark, path, "wal_[0-9]*.log", rows, "wal_id long, pos long, seq long, kind int, key binary, value binary")


def read_sstables(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, key, kind, value) of every sorted segment file."""
    def rows(name, data):
        fid = int(name.rsplit("/", 1)[1].split(".")[0])
        for r in codec.scan_sstable(data):
            yield fid, *r
    return _decoded(spark, path, "*.sst", rows, "file_id long, key binary, kind int, value binary")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    def rows(name, data):
        mid = int(name.rsplit("/", 1)[1].split(".")[0])
        for i, r in enumerate(codec.decode_actions(data)):
            yield mid, i, *r
    return _decoded(spark, path, "*.manifest", rows, "manifest_id long, ord long, action int, file_id long, level long, smallest_key binary, largest_key binary, file_size long")


class Log:
    """An appending file: what ``append`` returned for is on disk."""

    def __init__(self, files: "Files", name: str):
        self.name, self._out = name, files._fs.create(files.path(name), True)

    def append(self, data: bytes) -> None:
        self._out.write(bytearray(data))
        self._out.hsync()

    def close(self) -> None:
        self._out.close()


class Files:
    """Whole small files and appended logs through Hadoop's FileSystem, for driver-side state.

    Logs need a store whose streams sync (HDFS, local disks). Local files bypass Hadoop's
    checksum files, which can't be replaced together with what they describe.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm, self.root = spark, spark._jvm, root.rstrip("/")
        fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = fs.getUri().getScheme() == "file"
        self._fs = fs.getRawFileSystem() if self._local else fs

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _bytes(self, name: str) -> bytes | None:
        if not self._fs.exists(self.path(name)):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read(self, name: str) -> bytes | None:
        return self._bytes(name)

    def read_section(self, name: str, offset: int, length: int) -> bytes:
        """Part of a file, and no more than that is read."""
        stream = self._fs.open(self.path(name))
        try:
            stream.seek(offset)
            part = self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)
            out = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(part))
        finally:
            stream.close()
        if len(out) != length:
            raise codec.M.CorruptFormat(f"{name} ends before {offset + length}")
        return out

    def log(self, name: str) -> Log:
        """A new, empty appending file."""
        return Log(self, name)

    def truncate(self, name: str) -> None:
        """Empties a file."""
        self._fs.create(self.path(name), True).close()

    def write(self, name: str, data: bytes) -> None:
        """Replaces a file: written beside it, then renamed over it in one step, so a reader sees the old or the new."""
        tmp = Log(self, name + ".tmp")
        try:
            tmp.append(data)
        finally:
            tmp.close()
        self._replace(name + ".tmp", name)

    def _replace(self, old: str, new: str) -> None:
        if self._local:  # rename(2) replaces
            if not self._fs.rename(self.path(old), self.path(new)):
                raise OSError(f"can't rename {old} to {new}")
            return
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._spark._jsc.hadoopConfiguration())
        how = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.path(old), self.path(new), how)

    def adopt(self, folder: str, name: Callable[[str], str]) -> None:
        """Moves the part files that Spark wrote below a folder to the names that their paths have."""
        def move(old: str) -> None:
            new = name(old)
            if (parent := new.rpartition("/")[0]) not in made:
                self._fs.mkdirs(self.path(parent))
                made.add(parent)
            self._replace(old, new)

        found, made = [], set()
        if self._fs.exists(self.path(folder)):
            below = self._fs.listFiles(self.path(folder), True)
            while below.hasNext():
                old = below.next().getPath().toString()
                if old.rpartition("/")[2].startswith("part-"):
                    found.append(folder + old.rpartition(f"/{folder}")[2])
        with ThreadPoolExecutor(8) as pool:
            for _ in pool.map(move, found):
                pass

    def list(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def size(self, folder: str) -> int:
        return self._fs.getContentSummary(self.path(folder)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


def _write_each(rows: DataFrame, by: str, encode, files: Files, name) -> None:
    """Writes one file for each value of ``by``: encoded and written by the executors, renamed by the driver, which sees names alone.

    Spark's text sink, which writes on any store, ends each row by a separator. A file's
    last byte serves as its separator, so there is one write for each last byte that
    occurs, at most 256. Files appear whole, by a rename, and aren't synced as a log's
    appends are.
    """
    spark = ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        content = encode(pdf)
        return pd.DataFrame({"id": [pdf[by].iloc[0]], "content": [content[:-1]], "last": [content[-1]]})

    encoded, tmp = Files(spark, shared(spark, "encoded")), f".writing-{uuid.uuid4().hex}"
    try:
        rows.groupBy(by).applyInPandas(run, "id long, content binary, last int").write.partitionBy("last").parquet(encoded.root)
        made = spark.read.schema("id long, content binary, last int").parquet(encoded.root)
        for (last,) in made.select("last").distinct().collect():  # at most 256
            lines = made.where(F.col("last") == last).select("id", F.col("content").cast("string").alias("value"))
            lines.write.option("encoding", "ISO-8859-1").option("lineSep", chr(last)).option("compression", "none").partitionBy("id").text(f"{files.root}/{tmp}/{last}")
        files.adopt(tmp, lambda path: name(int(path.split("/")[-2].removeprefix("id="))))
    finally:
        encoded.delete("")
        files.delete(tmp)


def _raw(x) -> bytes | None:
    return None if x is None else x.encode() if isinstance(x, str) else bytes(x)


def write_sstables(entries: DataFrame, files: Files, folder: str = "", target: int = codec.M.BLOCK_BYTES) -> None:
    """Writes (file_id, key, kind, value) rows as sorted segment files in the byte format.

    A segment is encoded whole by one task, as the format is one file a segment; segments
    are memtable-sized.
    """
    def encode(pdf):
        return codec.encode_sstable(sorted((_raw(k), int(kind), _raw(v)) for k, kind, v in zip(pdf["key"], pdf["kind"], pdf["value"])), target)

    _write_each(entries, "file_id", encode, files, lambda i: f"{folder}/{i:020}.sst".lstrip("/"))


def write_wals(log: DataFrame, files: Files, folder: str = "") -> None:
    """Writes (seg, seq, kind, key, value) rows as log files in the byte format, by sequence number."""
    def encode(pdf):
        pdf = pdf.sort_values("seq")
        return b"".join(codec.encode_wal(int(seq), int(kind), _raw(k), _raw(v)) for seq, kind, k, v in zip(pdf["seq"], pdf["kind"], pdf["key"], pdf["value"]))

    _write_each(log, "seg", encode, files, lambda i: f"{folder}/wal_{i}.log".lstrip("/"))


def write_manifests(actions: DataFrame, files: Files, folder: str = "") -> None:
    """Writes (manifest_id, ord, action, file_id, level, smallest_key, largest_key, file_size) rows as manifest files, in order."""
    def encode(pdf):
        pdf = pdf.sort_values("ord")
        add = codec.M.MANIFEST_ADD
        return b"".join(codec.encode_action(int(a), int(f), (int(level), _raw(low), _raw(high), int(size)) if a == add else None)
                        for a, f, level, low, high, size in zip(*(pdf[c] for c in ("action", "file_id", "level", "smallest_key", "largest_key", "file_size"))))

    _write_each(actions, "manifest_id", encode, files, lambda i: f"{folder}/{i:020}.manifest".lstrip("/"))
