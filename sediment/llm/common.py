"""What the operators share: the cluster's shared folder, staged tables, documents."""
from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sediment.session import ship

#: ASCII white space; every other byte belongs to a word.
SPACE = "\x20\t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and runs in this process (tests) a temporary one is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sediment-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hands whole texts to Python in smaller Arrow batches than the default, for bounded memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


#: Folders made by this process; results read them lazily, so they stay until ``release``.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Deletes every staged folder, once the results that read them are no longer needed."""
    while _made:
        drop_path(spark, _made.pop())


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the folders that are staged inside as it ends, but for the paths put in the list that it gives."""
    kept, before = [], len(_made)
    yield kept
    made = _made[before:]
    _made[before:] = [p for p in made if p in kept]
    for p in made:
        if p not in kept:
            drop_path(spark, p)


class _Shuffles:
    """While a staged table is written, drops its shuffle files as soon as it is complete."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.conf, self.old = spark.conf, spark.conf.get(self.KEY, "false")

    def __enter__(self):
        self.conf.set(self.KEY, "true")

    def __exit__(self, *_):
        self.conf.set(self.KEY, self.old)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a DataFrame as Parquet in the shared folder and reads it back.

    Cuts lineage: a lost executor costs no more than the stage that ran on it.
    """
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    with _Shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(df: DataFrame, column: str, path: str, *by: str) -> None:
    """Writes each row's bytes, then one newline byte, through Spark's committed text sink.

    A binary column cast to string keeps its bytes, so files are raw bytes on any store.
    """
    rows = df.select(F.col(column).cast("string").alias("value"), *by)
    writer = rows.write.mode("overwrite").option("lineSep", "\n").option("compression", "none")
    with _Shuffles(df.sparkSession):
        (writer.partitionBy(*by) if by else writer).text(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(ship(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(c: Column | str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("binary"), F.lit(b""))


def renamed(docs: DataFrame) -> list[Column]:
    """All columns under names that no operator uses; ``toDF(*docs.columns)`` undoes it."""
    return [docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(docs.columns)]


def with_text(docs: DataFrame, columns: list[Column]) -> tuple[DataFrame, str]:
    """The columns and, last, the text as bytes; and the columns' part of a schema string."""
    plan = docs.select(*columns, text_bytes().alias("_text"))
    return plan, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plan.schema.fields[:-1])


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (a null id: of the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


#: What operators keep in a process between tasks: what drops it, by operator.
_kept: dict[str, Callable[[], None]] = {}
_user: str | None = None


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Says how to drop what an operator keeps between tasks; ``use`` calls it."""
    _kept[operator] = drop


def use(operator: str) -> None:
    """Called as an operator's task begins: drops what others left in this process, so that a worker holds no more than one operator's."""
    global _user
    if _user == operator:
        return
    _user = operator
    for name, drop in _kept.items():
        if name != operator:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc keeps freed memory until it is asked
        ctypes.CDLL("libc.so.6").malloc_trim(0)
