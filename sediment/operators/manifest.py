"""The action log of live segments."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sediment.model import MANIFEST_ADD
from sediment.operators.changelog import number_rows
from sediment.sources.staging import folder

FIELDS = ["level", "smallest_key", "largest_key", "file_size"]


def live(actions: DataFrame) -> DataFrame:
    """Segments whose last action is an add; removing an unknown id changes nothing."""
    fields = [c for c in actions.columns if c not in ("manifest_id", "ord", "action", "file_id")]
    last = actions.groupBy("file_id").agg(F.max_by(F.struct("action", *fields), F.struct("manifest_id", "ord")).alias("a"))
    return last.select("file_id", "a.*").where(F.col("action") == MANIFEST_ADD).drop("action")


def next_file_id(actions: DataFrame) -> DataFrame:
    """Greatest live id plus one, or 0."""
    return live(actions).agg(F.coalesce(F.max("file_id") + 1, F.lit(0)).cast("long").alias("next_sstable_id"))


def next_manifest_id(actions: DataFrame) -> DataFrame:
    return actions.agg(F.coalesce(F.max("manifest_id") + 1, F.lit(0)).cast("long").alias("next_manifest_id"))


def compact(actions: DataFrame) -> DataFrame:
    """The live set re-emitted as adds of one new manifest, in id order, numbered by range partitions."""
    newest = actions.agg(F.coalesce(F.max("manifest_id") + 1, F.lit(0)).cast("long").alias("manifest_id"))
    kept = live(actions)
    rest = [c for c in kept.columns if c != "file_id"]
    ranked = number_rows(kept, ["file_id"], 0, folder(actions.sparkSession, "manifest"))
    return ranked.join(F.broadcast(newest), F.lit(True)).select("manifest_id", F.col("seq").cast("long").alias("ord"), F.lit(MANIFEST_ADD).alias("action"), "file_id", *rest)
