"""Cleaning and packing a corpus: quality, toxicity, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on every document that the one before it
kept, and is written as Parquet and reread. All but the last return the columns of
``documents``, and any others that the input has.

Defined cases: null text is empty; quality and toxicity keep empty texts, as nothing in
them speaks against them, and of all empty texts one passes near_dedup; repeated rows and
ids are judged row by row before near_dedup and one stays there; a null doc_id is a value
like any other; without labels (an empty or null-only table) nothing is rejected; an
empty table passes through empty. A missing ``labels`` table is an error.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sediment.llm import packing, quality, similar, toxicity
from sediment.llm.catalogue import TOKENIZER
from sediment.llm.common import new_path, renamed, scratch, stage, table, text_bytes


#: The quality draw takes weights to the power 1 / SHARP, so that noise decides only between texts at the threshold.
SHARP = 0.02


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gumbel top-k by importance over the acceptance threshold, where k is how many the classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    weighed = quality.weigh(docs, model, [*renamed(docs), F.xxhash64(text_bytes()).alias("_mark")])
    over = F.col("log_weight") - F.lit(max(model.threshold, -1e6)) * F.col("n_features")
    over = F.when(F.col("n_features") == 0, F.lit(1e6)).otherwise(over)
    by = [f"_c{docs.columns.index('doc_id')}", "_mark"]
    kept = quality.resample(weighed, F.col("accepted"), by, log_weight=over / SHARP).where("sampled")
    return kept.select(*kept.columns[:len(docs.columns)]).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier does not find toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.score(docs, model, renamed(docs)).where("predicted = 0")
    return kept.select(*kept.columns[:len(docs.columns)]).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles alike to 0.8 or more.

    SimHash with vantage-point shards finds what is 2 bits apart, shared least shingles what is further; both are verified.
    """
    return similar.deduplicated(docs, width=5, similarity=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in full windows."""
    return packing.digests(packing.pack(docs, TOKENIZER, end_id=2, window=4096))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]

# Trained models and retrieval order have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage staged goes as soon as the stage is written."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        with scratch(spark) as kept:
            kept.append(new_path(spark, f"pipeline-{name}"))
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}", kept[0])
    return docs
