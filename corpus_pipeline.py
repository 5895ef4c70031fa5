"""A corpus pipeline: each stage's rows are written and read again as the next one's documents.

The stages, in order: documents that the quality classifier rejects go; of equal texts one stays; of
near copies one stays; the rest is mixed to its sources' target weights; the mix is packed into sequences.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from gridloom.llm.store import materialise

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores by a model of all labelled documents; keeps those at or above the threshold.

    Null and empty texts are scored like others; repeated rows are scored each; without labels of both classes every score is the share of label 1.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, F.lit(True))
    return quality.with_score(docs, model, score_col="__score").where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id, null last; of rows alike in all of these one. A null text is empty."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, at 0.8 of their five-word shingles, the smallest id stays. Texts without words are copies of one another; rows without an id all stay."""
    return simhash_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are taken; texts without words never. Of rows that repeat, one is taken as often as all of them are."""
    return mixing.take_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null or empty text is one piece, the end id; repeated rows are packed each."""
    return packing.pack_documents(docs, packing.default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the stages; tests hold their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
