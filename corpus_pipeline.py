"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents`` and is what the stage
before kept, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import scratch
from lumenframe.llm.exact_dedup import drop_copies
from lumenframe.llm.nearcopies import drop_similar
from lumenframe.llm.packing import pack
from lumenframe.llm.secrets import mask_secrets
from lumenframe.llm.toxicity import keep_clean


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``docs`` and the labels, doesn't reject.

    In every stage null texts count as empty, rows that repeat an id are rows of their own, further columns stay as they are, and an
    empty table stays empty.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts; all empty texts are one group."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more; texts without words are alike."""
    return drop_similar(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; null and empty texts have none."""
    return mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; an empty text is its end id alone."""
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can't express the classifier, the tokenizer or the packing; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
