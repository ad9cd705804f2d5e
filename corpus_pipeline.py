"""Corpus pipeline: quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``, and
any others that the table has.

Edge cases: a null text counts as an empty one, and stays null; rows with a null
id or a repeated one are judged by their text; of repeated rows the quality stage
keeps or drops all, the near-duplicate stage keeps one; texts of any length are
read whole; an empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbook.llm.common import shared_dir
from twinbook.llm.jaccard_join import keep_one
from twinbook.llm.packing import pack, word_count
from twinbook.llm.repeated_spans import kept_text, with_removed
from twinbook.llm.rule_quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without strings of 200 bytes or more that occur elsewhere too."""
    text = kept_text(F.col("text"), F.col("removed"))
    rows = with_removed(docs).withColumn("text", F.when(F.size("removed") > 0, text).otherwise(F.col("text")))
    rows = rows.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: its length bucket, batch and slot; other columns than id, language and source are left behind."""
    return pack(docs.select("doc_id", "lang", "source", word_count(F.col("text")).alias("n_words")), F.col("n_words"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the bucket boundaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
