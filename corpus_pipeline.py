"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept; its result is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  Null texts count as empty; rows that share an id are kept apart but by
near-dedup, where equal rows are copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.sizing import work_folder
from typeloom.llm.bagminhash import drop_near_duplicates
from typeloom.llm.decontamination import decontaminate
from typeloom.llm.packing import pack
from typeloom.llm.pii import redacted
from typeloom.llm.quality_rules import clean

TOKENIZER = "word_bpe_49k.json"
WINDOW = 2048
#: No one SQL statement makes token ids, multiset signatures and fitted span models.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they now are, where documents has that column."""
    if "n_chars" not in docs.columns:
        return docs
    length: Column = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return _recounted(clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return drop_near_duplicates(docs, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items, and without those made up of them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontaminate(docs, items, size=10))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _recounted(redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 token ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER), end_id=1, window=WINDOW)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark),
    ("pii", personal),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents below ``sf_dir``."""
    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
