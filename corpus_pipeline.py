"""Corpus pipeline: the stages that turn ``documents`` into encoded training text.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the docs of the
next stage.  All stages but the last return the columns of ``documents``.

Edge cases: the quality rules reject null, empty and short texts; rows of one id with unlike
texts are documents of their own, of equal rows one stays; a text that the dedup stage empties
keeps its row, and has no words or pieces from there on; rows with a null id are treated
like others and keep it; other columns pass through, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, ngram_join, piece_nbest, quality_rules, substring_dedup
from slotwise.llm.common import stage_table
from slotwise.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 35-word passages; texts without any stay as they are, emptied ones have an empty text."""
    cut = substring_dedup.remove_repeats(docs, window=35, layout=True, n_words="_llm_n_words", n_removed="_llm_n_removed")
    if "n_chars" in docs.columns:
        length = F.when(F.col("_llm_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length)
    return cut.select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's three best segmentations, their scores, and whether decoding each gives the text back."""
    return piece_nbest.encode(docs, tokenizer_path("piece_bpe_32k.model"), nbest=3)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece_nbest", encoded),
]

#: The stages use a suffix array, connected components and a piece lattice, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
