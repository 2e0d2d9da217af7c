"""From raw documents to token ids, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
the documents that it keeps, all columns included; the last one returns token ids.
Every stage's result is written as Parquet and read back, so a lost executor never
reaches behind the stage it works on, and the next stage plans with real sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import decontaminate, linededup, neardup, pieces, quality
from driftlens.llm.tables import table, tokenizer_path
from driftlens.session import cut_lineage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled
    documents outside the held-out fold."""
    model = quality.train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents; lines that three or more hold stay in the last only."""
    return linededup.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one_of_each(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) per document."""
    return pieces.encode_documents(docs, tokenizer_path(pieces.PIECE_MODEL))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_test_items),
    ("encoding", token_ids),
]

# a trained classifier decides the first stage, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
