"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Every function takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read
again as the next one's docs, so a lost executor repeats tasks of one stage only. All stages but the last
return the columns of their docs. Null or empty texts pass the filters; see each operator for other cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.llm import decontaminate, line_dedup, near_dup, piece_model, toxicity
from evispark.llm.queries import table, vocabulary
from evispark.llm.tables import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal model finds toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops later lines similar to earlier ones, and documents of which nothing is left."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return near_dup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, parity, round_trip, ids and decoded text of each remaining document."""
    return piece_model.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Fitted models, similarity joins and tokenizers have no SQL form: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
