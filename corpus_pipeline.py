"""A corpus pipeline of five stages: quality rules, near-duplicates, benchmark decontamination, surrogates for personal
data, and SentencePiece encoding. Each stage is written as Parquet in the cluster's shared folder and read back by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, nearcopies, pii, quality, sentencepiece
from corpusloom.llm.common import stage_table, table
from corpusloom.llm.queries import SURROGATE_KEY, piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group at a five-word Jaccard similarity of 0.8 or more stays."""
    return nearcopies.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item, up to its error budget, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; ``n_chars`` follows the text."""
    return pii.replace(docs, SURROGATE_KEY, length="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the text that they decode to."""
    return sentencepiece.encode_documents(docs, piece_model())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("personal data", personal_data),
    ("SentencePiece encoding", encoding),
]

#: SQL cannot express all stages; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded rows of all documents that are kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, "pipeline")
    return docs
