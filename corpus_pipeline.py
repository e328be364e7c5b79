"""A five-stage corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before it kept, and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calltide.llm.decontaminate import decontaminated
from calltide.llm.ngram_join import deduplicated
from calltide.llm.pieces import Vocabulary, encode
from calltide.llm.pii import mask_pii
from calltide.llm.quality import good_documents
from calltide.session import Scratch, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id. Links are by five-word shingles at 0.8."""
    return deduplicated(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars is counted anew."""
    return mask_pii(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left, and whether they decode to it."""
    return encode(docs, Vocabulary.load()).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", ngram_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: Trained models, connected components and a tokenizer are beyond SQL: tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to and read again from the shared folder of the session; what a stage has
    read is deleted when it is written."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
    return docs
