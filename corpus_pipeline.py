"""A training corpus from documents: rejected documents go, repeated lines go, of near copies one stays, sources
are mixed to their weights, and what is left becomes tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, jaccard_join, line_dedup, mixing, quality
from marlstone.llm.common import materialize
from marlstone.llm.queries import TOKENIZERS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and blank texts are among them."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but from the first document that has them; documents without a word left go, too."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of repeated rows one."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one, too."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens; a row for each row. Every stage gives no rows for none."""
    return bpe.tokenize(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates),
    ("mix sources", mix_sources),
    ("bpe tokens", tokens),
]

#: No SQL for the templates, the model-free shuffle order and the tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
