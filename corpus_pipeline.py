"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. language: documents without a language, or whose language is doubtful, go.
2. near_duplicates: one document of each near-duplicate class stays.
3. decontamination: documents with words inside a benchmark window go.
4. mixing: sources are mixed to target weights; a document may be there twice.
5. token_files: the mix as token ids in binary files; one row per document read
   back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelscope.llm import decontaminate, language, mixing, near_dup, token_files
from panelscope.llm.common import stored, table
from panelscope.llm.queries import tokenizer_path

#: Probability below which a language is doubtful.
LEAST_PROBABILITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.in_known_language(docs, LEAST_PROBABILITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_digests(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: SQL has no counterpart for the classifier, the hashes and the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
