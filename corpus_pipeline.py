"""A training-corpus pipeline over the documents table.

Quality rules, near-duplicate removal, benchmark decontamination, mixing of the
sources, token-id output.  Each stage takes what its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, ngram_join, quality_rules, source_mixing, token_files
from weftgraph.llm.shared import shared_folder, written

#: SQL cannot express the tokenizer; tests hold the result against a brute-force version.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that the rules reject.

    A null or empty text has no words and is rejected; repeated rows are judged alike;
    other columns pass through, whatever they are called; an empty table stays empty.
    """
    return _sized(quality_rules.clean(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    A null doc_id stays; rows that repeat a kept doc_id all stay; texts without words
    are linked with nothing; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go.

    Null texts stay null; very long texts are read whole; without test items nothing
    is cut; other columns pass through; an empty table stays empty.
    """
    return _sized(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own; texts without words are never taken; rows
    that repeat a doc_id are drawn alike, ordered by size; an empty table stays empty.
    """
    return source_mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written to files; the result is what the files hold.

    A null text counts as empty and has the end id only; rows that repeat a doc_id each
    have a row, ordered by text; other columns are left out; an empty table gives no rows.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder, with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token-ID output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
