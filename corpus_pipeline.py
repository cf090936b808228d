"""The corpus pipeline: quality classifier, language ID, exact dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of the documents, others that a table may have included. An empty table
gives an empty table. How a stage treats nulls, ties and very long texts is its
operator's affair, and stands there.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import exact_dedup, jaccard_join, language_id, packing, quality_lm
from sheaf.deploy import delete
from sheaf.llm.common import cut, discard, empty_heaps, own_tables, sparing, tidy
from sheaf.llm.queries import table, tokenizer_path


_LEFT: set[str] = set()


def _stage(function):
    """A stage's result is written before the next stage is called: tables that earlier results read go then, but for those that its own input reads.

    So does what the executors' heaps grew by: a stage's Python workers find the room that they would have in a job of their own.
    The driver, which sees hundreds of jobs, gives memory back when a stage begins and between a stage's tables.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = own_tables(docs)
        for path in _LEFT - reads:
            delete(spark, path)
        _LEFT.intersection_update(reads)
        empty_heaps(spark)
        with sparing(spark):
            out = function(spark, docs, sf_dir)
        _LEFT.update(own_tables(out) - reads)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the bounds of their language. Null and empty texts go; repeated rows stay."""
    return quality_lm.keep(docs, table(spark, sf_dir, "labels"))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told without ambiguity. Texts without a letter go; repeated rows stay."""
    return language_id.keep(docs, language_id.fit(docs))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; a null text equals an empty one, and of repeated rows one stays."""
    return exact_dedup.dedup(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Texts without words and rows without a key stay."""
    return jaccard_join.dedup(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in their sequences; a text without tokens is its end id alone."""
    packed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), window=1024)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("packing", pack)]

#: The models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
