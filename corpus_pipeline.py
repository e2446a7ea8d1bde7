"""A corpus pipeline: every stage works on all that the one before has kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.near import near_dedup
from lodestone.llm.packing import pack_documents
from lodestone.llm.substrings import drop_repeats
from lodestone.llm.toxicity import drop_toxic, labelled_chain
from lodestone.runtime import Scratch


#: Rows that a worker is sent at a time, at most.
SENT = 2_000


def in_parts(stage):
    """A stage whose rows go to workers and back by ``SENT`` at most: both sides of the pipe hold what is sent in whole, and a text may be long.

    Stages are run when they are written, so the session keeps the setting; a smaller one that it has stays.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= SENT:
            spark.conf.set(name, str(SENT))
        return stage(spark, docs, sf_dir)

    return run


@in_parts
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs, labelled_chain(spark, docs, sf_dir))


@in_parts
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    return exact_dedup(docs)


@in_parts
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) one stays."""
    return near_dedup(docs)


@in_parts
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that repeat are cut from the texts."""
    return drop_repeats(docs)


@in_parts
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: SQL has no classifier chain and no packing search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
