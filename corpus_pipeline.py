"""A corpus pipeline over ``documents``: each stage is written as Parquet and read
again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import labelled, merge_automaton, ngram_join, ppm_language, source_schedule, toxicity_chain
from credence.llm.common import durable, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the chain of classifiers does not call toxic. It learns from
    the labelled documents of its input, a bounded sample of them."""
    sample = labelled.labelled_sample(docs, table(spark, folder, "labels"), "toxic", F.lit(True))
    return toxicity_chain.kept(docs, toxicity_chain.fit(sample))


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are in some language. Trees are learned from those of its
    input that name theirs."""
    return ppm_language.kept(docs, ppm_language.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the schedule of sources takes it."""
    return source_schedule.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids and digests of every text that is left."""
    return merge_automaton.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_encoding", encode),
]
#: The models of the first stages are trained; SQL can't state them.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what passes between two stages is written to
    the shared folder of the cluster and read again."""
    docs = table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = durable(docs)
    return docs
