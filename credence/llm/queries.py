"""The registered queries of the corpus operators, and their SQL where it exists.

Each takes (spark, data folder), applies its operator to the whole table and
returns the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import bidiagonal_whitening, collision_search, host_reputation, labelled, license_join, merge_automaton, ngram_join, pivot_search, ppm_language, quality_trees, reply_trees, source_schedule, token_alignment, toxicity_chain
from credence.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of Jaccard 0.8 on 5-word shingles."""
    return ngram_join.near_components(table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the url of every page."""
    return host_reputation.judged(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; ids with crc32 modulo 5 = 0 teach nothing."""
    docs = table(spark, folder, "documents")
    sample = labelled.labelled_sample(docs, table(spark, folder, "labels"), "quality", ~labelled.held_out(F.col("doc_id")))
    rows = quality_trees.scored(docs, quality_trees.fit(sample))
    return rows.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; ids with crc32 modulo 4 = 2 teach nothing."""
    docs = table(spark, folder, "documents")
    out = ppm_language.held_out(F.col("doc_id"))
    rows = ppm_language.predicted(docs, ppm_language.fit(docs, ~out))
    return rows.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows found for every vector whose id is divisible by 20."""
    return collision_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return source_schedule.mixed(table(spark, folder, "documents"))


def op7_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return merge_automaton.encoded(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases, and clauses of licenses met, of every document."""
    return license_join.identified(table(spark, folder, "documents")).drop("blocks")


def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 highest integer inner products of every vector whose id is divisible
    by 100."""
    return pivot_search.highest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Category probabilities and verdict of every document; ids with crc32 modulo
    5 = 0 teach nothing."""
    docs = table(spark, folder, "documents")
    sample = labelled.labelled_sample(docs, table(spark, folder, "labels"), "toxic", ~labelled.held_out(F.col("doc_id")))
    rows = toxicity_chain.scored(docs, toxicity_chain.fit(sample))
    return rows.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "p_severe", "p_mild", "score", "predicted")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Four whitened components of every vector, and how exact they are."""
    rows = bidiagonal_whitening.rounded(table(spark, folder, "embeddings"))
    return bidiagonal_whitening.whitened(rows, bidiagonal_whitening.fit(rows))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, and what is read back from it. A row is named by
    its place in its file."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text", *place)
    return reply_trees.digests(reply_trees.with_trial(rows))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenizers, of every document."""
    return token_alignment.aligned(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_nearest": op5_nearest,
    "op6_source_mix": op6_source_mix,
    "op7_bpe_encoding": op7_bpe_encoding,
    "op8_license_scan": op8_license_scan,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_token_alignment": op13_token_alignment,
}
STATEMENTS: dict[str, str] = {
    "op12_chat_format": reply_trees.SQL,
    "op2_url_filter": host_reputation.SQL,
    "op6_source_mix": source_schedule.SQL,
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product([CAST(x AS DOUBLE) FOR x IN q.e], [CAST(x AS DOUBLE) FOR x IN c.e]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
