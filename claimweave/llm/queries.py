"""Named queries of the package over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import backoff, bpe, mixing, negatives, prefixes, quality, ranking, sequences, simhash, substring, suffix, toxicity, warc
from claimweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Name of the vocabulary file of the encoding query.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.stored(table(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, from the same store."""
    return quality.ablation(quality.stored(table(spark, sf_dir, "documents")))


def op2_interleaved_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.document_media(table(spark, sf_dir, "documents"))


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op6_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), text=False)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicate(table(spark, sf_dir, "documents"), text=False)
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_documents(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern, ids=False)


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    found = ranking.scored(docs, model)
    return found.select("doc_id", ranking.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def vocabulary() -> tuple[bytes, str]:
    """The public vocabulary of the encoding query and its pattern, read where the query is built."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


_QUERIES: list[Query] = [
    op1_quality_ledger,
    op2_interleaved_sequences,
    op3_counterfactual_toxicity,
    op4_multi_index_simhash,
    op5_poisson_mixing,
    op6_substring_doubling,
    op7_suffix_array,
    op8_stupid_backoff,
    op9_prefix_bpe,
    op10_warc_salvage,
    op11_pairwise_ranking,
    op12_prefix_trie,
    op13_secondary_sort_negatives,
    quality_ablation,
]


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express over whole tables."""
    return {
        "op1_quality_ledger": quality.ORACLE,
        "quality_ablation": quality.ABLATION_ORACLE,
        "op5_poisson_mixing": mixing.ORACLE,
        "op8_stupid_backoff": backoff.oracle(backoff.ORDER),
        "op12_prefix_trie": prefixes.ORACLE,
        "op13_secondary_sort_negatives": negatives.ORACLE,
    }
