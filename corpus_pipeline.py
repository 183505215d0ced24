"""The training-data pipeline over ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import bpe, mixing, near, simhash, suffix, toxicity
from claimweave.llm.common import ready, settle, table
from claimweave.llm.queries import vocabulary

#: Columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject. Null texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, COLUMNS).where(F.col("predicted") == 0).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without near copies stay.

    Near copies have SimHash fingerprints within three bits, found by multi-index hashing as in op4. Of what that leaves, texts
    with a Jaccard similarity of 0.8 and more on five-word shingles are near copies as well. Both directly or through others.
    """
    ready(spark)
    rows = docs.select(*COLUMNS)
    return near.representatives(rows, among=simhash.kept_rows(rows))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that already came earlier; what is left empty by this goes.

    A character goes with any of its bytes. ``n_chars`` follows the text; null texts come back empty.
    """
    ready(spark)
    found = suffix.deduplicate(docs, keep=("doc_id", "lang", "source"))
    left = found.where((F.length("kept_text") > 0) | (F.col("n_bytes") == 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates of their sources, in hashed order. A document may come several times."""
    ready(spark)
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every text."""
    ready(spark)
    ranks, pattern = vocabulary()
    return bpe.encode_documents(docs, ranks, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: The first stage trains a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
