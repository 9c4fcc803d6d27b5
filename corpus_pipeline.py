"""Training-corpus pipeline: quality, exact copies, near copies, mixture, tokens.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and
works on all rows that the stage before it kept, read back from Parquet.  All but the last
return the columns of ``documents``.  The classifier has no SQL form, so ``ORACLE_SQL`` is
None; the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from tavola.llm.queries import mix_parameters, table, tokenizer
from tavola.llm.staging import stage

ORACLE_SQL = None

#: The mixture takes this share of the tokens that arrive, each document once at most.
MIX_SHARE, MIX_SEED = 0.9, 7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the threshold (operator 5)."""
    return quality.keep_good(docs, quality.fit_all(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 4)."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 in 100 five-word shingles (operator 3)."""
    found = ngram_join.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped"), "row_hash").distinct()
    found = stage(found, "dropped")
    same = docs["doc_id"].eqNullSafe(found["dropped"]) & (F.xxhash64(docs["text"]) == found["row_hash"])
    return docs.join(found, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights of domain, language and source (operator 1)."""
    levels, weights = mix_parameters()
    return mixing.mix(docs, levels, weights, MIX_SHARE, max_epochs=1, seed=MIX_SEED, whole=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with their number and the digest of what they decode to (operator 6)."""
    return byte_bpe.round_trip(docs, *tokenizer(), with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
