"""From raw documents to token ids in five stages. Each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. Null and empty texts, ties, repeated rows and extra columns are treated as
each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm import bpe, common, exact_dedup, mixing, simhash, toxicity

#: File in the public tokenizers' folder that the last stage encodes with.
VOCABULARY = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers don't call toxic."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    import public_tokenizers

    return bpe.digests(docs, bpe.load_ranks(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Neither learned scores nor fingerprints can be had in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
