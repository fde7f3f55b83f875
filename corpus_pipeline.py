"""A corpus pipeline of five stages over `documents`; each stage calls one operator of tagweave.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

Defined cases, as the operators state them: null and empty texts pass the first
three stages and are never sampled; rows of a doc_id with different texts are judged
each by its own text; repeated rows stay or go together; an empty table gives an
empty result; extra columns are kept, whatever their names, but for names that begin
with two underscores, which are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import bpe, minhash, mixing, passages, toxicity
from tagweave.llm.shared import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(sf_dir, "labels", spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts."""
    return passages.dedup_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to flattened shares of source, language and topic."""
    return mixing.sample_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with the digests of a round trip."""
    return bpe.round_trip(docs, ["doc_id", "source", "lang"], ids="token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_passages),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: The stages can't be expressed in SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    for _, stage in STAGES[:-1]:
        with scratch() as kept:  # what the stage wrote for itself goes when its result is written
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
