"""Corpus pipeline over `documents`: quality rules, SimHash near-dedup, PII pseudonyms, mixing, piece encoding.

Defined results: a null or empty text fails the quality rules, so later stages see none from here, though each defines them by
itself; documents of null id count as distinct from those with one; repeated rows count as often as they occur until the SimHash
stage keeps one; an empty table passes through as an empty one; columns beyond those of documents, of any name but `ids` in the
last stage, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isochrona.llm import mixing, pieces, pii, quality, simhash
from isochrona.llm._store import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, and those of rejected hosts, go; a null text fails, a null source is a host."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id; those without an id come after all others."""
    return simhash.representatives(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced; a null text stays null."""
    return pii.pseudonymise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources near their target weights: a row for each copy of a document that the mix takes, shard after shard, each in its
    own shuffled order; a null source is a source."""
    return mixing.in_shards(mixing.mix(docs)).select("row.*")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and the ids of its pieces; a null text has null ids."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("pii_pseudonyms", pii_pseudonyms),
    ("source_mix", source_mix),
    ("piece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, keyed permutations and merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
