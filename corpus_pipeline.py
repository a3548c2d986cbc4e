"""A corpus pipeline of five of the operators: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

A stage's result is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import langid, mixing, packing, simhash, substring
from tidewater.llm.common import drop, stored, table

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: those without a letter that labelled texts have."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut out."""
    return substring.without_repeats(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned to the target weights of their domains."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized documents in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            if before is not None:
                drop(before)
            before = docs
    return docs
