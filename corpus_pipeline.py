"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes the session, its predecessor's documents and the table folder, and
returns a DataFrame that is written as Parquet and read back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlsight.llm import exact, gam, mixing, near, packing
from crawlsight.llm.common import table
from crawlsight.session import stage


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return gam.kept_documents(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five words, similarity 0.8."""
    return near.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that training reads: their ids, little-endian 32 bits, and a checksum."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", accept),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline_" + name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
