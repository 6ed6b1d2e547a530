"""From documents to packed training sequences: reject, deduplicate, mix, pack.

Every stage takes the session, the documents that its predecessor kept and the folder of the
tables, and returns a DataFrame. All but the last return the columns of the documents. ``run``
writes the result of each stage to the shared folder and reads it again for the next one, so a
lost executor costs the stage at most.

Defined cases are those of the operators. Nulls: a null text counts as empty, null ids stay, null is
a source like others. Empty documents give no rows. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casequill.llm import exact_dedup, mixing, packing, quality, simhash
from casequill.llm.common import table
from casequill.llm.queries import vocabulary_path
from casequill.operators.staging import stage


#: words of a shingle in the near-dedup stage
SHINGLE_WORDS = 5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled ones among them."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of all with the same text, blanks aside."""
    return exact_dedup.distinct_documents(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of five-word shingles differ by few bits."""
    return simhash.representatives(docs, width=SHINGLE_WORDS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources more often, up to the repetition limit."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence."""
    return packing.pack(docs, vocabulary_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", no_near_copies),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: fingerprints and token ids can't be computed in SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        rows = stage(apply(spark, rows, sf_dir))
    return rows
