"""Rows that every operator on documents must stand: nulls, empty and very long texts, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while nine old owls watch from their tall dark tree"
#: names that operators use for columns of their own
CLASHING = ["id", "key", "body", "kept", "score", "name", "part", "spans", "tag", "epoch", "tokens", "component", "print", "removed"]


def rows() -> list[tuple]:
    long = " ".join(f"word{i % 977} {WORDS.split()[i % 17]}." for i in range(20_000))
    return [
        (1, f"{WORDS}. {WORDS}!", "en", "a"),
        (2, f"{WORDS}.  {WORDS}!", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n", "fr", None),
        (6, "one", "en", "a"),
        (7, "One", "en", "a"),
        (8, long, "en", "a"),
        (9, "x" * 300_000, "en", "c"),
        (10, f"{WORDS} and then some more of it in another place. Mail me at jo.do@mail.example.org now", "en", "a"),
        (1, f"{WORDS}. {WORDS}!", "en", "a"),
        (None, "a text without a number", "en", "b"),
        (None, None, None, None),
        (11, "naïve café — ключ 漢字 \u0001 \x1c ok ", "ru", "b"),
    ]


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    made = spark.createDataFrame(rows() if data is None else data, "doc_id bigint, text string, lang string, source string")
    return made.withColumns({c: F.lit("other") for c in CLASHING})


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
