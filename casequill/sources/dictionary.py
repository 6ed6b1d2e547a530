"""Dictionaries: reading word lists, deriving them from text, lookup columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions.text import modern_tones, nfc, strip_accents
from casequill.sources import rules


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """A spell-checker word list, one word a line: the numeric header and flags after ``/``
    are dropped, words are composed and lower-cased."""
    lines = spark.read.text(path)
    words = lines.where(
        ~F.regexp_like(F.trim("value"), F.lit(r"^\p{Nd}+$")) & (F.trim("value") != "")
    ).select(F.lower(nfc(F.split_part(F.col("value"), F.lit("/"), F.lit(1)))).alias("word"))
    return words.distinct()


def complete_words(words: DataFrame, domain_words=tuple(rules.DOMAIN_WORDS)) -> DataFrame:
    """Words, their current tone placement, and the words of the domain."""
    extra = words.sparkSession.createDataFrame([(w.lower(),) for w in domain_words], "word string")
    return words.unionByName(words.select(modern_tones(F.col("word")).alias("word"))).unionByName(extra).distinct()


def words_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct lower-case tokens of a text column."""
    tokens = F.regexp_extract_all(F.col(column), F.lit(chars.TOKEN), F.lit(0))
    return texts.select(F.explode(F.array_distinct(tokens)).alias("t")).select(F.lower("t").alias("word")).distinct()


def letter_signature(word: Column) -> Column:
    """64-bit set of letters: bit i for letter i, bit i + 26 for its second occurrence.

    The number of differing bits is never more than the number of single-letter
    insertions and deletions between two words, so it is a cheap lower bound. Letters
    outside a-z are left out, which keeps the bound safe.
    """

    def add(acc: Column, letter: Column) -> Column:
        index = F.ascii(letter) - ord("a")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), index)
        repeated = F.call_function("shiftleft", bit, F.lit(26))
        seen = acc.bitwiseAND(bit) != 0
        return F.when(index.between(0, 25), acc.bitwiseOR(F.when(seen, repeated).otherwise(bit))).otherwise(acc)

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), add)


def lookup_table(words: DataFrame) -> DataFrame:
    """Dictionary with the columns the suggestion join needs."""
    # non-nullable, so that joins derive no "is not null" filters from the expressions
    skeleton = F.coalesce(strip_accents(F.col("word")), F.lit(""))
    return words.select(
        "word", F.coalesce(F.length("word"), F.lit(0)).alias("word_len"), skeleton.alias("skeleton")
    ).withColumn("signature", F.coalesce(letter_signature(F.col("skeleton")), F.lit(0).cast("bigint")))
