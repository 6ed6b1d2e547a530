"""Substring dedup by sliding spans of sentences.

A text is cut into sentences behind line breaks and behind an end mark and a blank. Spans are
all runs of ``run`` consecutive sentences, and shorter runs that have ``long_words`` words, so
that a passage of few long sentences counts too. Blank lines are no sentences, runs of under
``least_words`` words are no spans, and letter case and the number of blanks make no difference.
All spans of all documents are hashed to 128 bits and joined globally: the occurrence with the
smallest (document, sentence) is the first one. Sentences that any non-first occurrence of a
repeated span covers are removed.

Hashes alone are counted first, in the tasks before the shuffle, so a passage that a third of the
documents hold is one row for each task. Only spans of repeated hashes go on, by a semi join whose hot
hashes adaptive execution splits; their first occurrences are found among those few. Removed sentences come back to their documents as one short list for each.

Defined cases: a null text counts as empty. Rows with equal ids are told apart by their texts; rows
that repeat id and text are one document here, kept or cut alike. Null ids come first. A text
with fewer sentences than a run has only its long sentences as spans. No rows in, no rows out. Only the
id and text columns are read; ``cut_documents`` returns all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequill.llm.common import whole_text
from casequill.operators.staging import stage

#: sentences in a span
RUN = 3
#: words from which fewer sentences are a span
LONG_WORDS = 30
#: words that a span has at least
LEAST_WORDS = 10

_SPANS = "array<struct<at:int,to:int,h1:bigint,h2:bigint>>"


def sentences(text: Column) -> Column:
    """All sentences; joined they are the text."""
    return F.filter(F.split(text, r"(?<=\n)|(?<=[.!?][ \t])"), lambda s: s != "")


def _worded(text: Column) -> Column:
    """(at, plain, words) of the sentences that are not blank."""
    plain = lambda s: F.lower(F.btrim(F.regexp_replace(s, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")))
    numbered = F.transform(sentences(text), lambda s, i: F.struct(i.alias("at"), plain(s).alias("plain")))
    return F.transform(
        F.filter(numbered, lambda s: s["plain"] != ""),
        lambda s: F.struct(s["at"].alias("at"), s["plain"].alias("plain"), F.size(F.split(s["plain"], " ")).alias("words")),
    )


def _spans(worded: Column, run: int, long_words: int, least_words: int) -> Column:
    """First and last sentence and hash of all spans."""

    def of(length: int) -> Column:
        def span(i: Column) -> Column:
            own = [F.get(worded, i + k) for k in range(length)]
            words = sum((s["words"] for s in own[1:]), own[0]["words"])
            body = F.concat_ws("\n", *[s["plain"] for s in own])
            found = F.struct(
                own[0]["at"].alias("at"), own[-1]["at"].alias("to"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")
            )
            return F.when(words >= (least_words if length == run else max(least_words, long_words)), found)

        starts = F.sequence(F.lit(0), F.size(worded) - length)
        spans = F.filter(F.transform(starts, span), lambda s: s.isNotNull())
        return F.when(F.size(worded) >= length, spans).otherwise(F.array().cast(_SPANS))

    return F.concat(*[of(length) for length in range(1, run + 1)])


def repeated_sentences(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
    run: int = RUN, long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, tag, n_spans, removed) for each document with repeats; ``removed`` lists sentence numbers from 0, ``tag`` is a hash of the text."""
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("body"))
    worded = rows.select("id", F.xxhash64("body").alias("tag"), _worded(F.col("body")).alias("worded"))
    spans = stage(worded.select("id", "tag", F.inline(_spans(F.col("worded"), run, long_words, least_words))))
    place = F.struct("id", "tag", "at", "to")
    repeated = spans.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    # repeated hashes grow with the input, so they are not broadcast at any size
    held = stage(spans.join(repeated.hint("merge"), ["h1", "h2"], "left_semi"))
    # written, so that the join reads both sides from shuffles and adaptive execution can split a hot hash
    first = stage(held.groupBy("h1", "h2").agg(F.min(place).alias("first")))
    again = held.join(first.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = again.select("id", "tag", F.sequence("at", "to").alias("covered"))
    return covered.groupBy("id", "tag").agg(
        F.count("*").alias("n_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("removed")
    )


def cut_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str | None = None, **options) -> DataFrame:
    """``docs`` without the repeated sentences, all columns as they were; with ``mark`` a column that lists the removed ones."""
    found = stage(repeated_sentences(docs, text, doc_id, **options))
    found = found.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), F.col("removed").alias("_removed"))
    body = whole_text(text)
    # so do documents with repeats: the plan is the same at any size, and texts are shuffled once
    joined = docs.join(found.hint("merge"), docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_tag")), "left")
    left = F.filter(sentences(body), lambda s, i: ~F.array_contains(F.col("_removed"), i))
    new = F.when(F.col("_removed").isNull(), docs[text]).otherwise(F.array_join(left, ""))
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    return joined.select(*[new.alias(c) if c == text else docs[c] for c in docs.columns], *([removed.alias(mark)] if mark else []))
