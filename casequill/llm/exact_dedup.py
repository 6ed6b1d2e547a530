"""Exact duplicates by a plain hash aggregation, with the buckets of an extendible-hash directory as a column.

Texts are compared after each run of blanks became one space. A 64-bit hash of the
normalised text is the key. The directory starts with one slot; while a bucket holds more
distinct keys than fit, its slots double, so that crowded key ranges end up in many small
buckets and sparse ones in few. Each bucket is a range of keys. Equal texts are found by grouping
on bucket, key and text, which compares texts byte by byte but is shuffled by the hash of all
three: no task owns a bucket. Equal keys form one chain with a link for each different text. The
links are written to the shared folder, not by bucket, and documents are joined with them on key
and SHA-256 of the text, without the directory.

Copies never meet as a group: a task first folds its own copies of a text into one row with
the smallest id and a count, and only those rows travel. The directory is the only part that
is broadcast; it has at most ``2 ** max_depth`` slots.

Defined cases: a null text counts as empty, so all empty texts are one group. Null ids are
ignored for the smallest id of a group unless it holds nothing else. A row that repeats id
and text of another one is a copy with the same id; both are reported, as kept where the id
stays, and ``distinct_documents`` lets one of them stay. No rows in, no rows out. Only the id and
text columns are read; other columns can have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.llm.common import keep_rows, text_tag, whole_text
from casequill.operators.staging import stage

#: distinct keys that a bucket takes before it is split
BUCKET_KEYS = 50_000
#: the directory never has more than two to this power slots
MAX_DEPTH = 16


def normalised(text: str) -> Column:
    """Each run of blanks as one space. Runs that are one space already are not touched."""
    return F.regexp_replace(whole_text(text), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def slot(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, bucket_keys: int, max_depth: int) -> DataFrame:
    """(slot, bucket) rows of the directory after all doublings; ``keys`` has a column ``key``.

    One aggregation counts the distinct keys of every range that a doubling could make. A range
    is a bucket if it fits, or can't be split further, and the range that it is half of did not fit.
    """
    distinct = keys.groupBy("key").agg(F.count("*").alias("rows"))
    total = distinct.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(total, 1) / bucket_keys))) + 4 if total > bucket_keys else 0)
    finest = distinct.groupBy(slot(F.col("key"), depth).alias("fine")).agg(F.count("*").alias("held"))
    ranges = (
        finest.select("fine", "held", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
        .withColumn("range", F.expr(f"shiftright(fine, {depth} - depth)"))
        .groupBy("depth", "range")
        .agg(F.sum("held").alias("held"))
    )
    crowded = ranges.where(F.col("held") > bucket_keys).select(
        (F.col("depth") + 1).alias("depth"), F.col("range").alias("parent")
    )
    buckets = (
        ranges.where((F.col("held") <= bucket_keys) | (F.col("depth") == depth))
        .withColumn("parent", F.when(F.col("depth") > 0, F.expr("shiftright(range, 1)")))
        .join(crowded, ["depth", "parent"], "left_semi")
    )
    if total <= bucket_keys:
        buckets = ranges
    width = F.expr(f"shiftleft(1L, {depth} - depth)")
    first = F.col("range") * width
    slots = buckets.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), first.alias("bucket"))
    return slots, depth


def build_index(docs: DataFrame, text: str, doc_id: str, bucket_keys: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, key, link, digest, keep_id, group_size) and the keyed documents (id, tag, key, digest)."""
    rows = docs.select(F.col(doc_id).alias("id"), text_tag(text).alias("tag"), normalised(text).alias("body"))
    rows = rows.withColumn("key", F.xxhash64("body"))
    keyed = stage(rows.select("id", "tag", "key", F.unhex(F.sha2("body", 256)).alias("digest")))
    slots, depth = directory(keyed.select("key"), bucket_keys, max_depth)
    slots = F.broadcast(stage(slots))
    owned = rows.withColumn("slot", slot(F.col("key"), depth)).join(slots, "slot")
    links = owned.groupBy("bucket", "key", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    links = links.select("bucket", "key", F.unhex(F.sha2("body", 256)).alias("digest"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key").orderBy("keep_id", "digest")
    return stage(links.withColumn("link", F.row_number().over(chain))), keyed


def exact_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """One row per document: id, tag, keep_id, group_size, kept, digest of the normalised text, bucket and link in its chain."""
    index, keyed = build_index(docs, text, doc_id, bucket_keys, max_depth)
    return keyed.join(index, ["key", "digest"]).select(
        "id", "tag", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "bucket", "link"
    )


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **index_options) -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were."""
    found = stage(exact_copies(docs, text, doc_id, **index_options).select("id", "tag", "digest", "kept"))
    # an id that stays can have several rows: of those one text stays, and one row of it
    staying = found.where("kept").groupBy(F.col("id").alias("i"), F.col("digest").alias("d"))
    several = stage(staying.agg(F.min("tag").alias("low"), F.max("tag").alias("high"), F.count("*").alias("n")).where("n > 1"))
    other = found.where("kept").join(
        several.where("low < high"), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")) & (F.col("tag") > F.col("low"))
    )
    dropped = stage(found.where("not kept").select("id", "tag").union(other.select("id", "tag")).distinct())
    rows = keep_rows(docs, doc_id, text, dropped, dropped.count(), "left_anti")
    repeated = several.select(F.col("i").alias("id"), F.col("low").alias("tag"))
    n = repeated.count()
    if not n:
        return rows
    once = keep_rows(rows, doc_id, text, repeated, n, "left_semi").withColumn("_text_tag", text_tag(text))
    once = once.dropDuplicates([doc_id, "_text_tag"]).drop("_text_tag")
    return keep_rows(rows, doc_id, text, repeated, n, "left_anti").unionByName(once)
