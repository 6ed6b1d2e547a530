"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: proven upper bound, in bytes, of a table that is sent to every executor
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str) -> Column:
    """A text column as it is; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_tag(text: str) -> Column:
    """Tells apart the texts of rows with equal or null ids."""
    return F.xxhash64(whole_text(text))


def keep_rows(df: DataFrame, doc_id: str, text: str, listed: DataFrame, n: int, how: str) -> DataFrame:
    """Rows of ``df`` whose id and text are listed (``left_semi``) or not (``left_anti``).

    ``listed`` is a written table of ``n`` rows (id, tag). Within the bound it is broadcast, so that
    texts need no shuffle; beyond it both sides are shuffled. Null ids match null ids.
    """
    listed = listed.select(F.col("id").alias("_listed_id"), F.col("tag").alias("_listed_tag"))
    if n * 32 <= BROADCAST_BYTES and dict(listed.dtypes)["_listed_id"] in ("int", "bigint"):
        listed = F.broadcast(listed)
    same = df[doc_id].eqNullSafe(listed["_listed_id"]) & (F.xxhash64(F.coalesce(df[text].cast("string"), F.lit(""))) == listed["_listed_tag"])
    return df.join(listed, same, how)
