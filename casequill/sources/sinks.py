"""Writers for the results. Nothing passes through the driver; every sink is a Spark write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Issue table with one directory per severity, so a severity view reads only its own files."""
    issues.write.mode(mode).partitionBy("severity").parquet(path)


def write_entities(entities: DataFrame, path: str, mode: str = "overwrite") -> None:
    entities.write.mode(mode).partitionBy("type").parquet(path)


def write_blocks(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ordered text blocks (doc_id, block_no, block) as text files.

    Range-partitioned on document and block, so a document of any length is spread over
    files whose order is the order of its blocks.
    """
    ordered = blocks.repartitionByRange("doc_id", "block_no").sortWithinPartitions("doc_id", "block_no")
    ordered.select(F.col("block").alias("value")).write.mode(mode).text(path)


def write_texts(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rewritten texts (marked, corrected, anonymised), one directory per ``mode`` column if any."""
    writer = texts.write.mode(mode)
    if "mode" in texts.columns:
        writer = writer.partitionBy("mode")
    writer.parquet(path)


def write_plan(plan: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rename manifest for whoever owns the storage, one directory per status."""
    plan.write.mode(mode).partitionBy("status").parquet(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Readable rename report, by folder and then name; a range partitioning, not one task."""
    ordered = lines.repartitionByRange("folder", "old_name", "path").sortWithinPartitions("folder", "old_name", "path")
    ordered.select(F.col("block").alias("value")).write.mode(mode).text(path)
