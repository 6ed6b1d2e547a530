"""Page texts to per-document output, and batch accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequill.functions.text import is_blank, trim_space
from casequill.sources import rules


def page_block(page_no: Column, text: Column, fmt: str) -> Column:
    """One page in the template of the format; a blank page gets the marker text."""
    if fmt == "md":
        empty, head, tail = rules.MARKDOWN_EMPTY_PAGE, ("## Trang ", "\n\n"), "\n\n\n"
    else:
        empty, head, tail = rules.TEXT_EMPTY_PAGE, ("=== Trang ", " ===\n\n"), "\n\n" + "-" * 40 + "\n\n"
    body = F.when(is_blank(text), F.lit(empty)).otherwise(trim_space(text))
    return F.concat(F.lit(head[0]), page_no.cast("string"), F.lit(head[1]), body, F.lit(tail))


def _header(title: Column, stamp: str, fmt: str) -> Column:
    if fmt == "md":
        return F.concat(F.lit("# Kết quả OCR - "), title, F.lit(f"\n\n> Ngày tạo: {stamp}\n\n---\n\n"))
    return F.concat(
        F.lit("KET QUA OCR - "), title, F.lit(f"\nNgay tao: {stamp}\n" + "=" * 60 + "\n\n")
    )


def _footer(total: Column, fmt: str) -> Column:
    if fmt == "md":
        return F.concat(F.lit("---\n\n*Tổng số trang: "), total.cast("string"), F.lit("*\n"))
    return F.concat(F.lit("Tong so trang: "), total.cast("string"), F.lit("\n"))


def document_blocks(pages: DataFrame, fmt: str, stamp: str) -> DataFrame:
    """Header, pages and footer of each document as rows: doc_id, block_no, block.

    ``pages(doc_id, page_no, title, text)`` with pages numbered from 1; the title is that of the
    first page there is. Only counts and titles are aggregated; page texts are not shuffled.
    """
    totals = pages.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.max("page_no").alias("last"), F.min_by("title", "page_no").alias("title")
    )
    return (
        pages.select(
            "doc_id", F.col("page_no").alias("block_no"), page_block(F.col("page_no"), F.col("text"), fmt).alias("block")
        )
        .unionByName(
            totals.select(
                "doc_id", F.lit(0).cast("bigint").alias("block_no"), _header(F.col("title"), stamp, fmt).alias("block")
            )
        )
        .unionByName(
            totals.select(
                "doc_id", (F.col("last") + 1).alias("block_no"), _footer(F.col("total"), fmt).alias("block")
            )
        )
    )


def assemble(pages: DataFrame, fmt: str, stamp: str, pages_per_part: int = 1000) -> DataFrame:
    """Documents as text: doc_id, part_no, text; one shuffle.

    Parts are runs of ``pages_per_part`` block numbers, so a group never grows with the
    document; concatenating the parts in order gives the document.
    """
    part = F.floor(F.col("block_no") / (pages_per_part + 2)).alias("part_no")
    return (
        document_blocks(pages, fmt, stamp)
        .groupBy("doc_id", part)
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda b: b["block"]), ""
            ).alias("text")
        )
    )


def output_name(stem: Column, stamp: str, extension: str) -> Column:
    return F.concat(stem, F.lit(f"_OCR_{stamp}.{extension}"))


def review_name(stem: Column, mode: str) -> Column:
    suffix = {"marked": "_BAN_RA_SOAT", "corrected": "_DA_SUA"}[mode]
    return F.concat(stem, F.lit(suffix))


def document_results(inputs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per input file: doc_id, filename, success, total_pages, error.

    ``inputs(doc_id, filename, error)`` where a non-null error is a failed file.
    """
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    return inputs.join(counted, "doc_id", "left").select(
        "doc_id",
        "filename",
        F.col("error").isNull().alias("success"),
        F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0).cast("bigint"))).alias("total_pages"),
        "error",
    )


def batch_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_files"),
        F.count_if("success").alias("processed"),
        F.count_if(~F.col("success")).alias("errors"),
        F.sum("total_pages").alias("total_pages"),
    )


def failed(results: DataFrame) -> DataFrame:
    """The error list stays a table; it can be as long as the batch."""
    return results.where(~F.col("success")).select("doc_id", "filename", "error")


def succeeded(results: DataFrame) -> DataFrame:
    return results.where("success")
