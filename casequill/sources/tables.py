"""Schemas and readers of the input tables. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "doc_id bigint, text string",
    "pages": "doc_id bigint, page_no bigint, title string, text string",
    "files": "path string, length bigint",
    "overrides": "path string, new_name string",
    "replacements": "doc_id bigint, seq int, old string, new string",
    "loans": (
        "loan_id bigint, principal decimal(20,2), rate double, rate_unit string, overdue_rate double, basis string, "
        "term_years int, term_months int, term_days int, start_date date, settle_date date"
    ),
    "payments": "loan_id bigint, date date, principal_paid decimal(20,2), interest_paid decimal(20,2)",
    "rates": "loan_id bigint, rate double, unit string, from_date date, to_date date",
    "claims": "claim_id bigint, fee_type string, value decimal(20,2), discount boolean",
    "terms": "term_id bigint, start_date date, months int, days int, held_days int, as_of date",
    "holidays": "date date",
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One of the input tables from files of any Spark format (parquet, csv, json, ...)."""
    return spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(path)
