"""Case register: parties per case and figures per case type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_parties(cases: DataFrame, role_columns: dict[str, str]) -> DataFrame:
    """Party arrays of a case as rows: case_id, role, party_no, party."""
    parts = None
    for role, column in role_columns.items():
        rows = cases.select(
            "case_id", F.lit(role).alias("role"), F.posexplode(column).alias("pos", "party")
        ).select("case_id", "role", (F.col("pos") + 1).alias("party_no"), "party")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def party_counts(parties: DataFrame) -> DataFrame:
    """Parties per case and role; partial aggregation only."""
    return parties.groupBy("case_id", "role").agg(F.count("*").alias("parties"))


def type_statistics(cases: DataFrame, value: str = "value") -> DataFrame:
    return cases.groupBy("case_type").agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("closed")).alias("closed_cases"),
        F.sum(value).alias("total_value"),
        F.min("filed_date").alias("first_filed"),
        F.max("filed_date").alias("last_filed"),
    )
