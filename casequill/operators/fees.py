"""Bracketed fees by a schedule table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.functions.text import thousands
from casequill.operators.sizing import broadcast_if_small

SCHEDULE_SCHEMA = (
    "fee_type string, above decimal(20,2), up_to decimal(20,2), base decimal(20,2), "
    "rate decimal(6,4), rate_from decimal(20,2), min_fee decimal(20,2)"
)
MONEY = "decimal(20,2)"

# fixed values: fee = base + rate x (value - rate_from), at least min_fee. Amounts in
# thousands; only brackets with a confirmed result are listed, and a value beyond them has
# no fee until the caller adds a bracket.
_K = 1_000
SCHEDULE = (
    ("ds_co_gia_ngach", 0, 6_000, 300, "0", 0),
    ("ds_co_gia_ngach", 6_000, 400_000, 0, "0.05", 0),
    ("ds_co_gia_ngach", 400_000, 800_000, 20_000, "0.04", 400_000),
    ("ds_co_gia_ngach", 800_000, 2_000_000, 36_000, "0.03", 800_000),
    ("ds_co_gia_ngach", 2_000_000, 4_000_000, 72_000, "0.02", 2_000_000),
    ("ds_co_gia_ngach", 4_000_000, None, 112_000, "0.001", 4_000_000),
    ("kdtm_co_gia_ngach", 0, 60_000, 3_000, "0", 0),
    ("kdtm_co_gia_ngach", 60_000, 400_000, 0, "0.05", 0),
    ("lao_dong_co_gia_ngach", 0, 6_000, 300, "0", 0),
    ("lao_dong_co_gia_ngach", 6_000, 400_000, 0, "0.03", 0),
    ("lao_dong_co_gia_ngach", 400_000, 2_000_000, 12_000, "0.02", 400_000),
)
#: fixed values: lowest fee by type
LOWEST = {"ds_co_gia_ngach": 300, "kdtm_co_gia_ngach": 3_000, "lao_dong_co_gia_ngach": 300}


def fee_schedule(spark: SparkSession, rows=SCHEDULE, lowest=LOWEST) -> DataFrame:
    def money(v):
        return None if v is None else Decimal(v) * _K

    data = [
        (t, money(above), money(up_to), money(base), Decimal(rate), money(start), money(lowest[t]))
        for t, above, up_to, base, rate, start in rows
    ]
    return spark.createDataFrame(data, SCHEDULE_SCHEMA)


def fees(claims: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add fee, reason (``no bracket`` when the schedule has none) and fee_text.

    ``claims(claim_id, fee_type, value, discount)``. The schedule is broadcast behind a
    size check: an equi-join on the type with the bracket as residual condition.
    """
    value = F.col("value")
    joined = claims.join(
        broadcast_if_small(schedule.withColumnRenamed("fee_type", "s_type")),
        (F.col("fee_type") == F.col("s_type"))
        & ((value > F.col("above")) | ((value == 0) & (F.col("above") == 0)))
        & (F.col("up_to").isNull() | (value <= F.col("up_to"))),
        "left",
    )
    full = F.greatest(
        F.col("base") + (F.col("rate") * (value - F.col("rate_from"))).cast(MONEY), F.col("min_fee")
    )
    fee = F.when(F.col("discount"), full * F.lit("0.5").cast("decimal(2,1)")).otherwise(full).cast(MONEY)
    return joined.select(
        *claims.columns,
        fee.alias("fee"),
        F.when(F.col("s_type").isNull(), F.lit("no bracket")).alias("reason"),
    ).withColumn("fee_text", thousands(F.col("fee")))
