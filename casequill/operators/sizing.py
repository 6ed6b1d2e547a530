"""Size checks before broadcasts, and running totals that do not collect a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.operators.staging import stage

#: largest side that is sent to every executor
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> Column:
    """Size of a row: strings by their bytes, nested values by their JSON, others 8 bytes, and 16 for the row."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "string" or kind == "binary":
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.octet_length(F.to_json(F.struct(column)))
        else:
            size = size + 8
    return size


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the frame has at most so many rows and bytes. Both are summed in the tasks."""
    rows, size = df.agg(F.count("*"), F.sum(_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the join shuffles both sides."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row inside its group.

    Rows are split by ranges of group and order, so a hot group is spread over many tasks; each
    range is summed by itself, and the totals of the ranges before it are added.
    """
    rows = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    rows = stage(rows)
    totals = rows.groupBy(*group, "_range").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn(name, F.sum("_value").over(inside)).join(before, [*group, "_range"])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_value", "_before")
