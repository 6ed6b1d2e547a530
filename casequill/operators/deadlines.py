"""Detention and procedural terms, working days, warning levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequill.functions.dates import add_period, split_days
from casequill.operators.sizing import broadcast_if_small

#: fixed values: days of a detention month, warning thresholds
DAYS_PER_MONTH = 30
DANGER_DAYS, CAUTION_DAYS = 3, 10
YELLOW_SHARE = 0.75


def detention_days(months: Column, days: Column, held_days: Column) -> Column:
    return months * DAYS_PER_MONTH + days - held_days


def detention_end(start: Column, months: Column, days: Column, held_days: Column) -> Column:
    """Last day of a detention term; the start day counts, rest days do not move it."""
    return F.date_add(start, detention_days(months, days, held_days) - 1)


def term_error(start: Column, months: Column, days: Column, held_days: Column) -> Column:
    """Why a term is refused; null when it is valid."""
    return (
        F.when(start.isNull(), F.lit("invalid date"))
        .when((months == 0) & (days == 0), F.lit("no term"))
        .when(detention_days(months, days, held_days) <= 0, F.lit("nothing left"))
    )


def elapsed_days(start: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, start), F.lit(0))


def remaining_days(end: Column, as_of: Column) -> Column:
    """Days left, counting the day of reference itself."""
    return F.greatest(F.datediff(end, as_of) + 1, F.lit(0))


def warning_level(remaining: Column) -> Column:
    return (
        F.when(remaining <= 0, F.lit("expired"))
        .when(remaining <= DANGER_DAYS, F.lit("danger"))
        .when(remaining <= CAUTION_DAYS, F.lit("caution"))
        .otherwise(F.lit("safe"))
    )


def elapsed_color(elapsed: Column, total: Column) -> Column:
    return (
        F.when(elapsed >= total, F.lit("red"))
        .when(elapsed >= total * YELLOW_SHARE, F.lit("yellow"))
        .otherwise(F.lit("normal"))
    )


def percent_of(part: Column, total: Column) -> Column:
    share = F.round(part / total * 100).cast("int")
    return F.when(share.isNotNull(), F.least(F.lit(100), share))  # least skips nulls


def detention_terms(terms: DataFrame) -> DataFrame:
    """Evaluate ``terms(term_id, start_date, months, days, held_days, as_of)``.

    Invalid terms keep their row with ``error`` set and null results.
    """
    start, as_of = F.col("start_date"), F.col("as_of")
    args = (F.col("months"), F.col("days"), F.col("held_days"))
    judged = terms.withColumn("error", term_error(start, *args))
    valid = F.col("error").isNull()
    placed = judged.withColumns(
        {
            "total_days": F.when(valid, detention_days(*args)),
            "end_date": F.when(valid, detention_end(start, *args)),
        }
    )
    counted = placed.withColumns(
        {
            "split": split_days(F.col("total_days")),
            "elapsed": F.when(valid, elapsed_days(start, as_of)),
            "remaining": F.when(valid, remaining_days(F.col("end_date"), as_of)),
        }
    )
    return counted.select(
        "term_id",
        "error",
        "end_date",
        "total_days",
        F.col("split.months").alias("left_months"),
        F.col("split.days").alias("left_days"),
        "elapsed",
        "remaining",
        percent_of(F.col("elapsed"), F.col("total_days")).alias("percent"),
        F.when(valid, warning_level(F.col("remaining"))).alias("level"),
        F.when(valid, elapsed_color(F.col("elapsed"), F.col("total_days"))).alias("color"),
    )


def is_rest_day(date: Column) -> Column:
    """Saturday or Sunday; public holidays come from a table."""
    return F.dayofweek(date).isin(1, 7)


def next_working_weekday(date: Column) -> Column:
    """The date itself, or the Monday behind it; public holidays aside."""
    return F.date_add(date, F.when(F.dayofweek(date) == 7, 2).when(F.dayofweek(date) == 1, 1).otherwise(0))


def holiday_runs(holidays: DataFrame) -> DataFrame:
    """``date, work_date`` for each rest day in a run of rest days that holds one of ``holidays(date)``.

    A run can only touch the weekends of a holiday's own week and of the week before, so the days
    looked at are the holidays and those weekends: at most the days of the calendar, however many
    terms ask. They are numbered in order; days of a run have the same distance to their number.
    """
    monday = F.date_trunc("week", "date").cast("date")
    near = F.array(F.col("date"), *[F.date_add(monday, n) for n in (-2, -1, 5, 6)])
    days = holidays.where("date IS NOT NULL").select(F.col("date").cast("date").alias("date")).distinct()
    days = days.select(F.explode(near).alias("date")).distinct()
    numbered = days.withColumn("run", F.date_sub("date", F.row_number().over(Window.orderBy("date"))))
    runs = numbered.groupBy("run").agg(F.sort_array(F.collect_list("date")).alias("dates"), F.date_add(F.max("date"), 1).alias("work_date"))
    return runs.select(F.explode("dates").alias("date"), "work_date")


def rest_days(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Rows of ``dates(date, ...)`` that fall on a weekend or one of ``holidays(date)``."""
    off = holidays.select(F.col("date").cast("date").alias("date")).distinct().withColumn("_off", F.lit(True))
    marked = dates.join(broadcast_if_small(off), "date", "left")
    return marked.where(is_rest_day(F.col("date")) | F.col("_off").isNotNull()).select(*dates.columns)


def procedural_terms(terms: DataFrame, holidays: DataFrame) -> DataFrame:
    """Evaluate ``terms(term_id, start_date, years, months, days)``: calendar end, end moved to
    the next working day, and whether it moved. Weekends are arithmetic; only runs of rest days with one of
    ``holidays(date)`` are looked up, behind a size check. Any year will do. A term without an end is an error."""
    placed = terms.withColumn("calendar_end", procedural_end())
    runs = holiday_runs(holidays).withColumnRenamed("date", "calendar_end")
    joined = placed.join(broadcast_if_small(runs), "calendar_end", "left").withColumn(
        "work_date", F.coalesce("work_date", next_working_weekday(F.col("calendar_end")))
    )
    return joined.select(
        "term_id",
        "calendar_end",
        F.col("work_date").alias("end_date"),
        (F.col("work_date") != F.col("calendar_end")).alias("moved"),
        F.when(F.col("work_date").isNull(), F.lit("no end date")).alias("error"),
    )


def procedural_end() -> Column:
    """Calendar end of a term with ``start_date, years, months, days``."""
    return add_period(F.col("start_date"), F.col("years"), F.col("months"), F.col("days"))


def custody_terms(terms: DataFrame, yellow_hours: float, red_hours: float) -> DataFrame:
    """Evaluate ``terms(term_id, start_time, hours, as_of)``: end, hours left, colour. Never moved
    for rest days; the thresholds (hours left) are the caller's."""
    end = F.col("start_time") + F.make_dt_interval(hours=F.col("hours"))
    left = (F.unix_timestamp("end_time") - F.unix_timestamp("as_of")) / 3600.0
    return terms.withColumn("end_time", end).withColumn("hours_left", F.greatest(left, F.lit(0.0))).select(
        "term_id",
        "end_time",
        "hours_left",
        F.when(F.col("hours_left") <= red_hours, F.lit("red"))
        .when(F.col("hours_left") <= yellow_hours, F.lit("yellow"))
        .otherwise(F.lit("normal"))
        .alias("color"),
    )
