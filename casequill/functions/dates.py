"""Date functions as Column expressions. The day of reference is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casequill.sources.rules import WEEKDAYS


def parse_date(text: Column) -> Column:
    """ISO or dd/MM/yyyy text as a date, null when it is no date."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date"),
    )


def format_date(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def weekday_name(date: Column, names=WEEKDAYS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek(date))


def add_period(start: Column, years: Column, months: Column, days: Column) -> Column:
    """Calendar months first (month end is kept within the month), then days."""
    return F.date_add(F.add_months(start, years * 12 + months), days)


def due_date(start: Column, years: Column, months: Column, days: Column) -> Column:
    return add_period(start, years, months, days)


def inclusive_end(date: Column) -> Column:
    """The day after: an end for half-open periods that include ``date``."""
    return F.date_add(date, 1)


def split_period(start: Column, end: Column) -> Column:
    """``struct<years, months, days>`` of whole calendar months and the remaining days."""
    whole = F.floor(F.months_between(end, start)).cast("int")
    # a clamped month end can overshoot by one month
    months = F.when(F.add_months(start, whole) > end, whole - 1).otherwise(whole)
    return F.struct(
        F.floor(months / 12).cast("int").alias("years"),
        (months % 12).alias("months"),
        F.datediff(end, F.add_months(start, months)).alias("days"),
    )


def split_days(total: Column, days_per_month: int = 30) -> Column:
    """``struct<months, days>`` with months of 30 days."""
    return F.struct(
        F.floor(total / days_per_month).cast("int").alias("months"),
        (total % days_per_month).cast("int").alias("days"),
    )


def age(birth: Column, at: Column) -> Column:
    """``struct<years, months, days, hours, minutes>`` between two timestamps."""
    birth_day = F.to_date(birth)
    seconds_birth = F.unix_timestamp(birth) - F.unix_timestamp(birth_day.cast("timestamp"))
    seconds_at = F.unix_timestamp(at) - F.unix_timestamp(F.to_date(at).cast("timestamp"))
    borrowed = seconds_at < seconds_birth
    last_day = F.when(borrowed, F.date_sub(F.to_date(at), 1)).otherwise(F.to_date(at))
    rest = F.when(borrowed, seconds_at + 86400 - seconds_birth).otherwise(seconds_at - seconds_birth)
    period = split_period(birth_day, last_day)
    return F.struct(
        period["years"].alias("years"),
        period["months"].alias("months"),
        period["days"].alias("days"),
        F.floor(rest / 3600).cast("int").alias("hours"),
        F.floor((rest % 3600) / 60).cast("int").alias("minutes"),
    )
