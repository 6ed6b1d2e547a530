import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from casequill.functions import dates
from casequill.operators import deadlines as DL
from casequill.operators import fees, register

D = dt.date.fromisoformat
M = 1_000_000

CASES = [
    ("ds_co_gia_ngach", 6 * M, False, 300_000), ("ds_co_gia_ngach", 400 * M, False, 20 * M),
    ("ds_co_gia_ngach", 800 * M, False, 36 * M), ("ds_co_gia_ngach", 2000 * M, False, 72 * M),
    ("ds_co_gia_ngach", 4000 * M, False, 112 * M), ("ds_co_gia_ngach", 5000 * M, False, 113 * M),
    ("kdtm_co_gia_ngach", 60 * M, False, 3 * M), ("kdtm_co_gia_ngach", 1 * M, False, 3 * M),
    ("kdtm_co_gia_ngach", 10 * M, False, 3 * M), ("kdtm_co_gia_ngach", 61 * M, False, 3_050_000),
    ("kdtm_co_gia_ngach", 400 * M, False, 20 * M), ("lao_dong_co_gia_ngach", 6 * M, False, 300_000),
    ("lao_dong_co_gia_ngach", 400 * M, False, 12 * M), ("lao_dong_co_gia_ngach", 2000 * M, False, 44 * M),
    ("ds_co_gia_ngach", 800 * M, True, 18 * M),
]


def test_fee_cases(spark):
    rows = [(i, t, Decimal(v), d, e) for i, (t, v, d, e) in enumerate(CASES)]
    claims = spark.createDataFrame(rows, "claim_id long, fee_type string, value decimal(20,2), discount boolean, expected long")
    got = fees.fees(claims, fees.fee_schedule(spark)).collect()
    assert len(got) == 15
    for r in got:
        assert r.fee == r.expected and r.reason is None
        assert int(r.fee_text.replace(".", "")) == r.expected


def test_fee_without_bracket(spark):
    claims = spark.createDataFrame([(1, "kdtm_co_gia_ngach", Decimal(500 * M), False)], "claim_id long, fee_type string, value decimal(20,2), discount boolean")
    row = fees.fees(claims, fees.fee_schedule(spark)).collect()[0]
    assert row.fee is None and row.reason == "no bracket"


def test_detention(spark):
    rows = [
        ("2025-03-04", 2, 0, 3, "2025-04-29"), ("2025-04-11", 2, 0, 6, "2025-06-03"),
        # two months are 60 days, and the start day counts
        ("2026-07-01", 2, 0, 0, "2026-08-29"), ("2026-07-01", 0, 5, 0, "2026-07-05"),
    ]
    terms = spark.createDataFrame(
        [(i, D(s), m, d, h, D(s), e) for i, (s, m, d, h, e) in enumerate(rows)],
        "term_id long, start_date date, months int, days int, held_days int, as_of date, expected string",
    )
    got = {r.term_id: r for r in DL.detention_terms(terms).collect()}
    for i, row in enumerate(rows):
        assert str(got[i].end_date) == row[4]
    assert (got[0].left_months, got[0].left_days) == (1, 27)
    assert (got[1].left_months, got[1].left_days) == (1, 24)
    assert got[0].level == "safe" and got[3].level == "caution" and got[3].remaining == 5


def test_refused_terms(spark):
    terms = spark.createDataFrame(
        [(1, D("2026-07-01"), 0, 0, 0, D("2026-07-01")), (2, D("2026-07-01"), 0, 3, 3, D("2026-07-01")), (3, None, 1, 0, 0, D("2026-07-01"))],
        "term_id long, start_date date, months int, days int, held_days int, as_of date",
    )
    assert {r.term_id: r.error for r in DL.detention_terms(terms).collect()} == {
        1: "no term", 2: "nothing left", 3: "invalid date",
    }


def test_warning_levels(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 3, 4, 10, 11)], "r int")
    assert [r[0] for r in df.select(DL.warning_level(F.col("r"))).collect()] == [
        "expired", "danger", "danger", "caution", "caution", "safe",
    ]


def test_procedural_roll(spark):
    holidays = spark.createDataFrame([(D("2026-12-31"),), (D("2027-01-01"),)], "date date")
    terms = spark.createDataFrame(
        [(1, D("2026-07-01"), 0, 0, 1), (2, D("2026-07-01"), 0, 0, 4), (3, D("2026-12-30"), 0, 0, 1), (4, D("2030-01-01"), 0, 0, 1), (5, None, 0, 0, 1)],
        "term_id long, start_date date, years int, months int, days int",
    )
    got = {r.term_id: r for r in DL.procedural_terms(terms, holidays).collect()}
    assert str(got[1].end_date) == "2026-07-02" and not got[1].moved
    assert str(got[2].end_date) == "2026-07-06" and got[2].moved
    assert str(got[3].end_date) == "2027-01-04"
    assert str(got[4].end_date) == "2030-01-02" and got[4].error is None  # any year
    assert got[5].end_date is None and got[5].error == "no end date"
    days = spark.createDataFrame([(D("2026-07-04"),), (D("2026-07-06"),), (D("2027-01-01"),)], "date date")
    assert DL.rest_days(days, holidays).count() == 2


def test_working_days_match_a_walk(spark):
    """Holidays next to weekends, over New Year, in a run of weeks, repeated, null, and none at all."""
    rng = random.Random(5)
    days = [D("2024-12-20") + dt.timedelta(n) for n in range(60)]
    listed = [d for d in days if rng.random() < 0.35] + [D("2031-05-02") + dt.timedelta(n) for n in range(40)]
    asked = [*days, *[D("2031-04-25") + dt.timedelta(n) for n in range(60)], D("1890-03-01"), D("2400-02-26")]
    terms = spark.createDataFrame([(i, d, 0, 0, 0) for i, d in enumerate(asked)], "term_id long, start_date date, years int, months int, days int")
    for off in (listed, []):
        got = DL.procedural_terms(terms, spark.createDataFrame([(d,) for d in [*off, *off, None]], "date date")).collect()
        assert len(got) == len(asked)
        for r in got:
            day = asked[r.term_id]
            while day.weekday() >= 5 or day in off:
                day += dt.timedelta(1)
            assert (r.calendar_end, r.end_date, r.moved) == (asked[r.term_id], day, day != asked[r.term_id])


def test_custody(spark):
    t = dt.datetime(2026, 7, 1, 10)
    terms = spark.createDataFrame([(1, t, 72, t + dt.timedelta(hours=50)), (2, t, 72, t + dt.timedelta(hours=71))], "term_id long, start_time timestamp, hours int, as_of timestamp")
    got = {r.term_id: r for r in DL.custody_terms(terms, yellow_hours=24, red_hours=6).collect()}
    assert got[1].color == "yellow" and got[1].hours_left == 22 and got[2].color == "red"


def test_date_helpers(spark):
    df = spark.createDataFrame([("2025-10-10", "31/12/2025", "x")], "a string, b string, c string")
    r = df.select(
        dates.parse_date(F.col("a")).alias("a"), dates.parse_date(F.col("b")).alias("b"), dates.parse_date(F.col("c")).alias("c"),
        dates.due_date(dates.parse_date(F.col("a")), F.lit(0), F.lit(7), F.lit(5)).alias("due"),
        dates.weekday_name(dates.parse_date(F.col("a"))).alias("day"),
        dates.split_period(F.lit(D("2025-01-31")), F.lit(D("2026-03-01"))).alias("p"),
        dates.age(F.lit("2000-05-10 10:00:00").cast("timestamp"), F.lit("2026-05-10 09:30:00").cast("timestamp")).alias("age"),
    ).collect()[0]
    assert str(r.due) == "2026-05-15" and r.c is None and str(r.b) == "2025-12-31" and r.day == "Thứ sáu"
    assert tuple(r.p) == (1, 1, 1)
    assert tuple(r.age) == (25, 11, 29, 23, 30)


def test_register(spark):
    cases = spark.createDataFrame(
        [(1, "civil", ["A", "B"], ["C"], True, 5.0, D("2026-01-01")), (2, "civil", [], ["D"], False, 7.0, D("2026-02-01"))],
        "case_id long, case_type string, plaintiffs array<string>, defendants array<string>, closed boolean, value double, filed_date date",
    )
    parties = register.case_parties(cases, {"plaintiff": "plaintiffs", "defendant": "defendants"})
    assert parties.count() == 4
    stats = register.type_statistics(cases).collect()[0]
    assert (stats.cases, stats.closed_cases, stats.total_value) == (2, 1, 12.0)
