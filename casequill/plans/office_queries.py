"""Registered queries over files, pages, loans, fees, terms and the case register."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.functions import dates
from casequill.operators import deadlines, fees, loans, names, pages, register
from casequill.operators.staging import stage
from casequill.plans import inputs
from casequill.sources import files

AS_OF = datetime.date(1999, 6, 1)
MOMENT = datetime.datetime(2024, 1, 15)
STAMP = "01/01/2026 00:00:00"


def long(column, name):
    return F.col(column).cast("bigint").alias(name)


# --- files -------------------------------------------------------------------------------


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.visible_files(files.describe_paths(inputs.title_files(spark, sf_dir)))


def bad_names(spark, sf_dir):
    found = names.problem_files(_titles(spark, sf_dir))
    return found.select("path", "folder", "stem", "suffix", F.array_join("reasons", "; ").alias("reasons"))


def clean_names(spark, sf_dir):
    return names.proposals(_titles(spark, sf_dir)).select("path", "name", "target")


def _part_plan(spark, sf_dir):
    listed = inputs.part_files(spark, sf_dir)
    # typed names for some files, given by path
    overrides = listed.where(F.contains("path", F.lit("!@"))).select(
        "path", F.when(F.contains("path", F.lit("#")), F.lit(" ")).otherwise(F.lit(" Hồ sơ.docx ")).alias("new_name")
    )
    return listed, names.rename_plan(listed, overrides)


def rename_plan(spark, sf_dir):
    return _part_plan(spark, sf_dir)[1].select("path", "folder", "old_name", "new_name", "new_path", "custom", "status")


def rename_totals(spark, sf_dir):
    listed, plan = _part_plan(spark, sf_dir)
    return names.plan_totals(listed, plan)


def files_per_folder(spark, sf_dir):
    return names.files_per_folder(_part_plan(spark, sf_dir)[1])


def rename_report(spark, sf_dir):
    plan = names.rename_plan(inputs.title_files(spark, sf_dir).select("path"))
    return names.report_lines(plan).select("folder", "old_name", F.substring_index("block", "\n", 1).alias("head"))


def preview_classes(spark, sf_dir):
    by_table = files.classify_by_table(_titles(spark, sf_dir), files.extension_table(spark))
    same = by_table.withColumn("again", files.preview_class(F.col("suffix")))
    return same.groupBy("folder", "preview", "again").agg(F.count("*").alias("files"))


def admitted_files(spark, sf_dir):
    described = _titles(spark, sf_dir).select("doc_id", "path", "name", F.col("n_chars").alias("length"))
    return files.admit(described, [".docx", ".pdf", ".txt"], 3000).select("doc_id", "name", "reject_reason")


def distinct_uploads(spark, sf_dir):
    title = F.substring_index("text", "\n", 1)
    listed = inputs.table(spark, sf_dir, "documents").select(
        title.alias("name"), F.col("n_chars").alias("length"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path")
    )
    return files.distinct_uploads(listed)


def unlabelled_documents(spark, sf_dir):
    return files.missing_members(inputs.table(spark, sf_dir, "documents"), inputs.table(spark, sf_dir, "labels"), "doc_id")


# --- pages -------------------------------------------------------------------------------


def _stamped(spark, sf_dir, fmt):
    built = pages.assemble(inputs.conversation_pages(spark, sf_dir), fmt, STAMP)
    name = pages.output_name(F.concat(F.lit("hs-"), F.col("doc_id").cast("string")), "20260101_000000", fmt)
    return built.select("doc_id", "part_no", name.alias("file_name"), "text")


def markdown_documents(spark, sf_dir):
    return _stamped(spark, sf_dir, "md")


def text_documents(spark, sf_dir):
    return _stamped(spark, sf_dir, "txt")


def _inputs_of_batch(spark, sf_dir):
    convs = inputs.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    odd = F.col("conv_id") % 7 == 0
    return convs.select(
        F.col("conv_id").alias("doc_id"),
        F.concat(F.lit("hs-"), F.col("conv_id").cast("string"), F.when(odd, F.lit(".txt")).otherwise(F.lit(".pdf"))).alias("filename"),
        F.when(odd, F.lit("extension")).alias("error"),
    )


def document_results(spark, sf_dir):
    return pages.document_results(_inputs_of_batch(spark, sf_dir), inputs.conversation_pages(spark, sf_dir))


def batch_totals(spark, sf_dir):
    return pages.batch_totals(document_results(spark, sf_dir))


# --- loans -------------------------------------------------------------------------------


def _loan_tables(spark, sf_dir):
    ls = inputs.order_loans(spark, sf_dir)
    paid = inputs.line_payments(spark, sf_dir)
    # read three times: without that each branch reads, sums and joins all payments again
    return stage(inputs.covering_loans(ls, paid)), paid, inputs.order_rates(spark, sf_dir)


def _cents(amount):
    """Half-up to two places with plain double arithmetic, the same in every engine."""
    return F.floor(amount * 100 + 0.5) / 100


def _doubles(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def loan_segments(spark, sf_dir):
    segs = loans.segments(*_loan_tables(spark, sf_dir))
    interest = _cents(loans.interest_of(F.col("numerator"), F.col("day_basis")))
    return _doubles(
        segs.select("loan_id", "seg_start", "seg_end", long("days", "days"), "balance", "amount", "year_rate", "overdue", interest.alias("interest")),
        "balance", "amount", "year_rate",
    )


def loan_details(spark, sf_dir):
    merged = loans.merge_details(loans.segments(*_loan_tables(spark, sf_dir)))
    interest = _cents(loans.interest_of(F.col("numerator"), F.col("day_basis")))
    return _doubles(merged.select("loan_id", "seg_start", "seg_end", long("days", "days"), "amount", "year_rate", interest.alias("interest")), "amount", "year_rate")


def loan_matrix(spark, sf_dir):
    paid = inputs.line_payments(spark, sf_dir)
    # the operator reads each table once, so the covering loans needn't be written
    ls = inputs.covering_loans(inputs.order_loans(spark, sf_dir), paid)
    owed = loans.result_matrix(ls, paid, inputs.order_rates(spark, sf_dir))
    return owed.select("loan_id", *[_cents(F.col(c)).alias(c) for c in ("principal_left", "in_term_left", "overdue_left", "late_left", "total_left")])


def loan_waterfall(spark, sf_dir):
    ls, ps, rs = _loan_tables(spark, sf_dir)
    flow = loans.waterfall(loans.segments(ls, ps, rs), ps)
    return flow.select("loan_id", "seg_end", *[_cents(F.col(c)).alias(c) for c in ("accrued", "paid", "unpaid")])


def loan_input_checks(spark, sf_dir):
    """Payments outside their loan's period and rate periods that overlap, as counts per loan."""
    ls = inputs.order_loans(spark, sf_dir)
    bad = loans.invalid_payments(ls, inputs.line_payments(spark, sf_dir)).groupBy("loan_id").agg(F.count("*").alias("n"))
    shifted = inputs.order_rates(spark, sf_dir).withColumn("to_date", F.date_add("to_date", (F.col("loan_id") % 3).cast("int")))
    crossing = loans.overlapping_rates(shifted).groupBy("loan_id").agg(F.count("*").alias("n"))
    return bad.select("loan_id", F.lit("payment").alias("kind"), "n").unionByName(crossing.select("loan_id", F.lit("rate").alias("kind"), "n"))


# --- fees --------------------------------------------------------------------------------


def court_fees(spark, sf_dir):
    key = F.col("o_orderkey")
    claims = inputs.table(spark, sf_dir, "orders").select(
        key.alias("claim_id"),
        inputs.pick(("ds_co_gia_ngach", "kdtm_co_gia_ngach", "lao_dong_co_gia_ngach"), key).alias("fee_type"),
        (F.col("o_totalprice").cast(inputs.MONEY) * 10000).cast(inputs.MONEY).alias("value"),
        (key % 4 == 0).alias("discount"),
    )
    return _doubles(fees.fees(claims, fees.fee_schedule(spark)).select("claim_id", "fee", "fee_text", "reason"), "fee")


# --- terms -------------------------------------------------------------------------------


def detention_terms(spark, sf_dir):
    key = F.col("o_orderkey")
    terms = inputs.table(spark, sf_dir, "orders").select(
        key.alias("term_id"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        (key % 5).cast("int").alias("months"),
        (key % 31).cast("int").alias("days"),
        (F.col("o_custkey") % 9).cast("int").alias("held_days"),
        F.lit(AS_OF).alias("as_of"),
    )
    done = deadlines.detention_terms(terms)
    return done.withColumns({c: F.col(c).cast("bigint") for c in ("total_days", "left_months", "left_days", "elapsed", "remaining", "percent")})


def _holidays(dates: DataFrame) -> DataFrame:
    """New Year, two days around 1 May and 2 September of the years of ``dates(date)`` and the years after them."""
    years = dates.select(F.year("date").alias("y")).where("y IS NOT NULL").distinct()
    years = years.select(F.explode(F.array("y", F.col("y") + 1)).alias("y")).distinct()
    days = [(1, 1), (4, 30), (5, 1), (9, 2)]
    return years.select(F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in days])).alias("date"))


def procedural_terms(spark, sf_dir):
    key = F.col("o_orderkey")
    terms = inputs.table(spark, sf_dir, "orders").select(
        key.alias("term_id"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        (key % 2).cast("int").alias("years"),
        (key % 13).cast("int").alias("months"),
        (key % 29).cast("int").alias("days"),
    )
    done = deadlines.procedural_terms(terms, _holidays(terms.select(deadlines.procedural_end().alias("date"))))
    return done.select("term_id", "calendar_end", "end_date", "moved", "error", dates.weekday_name(F.col("end_date")).alias("weekday"))


def rest_day_orders(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return deadlines.rest_days(orders, _holidays(orders)).select("o_orderkey", "date")


def custody_terms(spark, sf_dir):
    terms = inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("term_id"),
        F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("start_time"),
        (F.col("event_id") % 3 * 120 + 72).cast("int").alias("hours"),
        F.lit(MOMENT).cast("timestamp").alias("as_of"),
    )
    done = deadlines.custody_terms(terms, yellow_hours=24, red_hours=6)
    return done.select("term_id", F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("end_time"), F.round("hours_left", 4).alias("hours_left"), "color")


def order_ages(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    period = dates.split_period(date, F.lit(datetime.date(2001, 12, 31)))
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        period["years"].cast("bigint").alias("years"),
        period["months"].cast("bigint").alias("months"),
        period["days"].cast("bigint").alias("days"),
        dates.format_date(date).alias("shown"),
        dates.weekday_name(date).alias("weekday"),
        dates.parse_date(dates.format_date(date)).alias("parsed"),
    )


# --- register ----------------------------------------------------------------------------


def _cases(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderpriority").alias("case_type"),
        (F.col("o_orderstatus") == "F").alias("closed"),
        F.col("o_totalprice").cast(inputs.MONEY).alias("value"),
        F.col("o_orderdate").cast("date").alias("filed_date"),
        F.array("c_name").alias("plaintiffs"),
        F.array("c_mktsegment", F.concat(F.lit("clerk of "), F.col("c_name"))).alias("defendants"),
    )


def case_parties(spark, sf_dir):
    parties = register.case_parties(_cases(spark, sf_dir), {"plaintiff": "plaintiffs", "defendant": "defendants"})
    return parties.select("case_id", "role", long("party_no", "party_no"), "party")


def case_statistics(spark, sf_dir):
    return _doubles(register.type_statistics(_cases(spark, sf_dir)), "total_value")


QUERIES = {
    f.__name__: f
    for f in (
        bad_names, clean_names, rename_plan, rename_totals, files_per_folder, rename_report, preview_classes,
        admitted_files, distinct_uploads, unlabelled_documents, markdown_documents, text_documents, document_results,
        batch_totals, loan_segments, loan_details, loan_matrix, loan_waterfall, loan_input_checks, court_fees,
        detention_terms, procedural_terms, rest_day_orders, custody_terms, order_ages, case_parties, case_statistics,
    )
}
