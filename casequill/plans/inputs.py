"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.functions.text import evaluate_once
from casequill.sources import rules
from casequill.sources.dictionary import lookup_table, words_of
from casequill.sources.documents import paragraphs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def document_paragraphs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return paragraphs(documents(spark, sf_dir, *keep), *keep)


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark texts as the dictionary of known words."""
    return words_of(table(spark, sf_dir, "benchmark"))


def benchmark_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_table(benchmark_words(spark, sf_dir))


#: wrong phrases of the test languages, with a correction each
TEST_PHRASES = {
    "of the": "of this",
    "in with": "within",
    "le la": "la",
    "que un": "qu'un",
    "der die": "die",
    "por los": "por las",
}

MIDDLE_NAMES = ("Văn", "Thị", "Hữu", "Đức", "Ngọc", "Quang", "Thu")
GIVEN_NAMES = ("An", "Bình", "Chi", "Dũng", "Giang", "Hà", "Khánh", "Linh", "Minh", "Nga", "Phúc", "Sơn", "Tuấn")
STREETS = ("Trường Chinh", "Hai Bà Trưng", "Điện Biên Phủ", "Quang Trung")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a narrow table dealt to all tasks by key. Such a table is a few megabytes even with millions of rows,
    so it is read by a task or two, which would then do all the work on the texts made of it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def case_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short Vietnamese note per customer, with a person, a witness, numbers and an address."""
    key = F.col("c_custkey")
    person = F.concat_ws(
        " ", pick(rules.SURNAMES, key), pick(MIDDLE_NAMES, key), pick(GIVEN_NAMES, F.floor(key / 7))
    )
    witness = F.concat_ws(" ", pick(rules.SURNAMES, F.floor(key / 3) + 11), pick(GIVEN_NAMES, key + 5))
    cast = key.cast("string")
    text = F.concat(
        F.lit("Bị cáo "), person,
        F.lit(", CCCD: 0"), F.lpad(cast, 11, "1"),
        F.lit("; điện thoại: 09"), F.lpad(cast, 8, "2"),
        F.lit(".\nĐịa chỉ: số "), (key % 300 + 1).cast("string"), F.lit(", đường "), pick(STREETS, key),
        F.lit(", phường "), (F.col("c_nationkey") + 1).cast("string"),
        F.lit("\nNgười làm chứng "), witness, F.lit(" khai đã gặp bà "), person, F.lit(" tại tòa án."),
    )
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return customers.select(key.alias("doc_id"), text.alias("text"))


def title_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file path per document: its source as folder, the first line of its text as name."""
    suffixes = (".docx", ".PDF", ".txt", ".md", ".zip", ".png")
    title = F.translate(F.substring_index("text", "\n", 1), "/.", "--")
    path = F.concat(
        "source", F.lit("/"), title, F.lit(" "), F.col("doc_id").cast("string"), pick(suffixes, F.col("doc_id"))
    )
    # a path is a stored column in an inventory; here it is computed once per row
    named = evaluate_once(table(spark, sf_dir, "documents"), "path", path)
    return named.select("doc_id", "path", "n_chars")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per part type; many reduce to the same clean name, and some clean names exist."""
    part = table(spark, sf_dir, "part")
    marks = F.translate(F.col("p_partkey").cast("string"), "0123456789", "!@#$%^*=~?")
    odd = evaluate_once(part, "path", F.concat("p_type", F.lit("/"), "p_name", marks, F.lit(".docx"))).select("path")
    taken = part.groupBy("p_type", "p_name").agg(F.min("p_size").alias("size")).select(
        F.concat(
            "p_type", F.lit("/"), "p_name",
            F.when(F.col("size") % 2 == 0, F.lit("_2")).otherwise(F.lit("")), F.lit(".docx"),
        ).alias("path")
    )
    return odd.unionByName(taken)


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).alias("page_no"),
        F.concat(F.lit("hs-"), F.col("conv_id").cast("string")).alias("title"),
        "text",
    )


MONEY = "decimal(20,2)"


def order_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loans: dates moved by 20 years so that terms cross the change of day count."""
    key = F.col("o_orderkey")
    start = F.add_months(F.col("o_orderdate").cast("date"), 240)
    monthly = key % 5 == 0
    return table(spark, sf_dir, "orders").select(
        key.alias("loan_id"),
        F.col("o_totalprice").cast(MONEY).alias("principal"),
        F.when(monthly, F.lit(1.25)).otherwise((key % 9).cast("double") + 6.5).alias("rate"),
        F.when(monthly, F.lit("thang")).otherwise(F.lit("nam")).alias("rate_unit"),
        F.when(key % 4 == 0, F.lit(15.25)).alias("overdue_rate"),
        F.when(key % 3 == 0, F.lit("goc_ban_dau_co_dinh")).otherwise(F.lit("du_no_thuc_te")).alias("basis"),
        F.lit(0).alias("term_years"),
        (F.col("o_custkey") % 24 + 1).cast("int").alias("term_months"),
        (key % 30).cast("int").alias("term_days"),
        start.alias("start_date"),
        F.date_add(start, ((key % 40) * 30 + 100).cast("int")).alias("settle_date"),
    )


def line_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payments, on their shipping date moved by 20 years."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("loan_id"),
        F.add_months(F.col("l_shipdate").cast("date"), 240).alias("date"),
        (F.col("l_quantity") * 10).cast(MONEY).alias("principal_paid"),
        (F.col("l_quantity") * 3).cast(MONEY).alias("interest_paid"),
    )


def covering_loans(loans: DataFrame, payments: DataFrame) -> DataFrame:
    """Loans that start by their first payment and are not settled before their last one."""
    paid = payments.groupBy("loan_id").agg(F.min("date").alias("first_paid"), F.max("date").alias("last_paid"))
    return (
        loans.join(paid, "loan_id", "left")
        .withColumn("start_date", F.least("start_date", "first_paid"))
        .withColumn("settle_date", F.greatest("settle_date", "last_paid"))
        .drop("first_paid", "last_paid")
    )


def order_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rate periods for every other loan."""
    start = F.add_months(F.col("o_orderdate").cast("date"), 240)
    periods = F.array(
        F.struct(F.lit(12.5).alias("rate"), F.lit("nam").alias("unit"), F.date_add(start, 10).alias("from_date"), F.date_add(start, 40).alias("to_date")),
        F.struct(F.lit(1.5).alias("rate"), F.lit("thang").alias("unit"), F.date_add(start, 41).alias("from_date"), F.date_add(start, 60).alias("to_date")),
    )
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderkey") % 2 == 0)
        .select(F.col("o_orderkey").alias("loan_id"), F.explode(periods).alias("p"))
        .select("loan_id", "p.rate", "p.unit", "p.from_date", "p.to_date")
    )


def guarded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per part that mixes checked words with a link, an e-mail address, a document number, a
    person, units and a wrong phrase. The letters of ``w`` spell the key."""
    key = F.col("p_partkey").cast("string")
    w = F.concat(F.lit("zq"), F.translate(key, "0123456789", "bcdfghjklm"))
    text = F.concat(
        F.lit("Xem "), w, F.lit(" https://tòa.vn/"), w, F.lit("/x và "), w, F.lit(".q@vn.example.org nhé "), w, F.lit(" 12/2020/"), w,
        F.lit(" TANDTC nặng "), key, F.lit(" kg hay kg "), w, F.lit(" bị cáo Nguyễn Văn Zung of the "), w, F.lit("."),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def misspelt_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per part with a word of a benchmark text, written with a letter left out or doubled, in
    small letters and with a capital."""
    benchmark = table(spark, sf_dir, "benchmark")
    words = benchmark.select("item_id", F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0)).alias("words")).where(F.size("words") > 0)
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(key, (key % benchmark.count()).alias("item_id"))
    word = F.get("words", (F.floor(key / 7) % F.size("words")).cast("int"))
    wrong = parts.join(words, "item_id").select(
        key.alias("doc_id"), F.when(key % 2 == 0, F.concat(F.left(word, F.lit(1)), F.substring(word, 3, 100))).otherwise(F.concat(word, F.right(word, F.lit(1)))).alias("w")
    )
    # after the join, which deals the parts by benchmark text
    return spread(wrong, "doc_id").select("doc_id", F.concat(F.lit("12 "), "w", F.lit(" 34 "), F.initcap("w"), F.lit(".")).alias("text"))
