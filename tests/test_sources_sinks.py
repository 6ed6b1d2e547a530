import datetime as dt
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casequill.functions.similarity import ratio_udf
from casequill.operators import names, pages, pii, sizing, spell, staging
from casequill.sources import documents, files, rules, sinks, tables


def test_sinks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b ,c"), (2, "CMND 123456789")], "doc_id long, text string")
    issues = spell.number_issues(spell.explode_rule_issues(documents.paragraphs(docs)))
    sinks.write_issues(issues, str(tmp_path / "i"))
    back = spark.read.parquet(str(tmp_path / "i"))
    assert back.count() == issues.count() == 2 and back.where("severity = 'style'").count() == 2
    sinks.write_entities(pii.detect(docs), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).collect()[0].value == "123456789"
    pgs = spark.createDataFrame([(1, i, "t", f"p{i}") for i in range(1, 41)], "doc_id long, page_no long, title string, text string")
    sinks.write_blocks(pages.document_blocks(pgs, "txt", "s"), str(tmp_path / "b"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert sum(v.startswith("=== Trang") for v in lines) == 40
    texts = pii.anonymise(docs).select("doc_id", "text", F.lit("anonymised").alias("mode"))
    sinks.write_texts(texts, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("mode = 'anonymised'").count() == 2
    plan = names.rename_plan(spark.createDataFrame([("z/é!.txt",), ("a/é!.txt",)], "path string"))
    sinks.write_plan(plan, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_report(names.report_lines(plan), str(tmp_path / "r"))
    heads = [r.value for r in spark.read.text(str(tmp_path / "r")).collect() if r.value.startswith("[")]
    assert sorted(heads) == ["[PROPOSED] a/é!.txt", "[PROPOSED] z/é!.txt"]


def test_payloads(spark):
    typed = names.parse_overrides(spark.createDataFrame([('{"a/b.txt": "c.txt"}',)], "payload string")).collect()
    assert [tuple(r) for r in typed] == [("a/b.txt", "c.txt")]
    ids = spell.parse_accepted(spark.createDataFrame([(1, '["issue-1", "issue-2", "issue-1"]')], "doc_id long, payload string"))
    assert ids.count() == 2
    assert sinks.as_json is not None and spark.range(1).select(sinks.as_json(F.lit(1).alias("a"))).collect()[0][0] == '{"a":1}'


def test_tables_and_rules(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,2026-01-02,10.50,1\n", encoding="utf-8")
    row = tables.read_table(spark, "payments", str(tmp_path / "p.csv"), "csv").collect()[0]
    assert row.date == dt.date(2026, 1, 2) and float(row.principal_paid) == 10.5
    assert rules.rule_table(spark, rules.PHRASE_ERRORS).count() == 29 and rules.rule_table(spark, rules.SURNAMES).count() == 25
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in files.missing_members(a, b, "k").collect()] == [1]


def test_size_checks_and_staging(spark):
    assert sizing.is_small(spark.range(5), 5) and not sizing.is_small(spark.range(6), 5)
    staged = staging.stage(spark.range(5).withColumn("x", F.array("id")))
    assert staged.count() == 5 and staged.schema["x"].dataType.simpleString() == "array<bigint>"


def test_output_names(spark):
    r = spark.range(1).select(
        pages.output_name(F.lit("a"), "20260101_000000", "md"), pages.review_name(F.lit("a"), "marked"), pages.review_name(F.lit("a"), "corrected")
    ).collect()[0]
    assert tuple(r) == ("a_OCR_20260101_000000.md", "a_BAN_RA_SOAT", "a_DA_SUA")


def test_ratio_equals_indexed_matcher(spark):
    """The short-word ratio gives the same value as the standard matcher."""
    pairs = []

    @settings(max_examples=400, derandomize=True, deadline=None)
    @given(st.text("abcđế", max_size=9), st.text("abcđế", max_size=9))
    def gather(a, b):
        pairs.append((a, b))

    gather()
    pairs += [("x" * 120, "x" * 119 + "y"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", ratio_udf()(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.r == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio(), abs=1e-12)


def test_word_bounds_never_exclude(spark):
    """Signature and edit bounds are necessary conditions of the ratio they stand for."""
    from casequill.functions.similarity import max_edits
    from casequill.sources.dictionary import letter_signature

    pairs = []

    @settings(max_examples=400, derandomize=True, deadline=None)
    @given(st.text("abcde", min_size=1, max_size=9), st.text("abcde", min_size=1, max_size=9))
    def gather(a, b):
        pairs.append((a, b, SequenceMatcher(None, a, b).ratio()))

    gather()
    df = spark.createDataFrame(pairs, "a string, b string, r double").where("r >= 0.67")
    limit = max_edits(F.length("a"), F.length("b"), 0.67)
    bits = F.bit_count(letter_signature(F.col("a")).bitwiseXOR(letter_signature(F.col("b"))))
    assert df.count() > 20 and df.where((bits > limit) | (F.levenshtein("a", "b") > limit)).count() == 0
