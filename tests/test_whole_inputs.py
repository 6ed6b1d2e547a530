"""Cuts that must not lose or spoil anything."""

from pyspark.sql import functions as F

from casequill.operators import fees, pages, sizing
from casequill.plans import inputs
from casequill.sources import documents


def _files(spark, *contents):
    rows = [(str(i), len(c), bytearray(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "path string, length int, content binary")


def test_whole_files_by_default_and_cuts_at_characters(spark):
    text = "aé漢𝄞" * 1000
    files = _files(spark, text.encode(), text.encode("utf-16"), b"short")
    got = {r.path: (r.text, r.truncated) for r in documents.text_files(files).collect()}
    assert got == {"0": (text, False), "1": (text, False), "2": ("short", False)}
    for limit in range(20, 31):
        row = {r.path: r for r in documents.text_files(files, max_bytes=limit).collect()}
        assert text.startswith(row["0"].text) and row["0"].truncated and len(row["0"].text.encode()) > limit - 4
        assert row["2"].text == "short" and not row["2"].truncated
    shown = documents.text_files(files, max_chars=3).orderBy("path").collect()
    assert [(r.text, r.truncated) for r in shown] == [("aé漢", True), ("aé漢", True), ("sho", True)]


def test_document_without_its_first_page(spark):
    rows = spark.createDataFrame([(1, 2, "hs", "b"), (1, 3, "hs", "c")], "doc_id long, page_no long, title string, text string")
    blocks = {r.block_no: r.block for r in pages.document_blocks(rows, "md", "s").collect()}
    assert sorted(blocks) == [0, 2, 3, 4] and "hs" in blocks[0] and "## Trang 3" in blocks[3]


def test_value_zero_has_a_fee(spark):
    claims = spark.createDataFrame([(1, "ds_co_gia_ngach", 0, False)], "claim_id long, fee_type string, value int, discount boolean")
    claims = claims.withColumn("value", F.col("value").cast("decimal(20,2)"))
    assert [(float(r.fee), r.reason) for r in fees.fees(claims, fees.fee_schedule(spark)).collect()] == [(300_000.0, None)]


def test_running_total_of_hot_and_small_groups(spark):
    rows = [("hot", i) for i in range(500)] + [(f"g{i}", 7) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(5)
    got = {(r.g, r.x): r.total for r in sizing.running_total(df, ["g"], ["x"], F.col("x"), "total").collect()}
    assert got == {(g, x): x * (x + 1) // 2 if g == "hot" else 7 for g, x in rows}


def test_byte_bound(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert sizing.is_small(wide, max_bytes=20_000) and not sizing.is_small(wide, max_bytes=5_000)


def test_texts_made_of_a_narrow_table_are_dealt_to_all_tasks(spark):
    """The tables are one small file each, so without that one task makes and reads all texts."""
    for made in (inputs.case_notes, inputs.guarded_notes, inputs.misspelt_notes):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
