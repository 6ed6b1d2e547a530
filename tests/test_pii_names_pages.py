import pytest
from pyspark.sql import functions as F

from casequill.operators import names, pages, pii
from casequill.sources import files, rules
from casequill.streaming import drop_folder


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def found(spark, text):
    return [(r.type, r.value, r.suggestion) for r in pii.detect(texts(spark, [text])).orderBy("entity_no").collect()]


def test_heading_is_no_name(spark):
    assert found(spark, "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nVIỆN KIỂM SÁT NHÂN DÂN TỈNH") == []


def test_similar_names_stay_apart(spark):
    got = found(spark, "Ông Nguyễn Văn Anh và bà Trần Thị Bình có mặt. Nguyễn Văn An vắng mặt.")
    assert {v for _, v, _ in got} == {"Nguyễn Văn Anh", "Trần Thị Bình", "Nguyễn Văn An"}


def test_address_is_no_name(spark):
    got = found(spark, "Bị cáo Nguyễn Văn An, trú tại số 12, đường Lê Lợi, phường A, thành phố B.")
    assert got == [
        ("Địa chỉ", "số 12, đường Lê Lợi, phường A, thành phố B", "Địa chỉ [Đã ẩn]"),
        ("Tên", "Nguyễn Văn An", "Tên-A"),
    ]


def test_numbers_and_masks(spark):
    text = "ĐT 0912 345 678, +84 912345678; CCCD: 012345678901, CMND 123456789, 123456789, 12345678901234."
    got = found(spark, text)
    assert got == [
        ("SĐT", "0912 345 678", "0912xxxx678"), ("SĐT", "+84 912345678", "8491xxxx678"),
        ("CCCD", "012345678901", "012xxx901"), ("CMND", "912345678", "912xxx678"), ("CMND", "123456789", "123xxx789"),
    ]
    flagged = pii.flag_phone_overlap(pii.detect(texts(spark, [text]))).where("overlaps_phone").collect()
    assert [r.value for r in flagged] == ["912345678"]


def test_names_inside_longer_names_and_aliases(spark):
    people = "; ".join(f"ông Lê Văn {chr(65 + i)}{chr(97 + i)}x" for i in range(26)) + "; ông Lê Văn Zzz"
    got = [s for t, _, s in found(spark, people) if t == "Tên"]
    assert got[0] == "Tên-A" and got[25] == "Tên-Z" and got[26] == "Tên-27"
    assert [v for _, v, _ in found(spark, "Lê Minh gặp chị Lê Minh Hà, bà Lê Minh")] == ["Lê Minh Hà"]


def test_whole_word_replacement(spark):
    rows = [
        (0, "Mã AN123 và mã AN là hai giá trị.", [("AN", "")]),
        (1, "Ông Nguyễn Văn An quản lý Mã hồ sơ nội bộ XYZ.", [("Nguyễn Văn An", "Tên-A"), ("NGUYỄN VĂN AN", "x"), ("Mã hồ sơ nội bộ XYZ", r"[$1 \n]")]),
        (2, "x", [("", "y")]),
        (3, "x", [(f"k{i}", "y") for i in range(501)]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, items " + pii.REPLACEMENTS_TYPE)
    got = {r.doc_id: (r.text, r.replaced, r.reject_reason) for r in pii.replace_in_documents(df, df).collect()}
    assert got == {
        0: ("Mã AN123 và mã [Ẩn] là hai giá trị.", 1, None), 1: (r"Ông Tên-A quản lý [$1 \n].", 2, None),
        2: ("x", 0, "nothing selected"), 3: ("x", 0, "too many replacements"),
    }


def test_replacement_payloads(spark):
    df = spark.createDataFrame([('[{"old":"a","new":"b"}]',), ('{"a":"b"}',)], "p string")
    assert [[tuple(x) for x in r[0]] for r in df.select(pii.parse_replacements(F.col("p"))).collect()] == [[("a", "b")]] * 2
    items = pii.collect_items(spark.createDataFrame([(1, i, f"o{i}", "n") for i in range(600)], "doc_id long, seq int, old string, new string"))
    assert items.select(F.size("items")).collect()[0][0] == 501


def test_masking_twice_changes_nothing_more(spark):
    docs = texts(spark, ["Bà Trần Thị Bình, điện thoại 0912345678, CCCD 012345678901."])
    once = pii.anonymise(docs).select("doc_id", "text")
    again = pii.anonymise(once)
    assert again.collect()[0].text == once.collect()[0].text and "Bình" not in once.collect()[0].text


NAMES = {
    "Báo cáo tổng kết năm 2026!!.docx": "BC tong ket nam 2026.docx",
    "Quyết định  khởi tố.pdf": "Quyet đinh KTo.pdf",
    "chỉ thi hành -- x__y.txt": "chi TH - x_y.txt",
    "!!!.txt": "file.txt",
}


def test_clean_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "path string")
    plan = names.proposals(files.describe_paths(df))
    got = {r.name: r.target for r in plan.collect()}
    assert got == NAMES
    again = spark.createDataFrame([(v,) for v in NAMES.values()], "path string")
    stable = {r.name: r.target for r in names.proposals(files.describe_paths(again)).collect()}
    assert all("đ" in k for k in stable)
    mapped = names.proposals(files.describe_paths(df), map_dstroke=True)
    assert "QD KTo.pdf" in {r.target for r in mapped.collect()}


def test_long_names(spark):
    long = "a" * 70 + ".txt"
    dated = "b" * 50 + " ngay 12 thang 10 x.txt"
    row = {r.name: (r.target, r.reason) for r in names.proposals(files.describe_paths(spark.createDataFrame([(long,), (dated,)], "path string"))).collect()}
    assert row[long][0] == "a" * 58 + "...txt" and row[long][1] == "Ten qua dai (70 ky tu, toi da 60)"
    assert row[dated][0] == "b" * 50 + " x.txt"


def test_reasons(spark):
    df = spark.createDataFrame([("a  b__c#@!é?x*y",)], "s string")
    assert df.select(names.name_reasons(F.col("s"))).collect()[0][0] == [
        "Ten co chua tieng Viet co dau", "Ten chua ky tu dac biet: #@!, ?, *",
        "Ten co nhieu khoang trang lien tiep", "Ten co nhieu dau gach duoi lien tiep",
    ]


def test_conflicts_overrides_and_totals(spark):
    paths = ["d/a!.txt", "d/a#.txt", "d/a%.txt", "d/a.txt", "d/a_2.txt", "e/a!.txt", "x!.md", "d/.hid!.txt", ".git/a!.txt", "ok.txt"]
    paths.append("keep!.txt")
    inventory = spark.createDataFrame([(p,) for p in paths], "path string")
    overrides = spark.createDataFrame(
        [("x!.md", " Hồ sơ.md "), ("e/a!.txt", "  "), ("keep!.txt", "keep!.txt")], "path string, new_name string"
    )
    plan = names.rename_plan(inventory, overrides)
    got = {r.path: r.new_path for r in plan.collect()}
    assert got == {"d/a!.txt": "d/a_1.txt", "d/a#.txt": "d/a_3.txt", "d/a%.txt": "d/a_4.txt", "e/a!.txt": "e/a.txt", "x!.md": "Hồ sơ.md"}
    t = names.plan_totals(inventory, plan).collect()[0]
    assert (t.total_scanned, t.total_problematic, t.total_proposed, t.total_errors, t.custom_used, t.total_unchanged) == (9, 6, 5, 0, 1, 1)
    assert {(r.folder, r.files) for r in names.files_per_folder(plan).collect()} == {("d", 3), ("e", 1), ("(Thư mục gốc)", 1)}
    assert names.report_lines(plan).count() == 5


def test_crowded_name(spark):
    marks = "!#%@*^~$"
    stems = [a + b + c for a in marks for b in marks for c in marks][:130]
    inventory = spark.createDataFrame([(f"d/f{s}.txt",) for s in stems] + [("d/f.txt",)], "path string")
    plan = names.rename_plan(inventory, max_tries=rules.MAX_SUFFIX_TRIES).collect()
    good = [r.new_name for r in plan if r.status == "PROPOSED"]
    assert len(plan) == 130 and len(good) == len(set(good)) == 99
    assert all(r.error == rules.ERROR_NO_FREE_NAME for r in plan if r.status == "ERROR")
    unbounded = names.rename_plan(inventory).collect()
    assert sorted(r.new_name for r in unbounded) == sorted(f"f_{n}.txt" for n in range(1, 131))


def test_admission_and_classes(spark):
    df = spark.createDataFrame([("a.DOCX", 10), ("b.txt", 10), ("c.docx", 60), (" ", 1)], "name string, length long")
    got = {r.name: r.reject_reason for r in files.admit(df, [".docx"], 50).collect()}
    assert got == {"a.DOCX": None, "b.txt": "extension", "c.docx": "size", " ": "empty name"}
    ext = spark.createDataFrame([(".TXT",), (".png",), (".zip",)], "suffix string")
    assert [r.preview for r in files.classify_by_table(ext, files.extension_table(spark)).orderBy("suffix").collect()] == ["text", "image", "external"]
    assert [r[0] for r in ext.orderBy("suffix").select(files.preview_class(F.col("suffix"))).collect()] == ["text", "image", "external"]


def test_file_listing(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("yy")
    listed = {r.path: r.length for r in files.list_files(spark, str(tmp_path)).collect()}
    assert {k.replace("%20", " "): v for k, v in listed.items()} == {"sub dir/a.txt": 1, "b.txt": 2}


@pytest.mark.parametrize("per_part", [1000, 2])
def test_page_documents(spark, per_part):
    rows = [(1, i + 1, "Hồ sơ", t) for i, t in enumerate([" Nội dung \n", " \n ", "c"])]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, title string, text string")
    text = "".join(r.text for r in pages.assemble(df, "txt", "01/01/2026 00:00:00", per_part).orderBy("part_no").collect())
    line = "\n" + "-" * 40 + "\n\n"
    assert text == (
        "KET QUA OCR - Hồ sơ\nNgay tao: 01/01/2026 00:00:00\n" + "=" * 60 + "\n\n"
        + "=== Trang 1 ===\n\nNội dung\n" + line + "=== Trang 2 ===\n\n[Khong nhan dang duoc van ban]\n" + line
        + "=== Trang 3 ===\n\nc\n" + line + "Tong so trang: 3\n"
    )
    md = "".join(r.text for r in pages.assemble(df, "md", "s", per_part).orderBy("part_no").collect())
    assert md.startswith("# Kết quả OCR - Hồ sơ\n\n> Ngày tạo: s\n\n---\n\n## Trang 1\n\nNội dung\n\n\n") and md.endswith("---\n\n*Tổng số trang: 3*\n")


def test_batch_accounting(spark):
    inputs = spark.createDataFrame([(1, "a.pdf", None), (2, "b.txt", "extension"), (3, "c.pdf", None)], "doc_id long, filename string, error string")
    pgs = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "doc_id long, page_no int")
    res = pages.document_results(inputs, pgs)
    t = pages.batch_totals(res).collect()[0]
    assert (t.total_files, t.processed, t.errors, t.total_pages) == (3, 2, 1, 3)
    assert [r.filename for r in pages.failed(res).collect()] == ["b.txt"]


def test_stream_equals_batch(spark, tmp_path):
    docs = texts(spark, ["Ông Nguyễn Văn An", "không có", "CMND 123456789"])
    landing, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    docs.repartition(3).write.parquet(landing)
    stream = drop_folder.read_folder(spark, landing, "doc_id long, text string")
    drop_folder.run_available(pii.detect(stream), out, cp).awaitTermination()
    batch = {tuple(r) for r in pii.detect(docs).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == batch and len(batch) == 2
    seen = []
    drop_folder.run_batches(
        drop_folder.read_folder(spark, landing, "doc_id long, text string"), lambda df, i: seen.append(df.count()), str(tmp_path / "cp2")
    ).awaitTermination()
    assert sum(seen) == 3
