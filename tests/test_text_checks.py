import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from casequill.functions import spans as SP
from casequill.functions import text as TX
from casequill.operators import spell, word_index
from casequill.sources import dictionary as DI
from casequill.sources import documents as DOC
from casequill.sources import rules

# fixed values: labelled sentences, the target is what an issue must contain
ERROR_CASES = [
    ("Viện kiểm xát nhân dân", "kiểm xát"), ("Kiểm xát viên nghiên cứu hồ sơ.", "Kiểm xát"),
    ("Quyết định khỏi tố bị can.", "khỏi tố"), ("Bị cao Nguyễn Văn A khai nhận.", "Bị cao"),
    ("Cơ quan điều tra đề nghị truy té.", "truy té"), ("Ban hành cáo chạng số 12.", "cáo chạng"),
    ("Thời hạn tạm dữ là ba ngày.", "tạm dữ"), ("Thẩm quyển giải quyết thuộc Tòa án.", "Thẩm quyển"),
    ("Kết luận điểu tra vụ án.", "điểu tra"), ("Xác định trách nhiêm hình sự.", "trách nhiêm"),
    ("Thực hiện đúng quy định pháp luât.", "pháp luât"), ("Danh mục vật chứn kèm theo.", "vật chứn"),
    ("Tài liệu tại bút lụt số 15.", "bút lụt"), ("Lập biên bãn giao nhận.", "biên bãn"),
    ("Quyền của đương sư được bảo đảm.", "đương sư"), ("Công tác thi hành áng dân sự.", "thi hành áng"),
    ("Viện kiểm sát  nhân dân.", "  "), ("Nội dung ,tài liệu kèm theo.", " ,"),
]
# fixed values: labelled sentences without an issue
CLEAN_CASES = [
    "Viện kiểm sát nhân dân ban hành quyết định khởi tố bị can.", "Kiểm sát viên nghiên cứu hồ sơ vụ án.",
    "Bị cáo Nguyễn Văn A trình bày tại phiên tòa.", "Cơ quan điều tra đã chuyển kết luận điều tra.",
    "Thời hạn tạm giữ được tính theo giờ.", "VKSND khu vực thực hành quyền công tố và kiểm sát xét xử.",
    "Quyết định số 12/QĐ-VKS ngày 01/08/2026.", "Đương sự có quyền kháng cáo bản án sơ thẩm.",
    "Tài liệu được đánh số bút lục từ 01 đến 25.", "Hội đồng xét xử tuyên án công khai.",
]


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """A word list file of the clean sentences and a few neighbours, in the spell-checker format."""
    listed = sorted({w.lower() for s in CLEAN_CASES for w in re.findall(r"[^\W\d_]+", s)} | {"cam", "toà", "thoả", "tuỳ", "hoà"})
    path = tmp_path_factory.mktemp("dict") / "words.dic"
    path.write_text("\n".join([str(len(listed)), *[f"{w}/A" if i % 3 == 0 else w for i, w in enumerate(listed)]]), encoding="utf-8")
    full = DI.complete_words(DI.read_word_list(spark, str(path)))
    out = str(tmp_path_factory.mktemp("words") / "w")
    full.write.parquet(out)
    return spark.read.parquet(out)


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_word_list(words):
    got = {r.word for r in words.collect()}
    assert {"kiểm", "tòa", "thỏa", "tùy", "hòa", "toà", "đương"} <= got
    assert not any(w.isdigit() or "/" in w for w in got)


def test_spans_match_plain_regex(spark):
    samples = ["", "a", "ab,cd ;x!!  y", "x" * 70 + ",y" * 90, "đương ương\u0001x,y", "a  b\t\tc , d"]
    df = texts(spark, samples)
    for pattern in (r"[,;:!?](?=[^\s])", r"[ \t]{2,}", r"\p{L}+"):
        got = {r.doc_id: [(s.start, s.end) for s in r.s] for r in df.select("doc_id", SP.find_spans(F.col("text"), pattern).alias("s")).collect()}
        py = re.compile(pattern.replace(r"\p{L}", r"[^\W\d_]"))
        for i, t in enumerate(samples):
            assert got[i] == [m.span() for m in py.finditer(t)]


def brute_force(text, repeat_first=False):
    """The formatting rules as a plain loop over all matches."""
    table = [(r"[ \t]{2,}", " "), (r"\s+([,;:!?])", r"\1"), (r"([,;:!?])(?=[^\s\d\n])", r"\1 "), (r"([!?;,])\1+", r"\1")]
    if repeat_first:
        table = [table[3], *table[:3]]
    kept = []
    for pattern, repl in table:
        for m in re.finditer(pattern, text):
            if not any(m.start() < b and m.end() > a for a, b, _ in kept):
                kept.append((m.start(), m.end(), m.expand(repl)))
    return sorted(kept)


SAMPLES = ["a  b ,c!!d", "SE!! X!! ;;; a", "x ,  y", "1,5 a,b", "a \t , b", ",,,", "  !", "a!! b??", "x  ,y" * 40]


@pytest.mark.parametrize("repeat_first", [False, True])
def test_format_rules_against_brute_force(spark, repeat_first):
    pack = spell.VIETNAMESE._replace(repeat_first=repeat_first)
    got = texts(spark, SAMPLES).select("doc_id", spell.rule_issues(F.col("text"), pack).alias("i")).collect()
    for r in got:
        assert [(i.start, i.end, i.suggestion) for i in r.i] == brute_force(SAMPLES[r.doc_id], repeat_first)


def test_quality_set(spark):
    rows = [(i, t, target) for i, (t, target) in enumerate(ERROR_CASES + [(c, None) for c in CLEAN_CASES])]
    cases = spark.createDataFrame(rows, "doc_id long, text string, target string")
    issues = spell.explode_rule_issues(DOC.paragraphs(cases)).withColumnRenamed("doc_id", "case_id")
    q = spell.detection_quality(cases.withColumnRenamed("doc_id", "case_id"), issues).collect()[0]
    assert (q.error_cases, q.caught, q.clean_cases, q.false_alarms) == (18, 18, 10, 0)


def test_phrases_keep_capital_and_order(spark):
    r = texts(spark, ["Viện kiểm xát viên và KHỞI TỘ, đương ương."]).select(spell.phrase_issues(F.col("text")).alias("i")).collect()[0].i
    assert [(i.start, i.end, i.suggestion) for i in r] == [(0, 13, "Viện kiểm sát"), (22, 29, "Khởi tố")]


def warned(spark, words, rows):
    paras = DOC.paragraphs(texts(spark, rows))
    got = spell.dictionary_issues(paras, words, DI.lookup_table(words)).collect()
    return [(r.doc_id, r.original, r.suggestion, r.start, r.confidence) for r in got]


def test_dictionary_check(spark, words):
    rows = [
        "VKSND ban hành Quyết định số 12/QĐ-VKS; bị can Nguyễn Khắc Tú.",
        unicodedata.normalize("NFD", "quyết định"),
        "tòa thỏa hòa tùy",
        "Khoảng cách 12 cm, 10-12 cm và dài 5cm.",
        "bản ghi cm trong",
        "x@kiemm.vn http://kiemm.vn kiểmm",
    ]
    got = warned(spark, words, rows)
    assert (4, "cm", "cam", 8, 80) in got
    assert not [g for g in got if g[0] in (0, 1, 2)]
    assert not [g for g in got if g[1] == "cm" and g[0] == 3]
    assert [(g[1], g[3]) for g in got if g[0] == 5] == [("kiểmm", 27)]


def test_suggestions_against_brute_force(spark, words, monkeypatch):
    known = [r.word for r in words.collect()]
    unknown = ["kiemm", "quyêt", "thẫm", "hanhh", "zzzz", "xử1", "viênn", "co"]

    def strip(t):
        t = t.replace("đ", "d").replace("Đ", "D")
        return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    def expected(word):
        scored = []
        for c in known:
            if abs(len(c) - len(word)) <= 2:
                base = difflib.SequenceMatcher(None, strip(word), strip(c)).ratio()
                if base >= 0.67:
                    scored.append((-(difflib.SequenceMatcher(None, word, c).ratio() * 0.65 + base * 0.35), len(c), c))
        return [c for _, _, c in sorted(scored)[:3]]

    src = spark.createDataFrame([(w, w) for w in unknown], "word string, source string")
    for rows in (4096, 10):  # a block for each tag, and several
        monkeypatch.setattr(word_index, "BLOCK_ROWS", rows)
        monkeypatch.setattr(word_index, "SLICE_ROWS", rows)
        got = {}
        for r in spell.suggestions(src, DI.lookup_table(words)).orderBy("word", "rank").collect():
            got.setdefault(r.word, []).append(r.candidate)
        assert got == {w: expected(w) for w in unknown if expected(w)}


def test_positions_in_long_paragraphs(spark, words):
    body = "viện kiểm sát " * 900
    got = warned(spark, words, [body + "kiểmm " + body + "12 cm kiểmm"])
    assert [g[3] for g in sorted(got, key=lambda g: g[3])] == [len(body), 2 * len(body) + 12]


def test_edits_marks_and_acceptance(spark):
    docs = texts(spark, ["a  b <c> ,d", "ok"])
    issues = spell.number_issues(spell.explode_rule_issues(DOC.paragraphs(docs)))
    rows = docs.select("doc_id", "text", spell.rule_issues(F.col("text")).alias("i"))
    got = {r.doc_id: r for r in rows.select("doc_id", SP.apply_edits(F.col("text"), F.col("i")).alias("fixed"), SP.mark_ranges(F.col("text"), F.col("i")).alias("html")).collect()}
    assert got[0].fixed == "a b <c>,d" and got[1].fixed == "ok"
    assert got[0].html.startswith('a<mark class="style" title="') and "&lt;c&gt;" in got[0].html
    accepted = spell.accept(spell.default_accepted(issues), spell.visible(issues, "style"))
    assert accepted.count() == 2 and spell.applicable(issues, accepted).count() == 2
    assert spell.unaccept(accepted, spell.visible(issues)).count() == 0
    nested = spell.nest_issues(DOC.non_blank(DOC.paragraphs(docs)), issues).orderBy("doc_id").collect()
    assert [len(r.issues) for r in nested] == [2, 0]
    counts = spell.severity_counts(issues, "doc_id").collect()
    assert [(r.error, r.warning, r.style) for r in counts] == [(0, 0, 2)]
    assert {r.id for r in issues.collect()} == {"issue-1", "issue-2"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Đường Hoà  Bình", "a.tar.gz", ".env", "x/y/b.TXT", "toà quý tuỳ")], "a string, b string, c string, p string, t string")
    r = df.select(
        TX.remove_diacritics(F.col("a")).alias("rd"), TX.strip_accents(F.col("a")).alias("sa"),
        TX.file_suffix(F.col("b")).alias("s1"), TX.file_stem(F.col("b")).alias("st1"), TX.file_suffix(F.col("c")).alias("s2"),
        TX.file_folder(F.col("p")).alias("fo"), TX.file_folder(F.col("b")).alias("root"), TX.modern_tones(F.col("t")).alias("mt"),
        TX.thousands(F.lit(1234567)).alias("th"), TX.compare_key(F.col("a")).alias("ck"), TX.count_words(F.col("a")).alias("wc"),
        SP.context_snippet(F.lit("x" * 100), F.lit(60), F.lit(61)).alias("ctx"),
    ).collect()[0]
    assert r.rd == "Đuong Hoa  Binh" and r.sa == "Duong Hoa  Binh"
    assert (r.s1, r.st1, r.s2) == (".gz", "a.tar", "") and r.fo == "x/y" and r.root == "(Thư mục gốc)"
    assert r.mt == "tòa quý tùy" and r.th == "1.234.567" and r.ck == "đường hoà bình" and r.wc == 3
    assert r.ctx == "…" + "x" * 95


def test_decoding(spark):
    samples = [("é".encode("utf-8"), "é"), (b"\xef\xbb\xbfa", "a"), ("é".encode("utf-16"), "é"), (b"\xe9t\x80", "ét€"), (b"\xe9\x81", "é\x81")]
    df = spark.createDataFrame([(str(i), len(b), bytearray(b)) for i, (b, _) in enumerate(samples)], "path string, length long, content binary")
    got = {int(r.path): r.text for r in DOC.text_files(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(samples)}
    assert DOC.text_files(df, max_chars=1).where("truncated").count() == 2


def test_paragraphs_round_trip(spark):
    docs = texts(spark, ["a\n\nb", "", "x"])
    back = {(r.doc_id, r.part_no): r.text for r in DOC.join_paragraphs(DOC.paragraphs(docs)).collect()}
    assert back == {(0, 0): "a\n\nb", (1, 0): "", (2, 0): "x"}
    parts = DOC.join_paragraphs(DOC.paragraphs(docs), lines_per_part=2).where("doc_id = 0").orderBy("part_no").collect()
    assert "\n".join(p.text for p in parts) == "a\n\nb"
    assert rules.BODY_LOCATION
