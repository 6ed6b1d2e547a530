"""Positions, contexts and guarded ranges of the dictionary check."""

import random
import re
import time

from casequill.functions import chars
from casequill.operators import spell
from casequill.sources.dictionary import lookup_table

SCHEMA = "doc_id long, para_no int, location string, text string"
PY_TOKEN = re.compile("[^\\W\\d_]+(?:[-'][^\\W\\d_]+)*")


def known(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def unknown(spark, texts, words=("a",), pack=spell.VIETNAMESE, **options):
    paras = spark.createDataFrame([(i, 1, "x", t) for i, t in enumerate(texts)], SCHEMA)
    return spell.unknown_tokens(paras, known(spark, words), pack, **options)


def rows(df):
    return sorted((r.doc_id, r.start, r.end, r.token, r.context) for r in df.collect())


def context(text, start, end):
    left, right = max(0, start - 55), min(len(text), end + 55)
    return ("…" if left else "") + text[left:right].replace("\n", " ") + ("…" if right < len(text) else "")


def brute(texts, words):
    out = []
    for i, text in enumerate(texts):
        for m in PY_TOKEN.finditer(text):
            if len(m[0]) > 1 and not m[0].isupper() and m[0].lower() not in words:
                out.append((i, m.start(), m.end(), m[0], context(text, m.start(), m.end())))
    return sorted(out)


def test_positions_and_contexts_over_block_ends(spark):
    rng = random.Random(5)
    letters = ["alpha", "béta", "gam-ma", "d", "x'y", "z" * 700, "ok"]
    texts = [" ".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 3, 400, 511, 512, 513, 1024, 1025, 2600)]
    texts += ["", "12 34", texts[5] + " " + "9 " * 3000 + texts[4]]
    # the reference positions hold where no rule fires
    pack = spell.VIETNAMESE._replace(formats=(), phrases={})
    assert rows(unknown(spark, texts, ("ok", "alpha"), pack)) == brute(texts, {"ok", "alpha"})


def test_a_large_dictionary_gives_the_same_rows(spark):
    texts = ["kilo lima mike 5 kg kg", "see https://a.b/cde fgh", "lima  lima"] * 3
    assert rows(unknown(spark, texts, ("lima",))) == rows(unknown(spark, texts, ("lima",), max_broadcast=0))


def test_guarded_ranges(spark):
    text = "nhan https://ab.cd/efg thu ef.gh@ij.kl hi 12/ab-CD nang 5 kg kg bị cáo Nguyen Van Teo den TANDTC m²"
    found = [t for _, _, _, t, _ in rows(unknown(spark, [text], ("a",)))]
    assert found == ["nhan", "thu", "hi", "nang", "kg", "bị", "cáo", "den"] or found == ["nhan", "thu", "hi", "nang", "kg", "den"]


def test_ranges_longer_than_a_bin_and_null_ids(spark):
    link = "https://ab.cd/" + "efg/" * 400
    rows_in = [(None, 1, "x", f"zulu {link} yank"), (None, 1, "x", "zulu yank"), (None, 1, "x", "zulu yank"), (7, 1, None, f"{link} zulu")]
    paras = spark.createDataFrame(rows_in, SCHEMA)
    got = spell.unknown_tokens(paras, known(spark, ["a"])).collect()
    assert sorted(r.token for r in got) == ["yank"] * 3 + ["zulu"] * 4


def test_issue_rows_take_the_place_of_rules(spark):
    texts = ["viet  hoa , xin chao", "mot hai ,ba"]
    paras = spark.createDataFrame([(i, 1, "x", t) for i, t in enumerate(texts)], SCHEMA)
    issues = spell.tagged_rule_issues(paras)
    assert rows(spell.unknown_tokens(paras, known(spark, ["a"]), issues=issues)) == rows(spell.unknown_tokens(paras, known(spark, ["a"])))


def test_no_rows(spark):
    assert spell.unknown_tokens(spark.createDataFrame([], SCHEMA), known(spark, ["a"])).collect() == []


def test_time_grows_with_the_length_of_one_paragraph(spark):
    # the dictionary layer alone, without the rules
    pack = spell.VIETNAMESE._replace(formats=(), phrases={})

    def seconds(n):
        started = time.perf_counter()
        text = "known words here https://ab.cd/ef " * n + "zulu"
        assert [r.token for r in unknown(spark, [text], ("known", "words", "here"), pack).collect()] == ["zulu"]
        return time.perf_counter() - started

    # most of the short run is planning; a nested loop over 25,000 tokens and 5,000 links would show
    short, long = seconds(500), seconds(5_000)
    assert long < 5 * short + 5, (short, long)


def test_token_pattern_is_the_one_of_the_brute_force():
    assert chars.TOKEN.count("[-']") == 1


def test_tokens_of_a_large_table_do_not_go_through_the_driver(spark):
    """No join of the exploded rows, and given issues are joined by merging: only the dictionary is broadcast."""
    paras = spark.createDataFrame([(1, 1, "body", "xx https://a.vn/yy zz")], SCHEMA)
    issues = spell.tagged_rule_issues(paras)
    plans = [spell.unknown_tokens(paras, known(spark, ["a"]), issues=i)._jdf.queryExecution().executedPlan().toString() for i in (None, issues)]
    assert [p.count("Join") for p in plans] == [1, 2] and plans[0].count("BroadcastHashJoin") == 1
    assert plans[1].count("SortMergeJoin") == 2


def test_full_check_writes_no_token_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(spell, "stage", lambda df: written.append(df.columns) or df)
    paras = spark.createDataFrame([(1, 1, "body", "appel of appel")], SCHEMA)
    lookup = lookup_table(known(spark, ["apple"]))
    assert [r.suggestion for r in spell.check(paras, known(spark, ["apple", "of"]), lookup).collect()] == ["apple"] * 2
    assert all("context" not in columns for columns in written)


def test_words_are_gathered_without_positions(spark):
    """The first reading of the texts is one pass of the token pattern; the words are those of the tokens that are asked for."""
    text = "Ab zqb-ab zqb\u0001zqc 5 kg Ab XYZ zq² 'zqd' tân zqB https://zqe.vn zqf'g"
    paras = spark.createDataFrame([(1, 1, "body", text), (2, 1, "body", "ab " * 900 + "zqh")], "doc_id int, para_no int, location string, text string")
    words = spark.createDataFrame([("ab",), ("tân",)], "word string")
    asked = spell.asked_words(paras, words)
    tokens = spell._asked_tokens(paras, words, spell.VIETNAMESE, 100, None, *spell.PARA_KEY)
    found = sorted(r.word for r in asked.collect())
    assert set(found) >= {r.word for r in tokens.collect()} >= {"zqb-ab", "zqb", "zqc", "zqf'g", "zqh"} and len(set(found)) == len(found)
    assert "ab" not in found and "transform" not in asked._jdf.queryExecution().optimizedPlan().toString()
