"""The scan of tokens in Arrow batches, and the cheap tests before the rules."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions import spans as SP
from casequill.operators import spell, token_scan
from casequill.sources.dictionary import lookup_table

SCHEMA = "doc_id long, para_no int, location string, text string"
PARTS = ["ab", "a", "-", "'", " ", ".", "é", "é", "Đ", "Ⅻ", "²", "½", "𝒜", "語", "\u0001", "\u0002", "7", "\n", "A", "!", ",", "  ", " ", "ª", "😀", "_", "ông Ab"]


def odd_texts(seed, n=400):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [*texts, None, "", "-", "a-", "-a", "a-b", "'a'b'", "tail", "-head", "é" * 9000 + " x'y " * 4000, "a" * 20_000]


def test_tokens_are_those_of_the_pattern(spark, monkeypatch):
    texts = odd_texts(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r.i: r.t or [] for r in df.select("i", F.regexp_extract_all("text", F.lit(chars.TOKEN), F.lit(0)).alias("t")).collect()}
    runs = token_scan.letters(spark)
    whole = pa.array(["not seen", *texts, "nor this"], pa.string()).slice(1, len(texts))
    scan = token_scan.Scan(whole, runs)
    got = {i: [] for i in range(len(texts))}
    places, bases = zip(scan.place(scan.start), scan.place(scan.end)), scan.place(scan.offsets)
    for row, token, (start, end) in zip(scan.row.tolist(), scan.tokens().to_pylist(), places):
        assert texts[row][start - bases[row] : end - bases[row]] == token
        got[row].append(token)
    assert got == found
    # the same from chunks of a few bytes, each token once a chunk
    monkeypatch.setattr(token_scan, "CHUNK", 40)
    batches = [pa.RecordBatch.from_arrays([whole.slice(i, 50)], ["text"]) for i in range(0, len(texts), 50)]
    chunks = list(token_scan._chunks(iter(batches)))
    assert [t for c in chunks for t in c.column(0).to_pylist()] == texts and len(chunks) > len(batches)
    assert {t for b in token_scan.distinct_tokens(runs)(iter(batches)) for t in b.column(0).to_pylist()} == {t for ts in found.values() for t in ts}


def test_cheap_tests_lose_no_hit(spark):
    texts = [t for t in odd_texts(2, 1500) if t is not None] + ["bà  Ab", "bị can Đa Be", "x@yy.zz", "1A-2", "ĐA", "AĐ", "TTT", "a ,b", "?!", "a;;"]
    text, plain = F.col("text"), spell.VIETNAMESE._replace(formats=tuple(r._replace(hint=None) for r in spell.FORMAT_RULES))
    protected = F.concat(*[SP.find_spans(text, p) for p in spell.protected_patterns()])
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", spell.rule_issues(text).alias("a"), spell.rule_issues(text, plain).alias("b"), spell.protected_spans(text).alias("c"), protected.alias("d")
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows) and sum(map(len, (r.a for r in rows))) > 300 and sum(map(len, (r.c for r in rows))) > 30


def test_hits_carry_their_text(spark):
    text = "a\u0001b  \u0001  é,x" * 40
    found = spark.createDataFrame([(text,)], "text string").select(SP.find_hits(F.col("text"), "[^a-z]{2,}").alias("h")).first().h
    assert len(found) == 40 and all(text[h.start : h.end] == h.hit for h in found)


def test_only_tokens_with_a_fix_become_rows(spark, monkeypatch):
    """The scan looks fixes up, so no token rows are joined; beyond the limit they are, with the same rows."""
    texts = ["appel of Appel 5 kgm kgm appel-x ápple APPEL", "of https://a.b/appel banan , banan", "appel " * 3000 + "Banan", None]
    paras = spark.createDataFrame([(i // 2, 1, "body", t) for i, t in enumerate(texts)], SCHEMA)
    words = spark.createDataFrame([("apple",), ("of",), ("banana",), ("kg",)], "word string")
    pack = spell.VIETNAMESE._replace(units=("kgm",))
    rows = lambda df: sorted(map(tuple, df.collect()))
    held = spell.dictionary_issues(paras, words, lookup_table(words), pack)
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()
    expected = rows(held)
    assert len(expected) > 3000 and {r[8] for r in expected} == {"apple", "banana", "Banana", "kg"} and [r[8] for r in expected].count("kg") == 1
    monkeypatch.setattr(spell, "MAX_HELD_ROWS", 0)
    joined = spell.dictionary_issues(paras, words, lookup_table(words), pack)
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString() and rows(joined) == expected
