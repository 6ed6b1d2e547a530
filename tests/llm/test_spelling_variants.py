import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import documents, empty, rows

from casequill.llm import spelling_variants


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_counts(data, modulus):
    counts = Counter()
    for key, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if modulus and h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, counts[w], len(near[w]), counts[form[w]] if form[w] else -1))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def _data():
    rng = np.random.default_rng(5)
    letters = list("aabcé") + ["Ä"]
    words = ["".join(rng.choice(letters, rng.integers(4, 8))) for _ in range(300)]
    data = [(i, " ".join(rng.choice(words, 80)) + ", Wort_ ābcdef x÷yÿzzz") for i in range(60)]
    return data + [(None, "aaaaa aaaaab aaaaab"), (None, None), (7, data[7][1])]


@pytest.mark.parametrize("modulus", [None, 5, 97])
def test_matches_brute_force(spark, modulus):
    data = _data()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    change = spelling_variants.one_letter_less(modulus) if modulus else None
    assert found(spelling_variants.spelling_variants(docs, change=change)) == brute(brute_counts(data, modulus))


def test_chains_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "aaaac": 6, "aaaaaa": 6, "zzzzz": 9, "zzzzzz": 9, "éaaaa": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found(spelling_variants.variants(words)) == brute(counts)


def test_long_words(spark):
    long = "ab" * 5_000
    counts = {long: 3, long[:-1]: 9, long + "a": 4, "x" + long: 8, long[:4000] + "é" + long[4001:]: 7, "abcde": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found(spelling_variants.variants(words)) == brute(counts)


def test_text_in_blocks(monkeypatch):
    text = ("eins zwei dreié éé ünf " * 50).encode()
    whole = spelling_variants.runs(text)
    monkeypatch.setattr(spelling_variants, "BLOCK", 7)
    assert spelling_variants.runs(text) == whole


def test_edge_rows(spark):
    change = spelling_variants.one_letter_less(97)
    assert found(spelling_variants.spelling_variants(documents(spark), change=change)) == brute(brute_counts(rows(), 97))
    assert found(spelling_variants.spelling_variants(empty(spark))) == []
