"""Nearest words against a comparison of all pairs."""

import difflib
import random
import unicodedata

import pytest

from casequill.operators import spell, word_index
from casequill.sources.dictionary import lookup_table


def bare(word):
    word = word.replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return 1.0 - row[-1] / max(len(a), len(b))


def blocks(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def brute(asked, known, measure, limit):
    out = {}
    for word in asked:
        rows = []
        for c in known:
            if abs(len(c) - len(word)) <= 2 and bare(word) and bare(c) and (base := measure(bare(word), bare(c))) >= 0.67:
                rows.append((-round(measure(word, c) * 0.65 + base * 0.35, 9), len(c), c))
        if rows:
            out[word] = [(c, -score) for score, _, c in sorted(rows)[:limit]]
    return out


def _words(seed):
    rng = random.Random(seed)
    syllables = ["an", "ba", "cê", "đu", "e", "aa", "ng", "ương", "x", "ý"]
    known = {"".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(300)}
    long = "".join(rng.choices("abcdef", k=59))
    known |= {long, long + "a", long + "ab", long + "abc", long + "abcd", long + "abcde", "ab" * 40, "x" * 130, "ñ́ab", "漢字かな"}
    asked = set()
    for word in known:
        at = rng.randrange(len(word))
        asked |= {word[:at] + word[at + 1 :], word[:at] + rng.choice("aeđxw") + word[at:], word[:at] + "q" + word[at + 1 :], word[::-1]}
    return sorted(w for w in asked if w and w not in known), sorted(known)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize(("rows", "limit"), [(4096, 3), (7, 1)])
def test_matches_all_pairs(spark, monkeypatch, exact, rows, limit):
    monkeypatch.setattr(word_index, "BLOCK_ROWS", rows)
    monkeypatch.setattr(word_index, "SLICE_ROWS", 5 * rows)
    asked, known = _words(rows)
    sources = spark.createDataFrame([(w, w) for w in asked], "word string, source string")
    lookup = lookup_table(spark.createDataFrame([(w,) for w in known], "word string"))
    got = {}
    for r in spell.suggestions(sources, lookup, limit, exact).orderBy("word", "rank").collect():
        got.setdefault(r.word, []).append((r.candidate, round(r.score, 9)))
    assert got == brute(asked, known, blocks if exact else edits, limit)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "word string, source string")
    lookup = lookup_table(spark.createDataFrame([("mot",)], "word string"))
    assert spell.suggestions(none, lookup).count() == 0
    some = spark.createDataFrame([("mott", "mott")], "word string, source string")
    assert spell.suggestions(some, lookup_table(none.select("word"))).count() == 0


def test_first_tags_keep_every_pair():
    """Pairs with enough common letters share a first tag, whatever the order."""
    rng = random.Random(2)
    order = {f"{c}{k}": rng.random() for c in "abcde" for k in range(9)}
    order = {t: n for n, t in enumerate(sorted(order, key=order.get))}
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(2))
        if abs(len(a) - len(b)) <= 2 and 2 * len(set(word_index.tags(a)) & set(word_index.tags(b))) >= 0.67 * (len(a) + len(b)):
            assert set(word_index.first_tags(a, len(a), 0.67, order)) & set(word_index.first_tags(b, len(b), 0.67, order))


def test_asked_words_are_written_once(spark, monkeypatch):
    """No index entries are written: the words are staged as they are, and each goes once to each block that it may meet."""
    staged = []
    monkeypatch.setattr(word_index, "stage", lambda df, stage=word_index.stage: staged.append(stage(df)) or staged[-1])
    asked, known = _words(1)
    sources = spark.createDataFrame([(w, w) for w in asked], "word string, source string")
    found = spell.suggestions(sources, lookup_table(spark.createDataFrame([(w,) for w in known], "word string")))
    assert found.count() and sum(df.count() for df in staged) == len(asked) + len(known)
    bands = word_index._bands({n: sum(len(w) == n for w in known) for n in set(map(len, known))}, {})
    assert [b["blocks"] for b in bands] == [1]
