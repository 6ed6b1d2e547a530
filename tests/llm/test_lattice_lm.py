import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import documents, empty, rows
from pyspark.sql import functions as F

from casequill.llm import lattice_lm, queries


def _tiny():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "ab", "b", "▁ab", "bc", "c", "abc"]
    weights = np.log(np.concatenate((np.full(256, 0.1 / 256), np.linspace(1, 2, 9) * 0.9 / 13.5)))
    return pieces, weights, np.arange(256)


def brute_paths(word, vocabulary):
    """Probability of a word: the sum over all ways to cut it."""
    pieces, weights, spelled = vocabulary
    known = {p: math.exp(w) for p, w in zip(pieces[256:], weights[256:])}
    text, total = "▁" + word, 0.0
    for cuts in itertools.product([False, True], repeat=len(text) - 1):
        parts, start = [], 0
        for i, cut in enumerate((*cuts, True), 1):
            if cut:
                parts.append(text[start:i])
                start = i
        chance, at = 1.0, 0
        for part in parts:
            if part in known and ("▁" not in part or at == 0):
                chance *= known[part]
            elif len(part) == 1:
                chance *= math.prod(math.exp(weights[spelled[b]]) for b in part.encode())
            else:
                chance = 0.0
            at += len(part)
        total += chance
    return total


@pytest.mark.parametrize("word", ["", "a", "abc", "abab", "xab", "aébc", "▁a", "漢a"])
def test_forward_sums_all_segmentations(word):
    lattice = lattice_lm.Lattice(*_tiny())
    assert math.isclose(math.exp(lattice.forward(["a", word, "xyz"])[1]), brute_paths(word, _tiny()), rel_tol=1e-9)


def test_expected_counts_are_the_gradient():
    """The expected use of a piece is the derivative of the log-probability by its weight."""
    pieces, weights, spelled = _tiny()
    counts = lattice_lm.Lattice(pieces, weights, spelled).expected(["abcxab"])
    for place in (256, 257, 258, 259, 260, 262, ord("x")):
        up = weights.copy()
        up[place] += 1e-6
        change = lattice_lm.Lattice(pieces, up, spelled).forward(["abcxab"])[0] - lattice_lm.Lattice(pieces, weights, spelled).forward(["abcxab"])[0]
        assert math.isclose(change / 1e-6, counts[place], rel_tol=1e-4, abs_tol=1e-6)


@pytest.mark.parametrize("cells", [1, 3, 7])
def test_words_in_parts(monkeypatch, cells):
    lattice, words = lattice_lm.Lattice(*_tiny()), ["abcabxabcab漢abc", "a", "", "bcabcabcab", "xxxxxabxxx"]
    whole, used = lattice.forward(words), lattice.expected(words)
    monkeypatch.setattr(lattice_lm, "_CELLS", cells)
    assert np.allclose(lattice.forward(words), whole) and np.allclose(lattice.expected(words), used)


def test_expected_counts_of_long_words():
    """A word of thousands of letters uses pieces as its parts do."""
    pieces, weights, spelled = _tiny()
    lattice = lattice_lm.Lattice(pieces, weights, spelled)
    long, longer = lattice.expected(["abcx漢" * 1000]), lattice.expected(["abcx漢" * 2000])
    place = {p: i for i, p in enumerate(pieces)}
    for piece in ("a", "ab", "bc", "abc"):
        assert math.isclose((longer[place[piece]] - long[place[piece]]) / 1000, long[place[piece]] / 1000, rel_tol=1e-2)
    assert math.isclose(long[ord("x")], 1000, rel_tol=1e-9) and math.isclose(longer[0xE6], 2000, rel_tol=1e-9)


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()]


def brute(data):
    """Base figures by plain counting."""
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in data]
    counts = Counter()
    for r, out in zip(data, held):
        if not out:
            counts.update([*tokens(r[1]), None])
    n, v = counts.total(), len(counts)
    return sorted(
        (-1 if r[0] is None else r[0], out, len(tokens(r[1])) + 1, sum(counts[t] > 0 for t in [*tokens(r[1]), None]), n,
         round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in [*tokens(r[1]), None]), 6))
        for r, out in zip(data, held)
    )


def _scored(docs, **options):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lattice_lm.score_documents(docs, queries.scored_vocabulary_path(), held_out, **options).collect()


def _base(found):
    return sorted((-1 if r.id is None else r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_edge_rows(spark, frequent):
    data = rows() + [(100 + i, f"wort {i % 3} Ärger\x85x\xa0y nochmal wort", "de", "a") for i in range(30)]
    found = _scored(documents(spark, data), frequent=frequent)
    assert _base(found) == brute(data)
    assert all(math.isfinite(r.score) and r.score <= 0 and r.paths_score <= 0 for r in found)
    scores = {r.id: r.score for r in found}
    assert scores[3] == scores[4] == scores[5] < 0  # the end alone
    assert scores[9] > -20 and {r.id: r.paths_score for r in found}[9] < -100  # one word of 300,000 letters, known as a whole


def test_whole_scores(spark):
    """Scores recomputed from the fitted pieces, word by word."""
    data = [(i, " ".join(["gut", "haus", f"haus{i % 4}", "neu"][: 1 + i % 4])) for i in range(20)] + [(50, "nie gesehn")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    never = F.col("doc_id") == 50
    found = {r.id: r for r in lattice_lm.score_documents(docs, queries.scored_vocabulary_path(), never).collect()}
    vocabulary = lattice_lm.read_vocabulary(queries.scored_vocabulary_path())
    counts = Counter(t for i, text in data if i != 50 for t in [*text.split(), None])
    n, kinds = counts.total(), len(counts)
    once, twice = (sum(c == k for w, c in counts.items() if w) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else lattice_lm.DISCOUNT
    words = spark.createDataFrame([(w.encode(),) for w in counts if w], "word binary")
    lattice = lattice_lm.Lattice(vocabulary[0], lattice_lm.fit(words, vocabulary), vocabulary[2])
    for i, text in data:
        want = math.log10((counts[None] - discount) / n)
        for word in text.split():
            want += math.log10(max(counts[word] - discount, 0) / n + discount * kinds / n * math.exp(lattice.forward([word])[0]))
        assert math.isclose(found[i].score, want, rel_tol=1e-6)


def test_vocabulary_is_a_distribution():
    pieces, weights, spelled = lattice_lm.read_vocabulary(queries.scored_vocabulary_path())
    assert math.isclose(np.exp(weights).sum(), 1, rel_tol=1e-9) and len(set(spelled.tolist())) == 256 and len(pieces) == len(weights)


def test_empty(spark):
    assert _scored(empty(spark)) == []


def test_nothing_to_learn_from(spark):
    found = lattice_lm.score_documents(documents(spark), queries.scored_vocabulary_path(), F.lit(True)).collect()
    assert len(found) == len(rows())
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in found)
