import hashlib
import math
import re

import edge
import pytest

from casequill.llm import mixing


def md5(*parts):
    return hashlib.md5(":".join(["mix", *["null" if p is None else str(p) for p in parts]]).encode()).hexdigest()


def brute(data, max_epochs=2.0, target=1.0, budget=None):
    tokens = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, _, s in data]
    totals, counts = {}, {}
    for _, s, n in tokens:
        totals[s] = totals.get(s, 0) + n
        counts[s] = counts.get(s, 0) + 1
    shares = {s: n / sum(totals.values()) for s, n in totals.items() if n}

    def weights(a):
        z = sum(p**a for p in shares.values())
        return {s: p**a / z for s, p in shares.items()}

    def epochs(a):
        w = weights(a)
        size = budget or max(totals[s] / w[s] for s in w)
        return {s: w[s] * size / totals[s] for s in w}

    def wanted(a):
        entropy = -sum(w * math.log(w) for w in weights(a).values())
        ok = target is None or entropy < target * math.log(len(shares)) - 1e-9
        return ok and (max_epochs is None or max(epochs(a).values()) <= max_epochs)

    low, high = 0.0, 1.0
    if max_epochs is not None and max(epochs(0).values()) > max_epochs:
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if max(epochs(mid).values()) > max_epochs else (low, mid)
    elif target is not None:
        for _ in range(50):
            mid = (low + high) / 2
            entropy = -sum(w * math.log(w) for w in weights(mid).values())
            low, high = (mid, high) if entropy >= target * math.log(len(shares)) - 1e-12 else (low, mid)
    times, out = epochs(low), []
    bits = max(1, math.ceil(math.log2(max(counts.values())) / 2))
    for s in totals:
        own = [(i, n, int(md5(i)[:8], 16) >> 32 - bits) for i, source, n in tokens if source == s]
        quota = round(times[s] * totals[s]) if totals[s] else 0
        whole, rest = divmod(quota, totals[s]) if totals[s] else (1, 0)
        for e in range(whole):
            out += [(i, s, e) for i, _, _ in own]
        filled = {}
        order = sorted((md5(s, whole, b) + md5(whole, i), i, n) for i, n, b in own)
        for key, _, n in order:
            filled[key] = filled.get(key, 0) + n
        total, kept = 0, set()
        for key in sorted(filled):
            total += filled[key]
            if total <= rest and rest:
                kept.add(key)
        out += [(i, s, whole) for key, i, _ in order if key in kept]
    return sorted(out, key=repr)


def _found(df):
    return sorted(((r.id, r.source, r.epoch) for r in df.collect()), key=repr)


def _data():
    sizes = {"big": 400, "mid": 90, "small": 50}
    return [(len(s) * 1000 + i, f"{s} " * (1 + (i * 7) % 13), "en", s) for s, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"max_epochs": 3.0}, {"max_epochs": None, "target": 0.9}, {"budget": 1500, "max_epochs": 4.0}])
def test_matches_brute_force(spark, options):
    own = {{"target": "target_entropy"}.get(k, k): v for k, v in options.items()}
    assert _found(mixing.draw(edge.documents(spark, _data()), **own)) == brute(_data(), **options)


def test_edge_rows(spark):
    docs = edge.documents(spark)
    assert {(r.id, r.source) for r in mixing.draw(docs).collect()} == {(i, s) for i, _, _, s in edge.rows()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() >= len(edge.rows())


def test_budget_and_repeats(spark):
    drawn = mixing.draw(edge.documents(spark, _data()), max_epochs=2.0).collect()
    words = {i: len(t.split()) for i, t, *_ in _data()}
    all_words = {s: sum(words[i] for i, _, _, x in _data() if x == s) for s in ("big", "mid", "small")}
    drawn_words = {s: sum(words[r.id] for r in drawn if r.source == s) for s in all_words}
    assert drawn_words["big"] == all_words["big"]
    assert all(all_words[s] <= drawn_words[s] <= 2.0 * all_words[s] + 1 for s in all_words)


def test_bisect():
    for bound in (0.0, 0.3, 0.999, 1.0):
        assert abs(mixing.bisect(lambda grid, b=bound: [a <= b for a in grid]) - bound) < 1e-9


def test_empty_and_no_aim(spark):
    assert mixing.draw(edge.empty(spark)).count() == 0 and mixing.mixed_documents(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.draw(edge.documents(spark), target_entropy=None, max_epochs=None)
