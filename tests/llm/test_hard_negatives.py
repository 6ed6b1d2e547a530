import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casequill.llm import hard_negatives


def brute(data, every=3, positives=5, negatives=3):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in data if None not in (i, label) and fine(v)]
    rows = [r for r in rows if sum(x * x for x in r[2]) < 1 << 62]
    out = []
    for place, (anchor, label, vec) in enumerate(rows):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vec, v)), i, own) for n, (i, own, v) in enumerate(rows) if n != place]
        same = sorted((s, i) for s, i, own in scored if own == label)[:positives]
        other = sorted((s, i) for s, i, own in scored if own != label)
        for s, i in same:
            fits = [(t, j) for t, j in other if -50 * s <= -100 * t <= -95 * s][:negatives]
            out += [(anchor, i, rank, j, -s, -t) for rank, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def _frame(spark, data):
    made = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    return made.withColumns({c: F.lit("other") for c in ("id", "vec", "k1", "cell", "block", "rank", "ids", "raw", "anchor")})


def _data():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 6))
    data = [(i, (centres[i % 8] + rng.normal(size=6) * 0.6).tolist(), i % 5) for i in range(400)]
    data += [(1000 + i, data[7][1], i % 2) for i in range(60)]  # one vector, two labels
    data += [(2000, None, 1), (2001, [], 1), (2004, [0.0] * 6, 1), (2007, [1.0, None] * 3, 2), (2010, [math.nan] * 6, 2)]
    data += [(2013, [math.inf] * 6, 2), (None, data[3][1], 3), (2016, data[3][1], None), (2019, [1.0, 2.0], 1), (2022, [3.0] * 9, 2)]
    data += [(2025, [1e300] * 6, 1), (2028, [2e6] * 6, 1), (2031, [1.9e6] * 6, 2), (3, data[3][1], data[3][2]), (6, data[9][1], 4)]
    return data


def _mined(spark, data, **options):
    found = hard_negatives.mine(_frame(spark, data), F.col("vec_id") % 3 == 0, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 8, "probe": 20, "block_bytes": 9 * 8 * 5}])
def test_matches_brute_force(spark, options):
    assert _mined(spark, _data(), **options) == brute(_data())


def test_scores_on_the_edge_of_a_window(spark):
    data = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (4, [0.95], 2), (5, [127 / 256], 2), (7, [244 / 256], 2), (8, [0.5], 2), (10, [0.5], 2)]
    assert _mined(spark, data) == brute(data)


def test_few_rows(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_heap_visits_by_falling_bounds_that_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (300, 8))
    index = hard_negatives.MultiIndex(x[:100], 5)
    cell, near, far = index.place(x)
    index.fill([(c, int((cell == c).sum()), near[cell == c].max(), far[cell == c].max()) for c in np.unique(cell).tolist()], 10)
    a = rng.integers(-500, 500, 8)
    visits = list(index.visits(a))
    assert sorted(v[1] for v in visits) == np.unique(cell).tolist()
    assert all(p[0] >= q[0] for p, q in zip(visits, visits[1:]))
    for bound, c, least, most in visits:
        scores = x[cell == c] @ a
        assert least <= scores.min() and scores.max() <= most <= bound + 1
