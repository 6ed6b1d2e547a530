import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casequill.llm import metric_join


def brute(data, least=0.9):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    n = len(data)
    linked = [[i != j and fine(data[i][1]) and fine(data[j][1]) and len(data[i][1]) == len(data[j][1])
               and cosine(data[i][1], data[j][1]) >= least for j in range(n)] for i in range(n)]
    low = [d[0] for d in data]
    for _ in range(n):
        low = [min([low[i], *[low[j] for j in range(n) if linked[i][j]]]) for i in range(n)]
    return sorted((data[i][0], sum(linked[i]), low[i]) for i in range(n))


def _frame(spark, data):
    made = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    return made.withColumns({c: F.lit("other") for c in ("vec", "name", "cell", "weight", "n_links", "kept")})


def _data():
    rng = np.random.default_rng(4)
    data = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(15):
            data.append((len(data), (centre + rng.normal(size=8) * rng.uniform(0, 0.4)).tolist()))
    data += [(500 + i, data[3][1]) for i in range(20)]
    data += [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0, None] * 4), (604, [math.nan] * 8), (605, [math.inf] + [0.0] * 7)]
    data += [(610, [1e200] * 8), (611, [1e-200] * 8), (612, [1.0, 2.0]), (613, [2.0, 4.0]), (614, [1.0]), (3, data[3][1])]
    return data


@pytest.mark.parametrize("options", [{}, {"cell_rows": 12, "block_rows": 5}])
def test_matches_brute_force(spark, options):
    found = metric_join.linked_vectors(_frame(spark, _data()), **options).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in found) == brute(_data())


def test_bound_is_met_exactly(spark):
    """A cosine of exactly 0.6 links at 0.6."""
    data = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0]), (4, [-3.0, -4.0])]
    found = {r.id: r.n_links for r in metric_join.linked_vectors(_frame(spark, data), least_cosine=0.6).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 0}


def test_null_and_equal_ids_carry_links(spark):
    """A vector without an id joins two others, null ids alone have no name, and an id may have several vectors."""
    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    data = [(8, turn(0)), (None, turn(20)), (5, turn(40)), (None, turn(180)), (None, turn(185)), (7, turn(100)), (7, turn(270)), (9, turn(110))]
    found = metric_join.linked_vectors(_frame(spark, data)).collect()
    got = sorted(((r.id, r.n_links, r.component_id) for r in found), key=repr)
    expected = [(8, 1, 5), (None, 2, 5), (5, 1, 5), (None, 1, None), (None, 1, None), (7, 1, 7), (7, 0, 7), (9, 1, 7)]
    assert got == sorted(expected, key=repr)


def test_empty(spark):
    assert metric_join.linked_vectors(_frame(spark, [])).count() == 0
