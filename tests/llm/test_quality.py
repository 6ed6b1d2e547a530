import random
import zlib

import edge
import numpy as np
from pyspark.sql import functions as F

from casequill.llm import quality


def _corpus():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        good = i % 4 != 0
        words = [rng.choice(edge.WORDS.split()) for _ in range(rng.randrange(20, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 8 else " ".join([words[0]] * len(words))
        docs.append((i, text, "en", "a"))
        labels.append((i, int(good)))
    return docs, labels


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int").withColumns({c: F.lit("other") for c in edge.CLASHING})


def test_held_out_documents_are_told_apart(spark):
    docs, labels = _corpus()
    found = quality.score_documents(edge.documents(spark, docs), _labels(spark, labels)).collect()
    truth = dict(labels)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    right = [(r.score >= quality.THRESHOLD) == bool(truth[r.id]) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97


def test_held_out_labels_and_other_columns_are_not_learned_from(spark):
    docs, labels = _corpus()
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    scores = lambda ls, ds: {r.id: r.score for r in quality.score_documents(edge.documents(spark, ds), _labels(spark, ls)).collect()}
    plain = scores(labels, docs)
    other = scores(turned, [(i, t, "xx", "zz") for i, t, *_ in docs])
    assert all(abs(plain[i] - other[i]) < 1e-9 for i in plain)


def test_isotonic_matches_definition():
    values, weights = np.array([0.1, 0.5, 0.3, 0.4, 0.9, 0.2]), np.array([1.0, 2.0, 1.0, 1.0, 1.0, 3.0])
    fitted = quality.isotonic(values, weights)
    pooled = [max(min(np.average(values[a : b + 1], weights=weights[a : b + 1]) for b in range(i, 6)) for a in range(i + 1)) for i in range(6)]
    assert np.allclose(fitted, pooled)


def test_edge_rows_and_missing_labels(spark):
    docs = edge.documents(spark)
    mixed = _labels(spark, [(1, 1), (1, 0), (6, None), (7, 5), (None, 1), (999, 0)])
    for labels in (mixed, _labels(spark, [])):
        found = quality.score_documents(docs, labels).collect()
        assert len(found) == len(edge.rows()) and {r.score for r in found} == {0.5}
    kept = quality.good_documents(docs, mixed)
    assert kept.columns == docs.columns and kept.count() == len(edge.rows())
    assert quality.score_documents(edge.empty(spark), mixed).count() == 0


def test_rejected_rows_go(spark):
    docs, labels = _corpus()
    frame = edge.documents(spark, docs + edge.rows()[7:9])
    kept = {r.doc_id for r in quality.good_documents(frame, _labels(spark, labels)).collect()}
    assert len([i for i, q in labels if q and i in kept]) > 0.98 * sum(q for _, q in labels)
    assert len([i for i, q in labels if not q and i in kept]) < 0.1 * len(labels)
