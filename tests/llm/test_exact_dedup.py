import hashlib
import re

import edge

from casequill.llm import exact_dedup


def _expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(doc_id)
    out = []
    for body, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        out += [(i, low, len(ids), i == low, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def _found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()), key=repr)


def test_edge_rows_match_brute_force(spark):
    assert _found(exact_dedup.exact_copies(edge.documents(spark))) == _expected(edge.rows())


def test_splits_and_chains(spark):
    """Small buckets force doublings; a depth of 2 leaves overfull buckets."""
    data = [(i, f"text {i % 300}", "en", "a") for i in range(1000)]
    for depth in (2, 16):
        found = exact_dedup.exact_copies(edge.documents(spark, data), bucket_keys=10, max_depth=depth)
        assert _found(found) == _expected(data)
        assert 3 <= found.select("bucket").distinct().count() <= 2**depth


def test_one_hot_text(spark):
    data = [(i, "same" if i % 3 else f"t{i}", "en", "a") for i in range(600)]
    assert _found(exact_dedup.exact_copies(edge.documents(spark, data), bucket_keys=50)) == _expected(data)


def test_documents_keep_columns(spark):
    docs = edge.documents(spark)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 5, 6, 7, 8, 9, 10, 11, None], key=repr)


def test_empty(spark):
    assert exact_dedup.exact_copies(edge.empty(spark)).count() == 0
    assert exact_dedup.distinct_documents(edge.empty(spark)).count() == 0
