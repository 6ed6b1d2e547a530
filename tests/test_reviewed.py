"""Reviewed lists: the filter by words changes nothing that the plain fold would do."""

import json
import random

from pyspark.sql import functions as F

from casequill.operators import pii, reviewed

ITEM = "doc_id long, seq int, old string, new string"


def run(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "an id")], "doc_id long, text string")
    got = reviewed.apply_lists(docs, spark.createDataFrame(items, ITEM), **options).collect()
    return {r.doc_id: r for r in got}


def test_same_as_the_fold_of_all_items(spark):
    rng = random.Random(3)
    parts = ["an", "An", "ban", "x.", ".x", "-", "cd", "Ẩn", " ", "an cd", "cd ban", "$1", "\\", "e."]
    texts = ["".join(rng.choice(parts + [" "] * 4) for _ in range(rng.randrange(30))) for _ in range(60)]
    lists = [[(rng.choice(parts) + rng.choice(["", " cd", ".", "x"]), rng.choice(parts)) for _ in range(rng.randrange(1, 9))] for _ in texts]
    items = [(i, n, old, new) for i, rows in enumerate(lists) for n, (old, new) in enumerate(rows)]
    got, folded = run(spark, texts, items, few=0), run(spark, texts, items)
    plain = spark.createDataFrame([(i, t, rows) for i, (t, rows) in enumerate(zip(texts, lists))], "doc_id long, text string, items " + pii.REPLACEMENTS_TYPE)
    for r in pii.replace_in_documents(plain, plain).collect():
        assert (got[r.doc_id].text, got[r.doc_id].replaced, got[r.doc_id].reject_reason) == (r.text, r.replaced, r.reject_reason), lists[r.doc_id]
        assert got[r.doc_id] == folded[r.doc_id]


def test_hundred_thousand_items_without_limit(spark):
    items = [(0, i, f"word{i}", f"<{i}>") for i in range(100_000)] + [(0, 200_000, "<7> <8>", "both"), (0, 200_001, "WORD5", "again"), (0, 200_002, " ", "z")]
    row = run(spark, ["word7 word8 word99999 word100000 word5"], items)[0]
    assert (row.text, row.replaced) == ("<7> <8> <99999> word100000 <5>", 4)
    assert (row.usable, row.empty, row.repeated, row.reject_reason) == (100_001, 1, 1, None)


def test_limits_only_when_asked_for(spark):
    items = [(0, 0, "a", "b"), (0, 1, "cc", "d" * 600), (1, 0, "", "x"), (2, 0, "a", None)]
    free, bound = run(spark, ["a cc", "a", None, "a"], items), run(spark, ["a cc", "a", None, "a"], items, max_items=1, max_length=500)
    assert free[0].text == "b " + "d" * 600 and bound[0].text == "a cc" and bound[0].too_long == 1
    assert bound[0].reject_reason == "too many replacements" and free[1].reject_reason == "nothing selected"
    assert free[2].text is None and (free[3].text, free[3].usable) == ("a", 0) and free[None].text == "an id"


def test_json_and_no_rows(spark):
    payloads = spark.createDataFrame([(1, json.dumps([{"old": "a", "new": "b"}])), (2, '{"c":"d"}'), (3, "junk")], "doc_id long, payload string")
    assert sorted(tuple(r) for r in reviewed.items_from_json(payloads).collect()) == [(1, 0, "a", "b"), (2, 0, "c", "d")]
    assert run(spark, [], [])[None].text == "an id"


def test_words_are_replaced_in_one_pass(spark):
    """Lists whose items can't act on one another give the same as the fold, without a pass for each item."""
    text = "in inside Inside ínside in_side, a1 1a (a) a\nin; \\E in|side $1 inin in"
    lists = [
        [("in", "***"), ("inside", "<#>"), ("a", "***"), ("in_side", "$1\\"), ("zq", "-")],
        [("in", "inside"), ("inside", "x"), ("a", "")],
        [("in", "*"), ("(a)", "*"), ("*; \\E", "+")],
        [("in side", "*"), ("a\nin", "*"), ("side", "|")],
        [("inside", "[x y]"), ("in", "y in_ z"), ("a1", "x")],
        [],
    ]
    kind = "doc_id int, text string, items array<struct<old:string,new:string>>"
    rows = spark.createDataFrame([(i, t, x) for i, x in enumerate(lists) for t in (text, None, "")], kind)
    both = rows.select(reviewed.replace_listed(F.col("text"), F.col("items")).alias("once"), pii.replace_all(F.col("text"), F.col("items")).alias("fold"))
    assert [r.once for r in both.collect()] == [r.fold for r in both.collect()]
    assert both.first().once.replaced == 8
