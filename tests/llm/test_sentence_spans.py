import re

import edge

from casequill.llm import sentence_spans


def brute(data, run=3, long_words=30, least=10):
    """Removed sentence numbers of each (id, text)."""
    spans, parts_of = {}, {}
    for doc_id, text in sorted({(i, t or "") for i, t, *_ in data}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        parts = [p for p in re.split(r"(?<=\n)|(?<=[.!?][ \t])", text) if p]
        parts_of[doc_id, text] = parts
        worded = [(i, re.sub("[\t-\r ]+", " ", p).strip(" ").lower()) for i, p in enumerate(parts)]
        worded = [(i, p) for i, p in worded if p]
        for length in range(1, run + 1):
            for k in range(len(worded) - length + 1):
                own = worded[k : k + length]
                n = sum(len(p.split(" ")) for _, p in own)
                if n >= (least if length == run else max(least, long_words)):
                    spans.setdefault("\n".join(p for _, p in own), []).append(((doc_id, text), own[0][0], own[-1][0]))
    removed = {}
    for places in spans.values():
        places.sort(key=lambda s: (s[0][0] is not None, s[0][0] or 0, s[1], s[2]))
        for place, at, to in places[1:]:
            removed.setdefault(place, set()).update(range(at, to + 1))
    return {k: sorted(v) for k, v in removed.items()}, parts_of


def _passage(n):
    return " ".join(f"Part {n} of a passage that many texts share, sentence {i} of it." for i in range(6))


def _data():
    data = [r for r in edge.rows() if r[0] != 1 and r[1] != edge.rows()[1][1]]
    for i in range(20):
        own = " ".join(f"Text {i} has its own sentence {k}." for k in range(5))
        data.append((50 + i, f"{own}\n\n{_passage(i % 2)}\n{own.replace('own', 'other')}", "en", "a"))
    data.append((90, "Is. The. Of.\nIs. The. Of.\nIs. The. Of.", "en", "a"))
    data.append((91, " ".join(["long"] * 35) + ".\nEnd", "en", "a"))
    data.append((92, "Start. " + " ".join(["long"] * 35) + ".  \nOther end", "en", "a"))
    data.append((93, "One two three. Four five six. Seven eight nine ten. " * 4, "en", "a"))
    return data


def test_matches_brute_force(spark):
    data = _data()
    expected, _ = brute(data)
    found = sentence_spans.repeated_sentences(edge.documents(spark, data)).collect()
    assert {r.id: r.removed for r in found} == {k[0]: v for k, v in expected.items()}
    assert 90 not in {r.id for r in found} and {52, 92, 93} <= {r.id for r in found}


def test_cut_documents(spark):
    data = _data()
    expected, parts = brute(data)
    docs = edge.documents(spark, data)
    cut = sentence_spans.cut_documents(docs, mark="gone")
    assert cut.columns == docs.columns + ["gone"]
    rows = {r.doc_id: r for r in cut.collect() if r.doc_id is not None}
    for (doc_id, _), own in parts.items():
        if doc_id in rows and rows[doc_id].text is not None:
            gone = expected.get((doc_id, _), [])
            assert rows[doc_id].text == "".join(p for i, p in enumerate(own) if i not in gone)
    assert rows[3].text is None and _passage(0) in rows[50].text and "passage" not in rows[52].text


def test_repeated_rows_and_empty(spark):
    docs = edge.documents(spark)
    rows = sentence_spans.cut_documents(docs).collect()
    assert len(rows) == len(edge.rows())
    assert sentence_spans.cut_documents(edge.empty(spark)).count() == 0


def test_joins_do_not_change_with_the_size(spark):
    """Repeats grow with the input: small tables run the joins of large ones, and texts are shuffled once."""
    cut = sentence_spans.cut_documents(edge.documents(spark, _data()))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan and plan.count("Join ") == 1
    physical = cut._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in physical and "Broadcast" not in physical
