import math

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from casequill.llm import language_id

EN = "the house and the garden were quiet that morning when nothing happened "
DE = "der garten und das haus waren ruhig an jenem morgen als nichts geschah "


def _docs(spark):
    return edge.documents(spark, [(i, EN * 3 if i % 2 else DE * 3, "en" if i % 2 else "de", "a") for i in range(12)] + [(50, "??", None, "a")])


def _pages():
    rows = []
    for i in range(30):
        own = "en" if i < 20 else "de"
        text = EN if own == "en" else DE
        rows.append((i, f"http://{'uk' if own == 'en' else 'berlin'}.example.{'com' if own == 'en' else 'de'}/{i}", f'<html lang="{own}"><p>{text[: 10 + i]}</p></html>'))
    rows += [
        (100, "http://new.example.de/x", "<html><p>1 2 3</p></html>"),
        (101, "https://user@UK.example.com:80/x", None),
        (102, None, None),
        (103, "not an address", "<script>" + EN * 10),
        (104, "http://berlin.example.de/", "<html class=x LANG=de-AT><style>" + EN * 5 + "</style><!-- " + EN + "-->" + DE * 4000),
        (105, "http://uk.example.com/", "<" * 50_000),
        (105, "http://uk.example.com/", "<" * 50_000),
        (None, "http://uk.example.com/", EN),
    ]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("other") for c in [*edge.CLASHING, "host", "q", "likely", "prior"]})


def test_visible_text():
    assert language_id.visible_text("<p>a<b>b</b><!-- no > --><SCRIPT>x</p></Script >c&amp;d<style>z").split() == ["a", "b", "c", "d"]


def test_posteriors_match_brute_force(spark):
    model = language_id.train(_docs(spark))
    languages, table = model
    assert languages == ["de", "en"]
    rows = []
    for page_id, url, html in _pages():
        found = language_id.trigrams(language_id.visible_text(html or ""))
        likely = table[:, found].sum(axis=1) * min(1, language_id.LETTERS / max(1, len(found)))
        q = np.exp(likely - likely.max())
        host = (url or "").split("://")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (url or "") else ""
        low = (html or "").lower()
        declared = low.split("lang=")[1].strip('"')[:2] if "<html" in low and "lang=" in low else ""
        rows.append((page_id, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared, likely, q / q.sum()))
    total = sum(r[6] for r in rows)
    expected = []
    for r in rows:
        others = [sum((o[6] for o in rows if o[k] == r[k]), np.zeros(2)) - r[6] for k in (1, 2, 3, 4)]
        prior = (total + 1) / (total.sum() + 2)
        for counts in (others[1], others[0]):
            prior = (np.maximum(counts, 0) + 5 * prior) / (np.maximum(counts, 0).sum() + 5)
        logs = np.log(prior) + r[5] - r[5].max()
        for counts in others[2:]:
            logs = logs + np.log((np.maximum(counts, 0) + 1 / 50) / (total + 1))
        p = np.exp(logs - logs.max())
        p /= p.sum()
        expected.append((r[0], r[1], r[4], languages[int(p.argmax())], p.max()))
    found = language_id.identify(_frame(spark, _pages()), _docs(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for got, want in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert (got.id, got.host, got.declared, got.lang) == want[:4]
        assert math.isclose(got.score, want[4], rel_tol=1e-6)
    by_id = {r.id: r for r in found}
    assert by_id[100].lang == "de" and by_id[101].lang == "en" and by_id[104].lang == "de"


def test_counts_cover_all_documents(spark):
    counted = language_id.count_trigrams(_docs(spark)).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert {r.lang: r.n for r in counted} == {"en": 6 * len(language_id.trigrams(EN * 3)), "de": 6 * len(language_id.trigrams(DE * 3))}


@pytest.mark.parametrize("pages", [_pages(), []])
def test_no_labelled_documents_and_empty(spark, pages):
    found = language_id.identify(_frame(spark, pages), edge.empty(spark)).collect()
    assert len(found) == len(pages) and all(r.lang is None for r in found)
