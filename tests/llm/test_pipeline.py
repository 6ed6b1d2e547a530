import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing import brute as brute_mix
from test_simhash import brute_print, components_of
from tokenizers import Tokenizer

import corpus_pipeline
from casequill.llm import packing, quality, queries
from casequill.llm.common import table

SF = "/root/testdata/sf0.001"


def test_rows_match_brute_force(spark):
    """Scores are the classifier's own; every other decision is recomputed."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {r.id: r.score for r in quality.score_documents(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.collect() if scores[r.doc_id] >= 0.3}
    low = {}
    for i in sorted(rows):
        low.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i].text or ""), i)
    kept = sorted(low.values())
    prints = {i: brute_print(rows[i].text or "", 5) for i in kept}
    component = components_of(kept, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    kept = [i for i in kept if component[i] == i]
    drawn = brute_mix([(i, rows[i].text, rows[i].lang, rows[i].source) for i in kept])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, _, _ in drawn:
        ids, start = np.array([*library.encode(rows[i].text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for length in packing.piece_lengths(len(ids), 2048):
            expected.append((i, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
            start += length
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(expected)
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_stages_keep_columns_and_stand_empty_tables(spark):
    rows = table(spark, SF, "documents").where("false").withColumn("kept", F.lit(1))
    for name, apply in corpus_pipeline.STAGES:
        before = rows.columns
        rows = apply(spark, rows, SF)
        assert rows.count() == 0, name
        assert rows.columns == before or name == "packing"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_have_rows_for_their_whole_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    if name.split("_")[0] in ("op11", "op12"):  # rows of anchors and of words
        assert found.count() > 0
        return
    names = {"op1": "pages", "op6": "embeddings"}
    key = {"op1": "page_id", "op6": "vec_id"}.get(name.split("_")[0], "doc_id")
    whole = table(spark, SF, names.get(name.split("_")[0], "documents"))
    assert found.select(key).distinct().count() == whole.count()
