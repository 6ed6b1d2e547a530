import zlib

import edge
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casequill.llm import packing, token_store
from casequill.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aZé09.,'!\n\t \r\x0b\x0c\x85\xa0 漢ñ·²ªДst_-<|>")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_parts_give_the_ids_of_the_whole_text(text):
    encoder = Encoder.of(PATH)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == _ids(encoder.library, text)


@pytest.mark.parametrize("text", ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "<|endoftext|", " <|endoftext|>\n"])
def test_added_tokens_as_the_library_reads_them(library, text):
    assert np.frombuffer(Encoder.of(PATH).encode(text), "<u4").tolist() == _ids(library, text)


def test_full_memos_start_anew(monkeypatch, library):
    from casequill.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_PARTS", 5)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 5)
    encoder, text = Encoder(PATH), " ".join(f"piece{i % 23}, of{i % 7}" for i in range(500))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == _ids(library, text)
    assert len(encoder) <= 5 and len(encoder.pieces) <= 5


def test_piece_lengths():
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.piece_lengths(1, 2048) == [1] and packing.piece_lengths(2048, 2048) == [2048]


def test_packing_matches_brute_force(spark, library):
    docs = edge.documents(spark)
    found = packing.pack(docs, PATH, with_ids=True).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.id, []).append(r)
    numbers = sorted(r.sequence_id for r in found)
    assert numbers == list(range(len(found)))
    lengths = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for doc_id, text, *_ in edge.rows():
        if doc_id in (1, None):
            continue  # repeats, looked at below
        ids = np.array([*_ids(library, text), 1], "<u4")
        pieces = sorted(by_id[doc_id], key=lambda r: r.start)
        assert [p.length for p in pieces] == packing.piece_lengths(len(ids), 2048)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == ids.tolist()
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.offset == 0
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    pieces = packing.piece_lengths(len(_ids(library, edge.rows()[0][1])) + 1, 2048)
    assert len(by_id[1]) == 2 * len(pieces)


def test_packing_empty_and_wrong_size(spark):
    assert packing.pack(edge.empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge.empty(spark), PATH, size=1000)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    hashed = token_store.PerfectHash.build(keys)
    assert np.sort(hashed.slots(keys)).tolist() == list(range(len(keys)))
    assert len(token_store.PerfectHash.build(np.zeros(0, np.int64)).slots(np.array([5]))) == 1


@pytest.mark.parametrize("shard_bytes", [1 << 20, 400])
def test_store_round_trip(spark, library, shard_bytes):
    folder, manifest = token_store.write_store(edge.documents(spark), PATH, shard_bytes=shard_bytes, partitions=3)
    found = token_store.read_store(folder, manifest, with_ids=True).orderBy("start").collect()
    known = sorted((r for r in edge.rows() if r[0] is not None), key=lambda r: r[0])
    assert [r.key for r in found] == [None, None] + [r[0] for r in known]
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    for r, (_, text, *_) in zip(found[2:], known):
        assert np.frombuffer(r.ids, "<u4").tolist() == [*_ids(library, text), 2]


def test_store_lookup(spark, library):
    folder, manifest = token_store.write_store(edge.documents(spark), PATH, shard_bytes=400, partitions=3)
    asked = spark.createDataFrame([(1,), (10,), (10,), (77,), (-5,), (None,)], "doc_id bigint")
    found = token_store.lookup(folder, manifest, asked).collect()
    assert sorted(r.key for r in found) == [1, 1, 10]
    texts = {r[0]: r[1] for r in edge.rows()}
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == [*_ids(library, texts[r.key]), 2]


def test_store_empty(spark):
    folder, manifest = token_store.write_store(edge.empty(spark), PATH)
    assert manifest.count() == 0 and token_store.read_store(folder, manifest).count() == 0
    assert token_store.lookup(folder, manifest, spark.range(3).select(F.col("id").alias("doc_id"))).count() == 0
