import itertools
import random

import edge
import numpy as np
import pytest
import xxhash

from casequill.llm import components, simhash


def brute_print(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_of(nodes, near):
    low = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if near(a, b) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_fingerprints(spark):
    texts = [t or "" for _, t, *_ in edge.rows()]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_masks_cover_every_pair_within_the_radius(seed):
    masks = simhash.covering_masks(4, seed)
    assert len(masks) == 31
    rng = random.Random(seed)
    for _ in range(20_000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & bits for m in masks)


def test_search_tree_connects_like_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    prints = np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), False))) for b in base for _ in range(12)])
    names = np.arange(len(prints))
    tree = simhash.search_tree(names, prints, 4)
    assert len(tree) < len(names)
    expected = components_of(names.tolist(), lambda a, b: int(prints[a] ^ prints[b]).bit_count() <= 4)
    assert components_of(names.tolist(), lambda a, b: (a, b) in set(tree) or (b, a) in set(tree)) == expected


@pytest.mark.parametrize("crowded", [4096, 3])
def test_near_copies_match_brute_force(spark, crowded):
    rng = random.Random(5)
    data = list(edge.rows())
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(5)]
    for i in range(60):
        words = list(base[i % 5])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        data.append((100 + i, " ".join(words), "en", "a"))
    found = simhash.near_copies(edge.documents(spark, data), crowded=crowded).collect()
    assert len(found) == len(data)
    prints = {}
    for doc_id, text, *_ in data:
        prints.setdefault(brute_print(text or ""), []).append(doc_id)
    low = {p: min((i for i in ids if i is not None), default=None) for p, ids in prints.items()}
    near = components_of(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 4 or low[a] is not None and low[a] == low[b])
    least = {}
    for p in prints:
        least.setdefault(near[p], []).append(low[p])
    for r in found:
        known = [i for i in least[near[r.print & (2**64 - 1)]] if i is not None]
        assert r.component == min(known, default=None)


def test_null_ids_carry_links(spark):
    """Two documents beyond the radius are joined by one without an id; without any id the component is null."""
    rng, words = random.Random(3), [f"w{i}" for i in range(400)]
    chain = [" ".join(words)]
    while (brute_print(chain[0]) ^ brute_print(chain[-1])).bit_count() <= 4:
        words[rng.randrange(len(words))] = f"x{len(chain)}"
        chain.append(" ".join(words))
    between = next(t for t in chain if all((brute_print(t) ^ brute_print(chain[e])).bit_count() <= 4 for e in (0, -1)))
    data = [(9, chain[0], "en", "a"), (5, chain[-1], "en", "a"), (None, between, "en", "a"), (-3, "some other text", "en", "a")]
    found = simhash.near_copies(edge.documents(spark, data)).collect()
    assert sorted(r.component for r in found) == [-3, 5, 5, 5]
    alone = edge.documents(spark, [(None, chain[0], "en", "a"), (None, chain[1], "en", "a"), (1, "else", "en", "a")])
    assert [r.component for r in simhash.near_copies(alone).collect()].count(None) == 2


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600), (7, 7), (3, 4)], "a bigint, b bigint")
    found = {r.node: r.component for r in components.smallest_reachable(links).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 600: 500}


def test_representatives(spark):
    docs = edge.documents(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 4 not in ids and {1, 3, 6, 8, 9, 10} <= set(ids)
    assert simhash.near_copies(edge.empty(spark)).count() == 0
