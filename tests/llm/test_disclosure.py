import math
import re

import edge
from pyspark.sql import functions as F

from casequill.llm import disclosure, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_base(text):
    kinds = [k for k in PLAIN if k != "email" or "@" in text]  # the plain pattern is slow on long runs without one
    return [(k, m.start(), m.end()) for k in kinds for m in re.finditer(PLAIN[k], text) if _valid(k, m[0])]


HARD = [
    "a@b.c_d@e.f and x@y z@w.v. mail a@b@c.d, -@-.-; a@b..c %+@x.y.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 0.0.0.0 99999999999999999999.1.1.1 1..2.3.4",
    "4111 1111-1111 1111, 4111  1111 1111 1111; 4111111111111112 5500-0000-0000-0004-",
    "+1 (386) 555-3733 +12 3 +1() 5 ++44 20 7946 0958. +1234567890123456 +49 (0) 30-123456",
    "\u0001é漢 x@y.zz 漢 10.0.0.1\n+1 2345 67890",
]


def _rows(found, column):
    return [(s.kind, s.start, s.end) for s in found[column]]


def test_base_spans_match_the_plain_patterns(spark):
    data = edge.rows() + [(100 + i, t, "en", "a") for i, t in enumerate(HARD)] + [(200, "9" * 5_000 + " a" + "a" * 5_000 + "@", "en", "a")]
    found = disclosure.spans(edge.documents(spark, data)).collect()
    got = sorted(((r.id, tuple(_rows(r, "spans"))) for r in found), key=repr)
    assert got == sorted(((i, tuple(brute_base(t or ""))) for i, t, *_ in data), key=repr)


def _corpus():
    """An address with a nickname anywhere in its texts, a code that all its texts hold, words that are common elsewhere, and copies."""
    far = "filler words " * 20
    data = []
    for i in range(20):
        data.append((i, f"report {'abcdefgh'[i % 8] * 4} by Zorbo {far} k7 at zed@mail.example.org today number{i} ends", "en", "a"))
    for i in range(20, 28):
        data.append((i, "rarely seen kwib wrote kim@mail.example.org on it", "en", "a"))
    for i in range(28, 600):
        data.append((i, f"report by nobody at all, without an address, today nothing ends {far} {i}", "en", "b"))
    data.append((600, "zorbo alone in a text of another subject", "en", "b"))
    data.append((601, "zorbo again, zed@mail.example.org and ZED@mail.example.org", "en", "b"))
    return data


def brute_words(data):
    """(entity, word) -> (rest, action) by counting with plain loops."""
    texts = {t or "" for _, t, *_ in data}
    words = {t: set(re.findall(r"[^\W_]+", t.lower())) for t in texts}
    of_entity, of_word = {}, {}
    for t in texts:
        for w in words[t]:
            of_word[w] = of_word.get(w, 0) + 1
        for kind, start, end in brute_base(t):
            of_entity.setdefault(f"{kind}:{t[start:end].lower()}", set()).add(t)
    out, z = {}, 1.645
    for entity, held in of_entity.items():
        p = len(held) / len(texts)
        for w in set().union(*(words[t] for t in held)):
            n, k = of_word[w], sum(w in words[t] for t in held)
            q = k / n
            low = (q + z * z / (2 * n) - z * math.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            kl = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
            rest, own = -math.log2(low), -math.log2(p)
            if p < 1 and q > p and rest <= 1 and own - rest >= own / 2 and n * kl >= math.log(1e6):
                out[entity, w] = (rest, "remove" if rest <= 0.25 else "general")
    return out


def brute_spans(data):
    """Text -> all its spans as the query's string."""
    acts, out = brute_words(data), {}
    for text in {t or "" for _, t, *_ in data}:
        base = brute_base(text)
        entities = {f"{kind}:{text[a:b].lower()}" for kind, a, b in base}
        found = []
        for m in re.finditer(r"[^\W_]+", text):
            kinds = [acts[e, m[0].lower()][1] for e in entities if (e, m[0].lower()) in acts]
            if kinds and not any(a < m.end() and m.start() < b for _, a, b in base):
                found.append((max(kinds), m.start(), m.end()))
        out[text] = ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *sorted(found)])
    return out


def _acting(docs):
    found = disclosure.find(docs)
    met = disclosure.meetings(docs, found)
    return {} if met is None else {
        (r.entity, r.word): (r.rest, r.action)
        for r in disclosure.disclosing_words(met, found.select("tag").distinct().count()).collect()
    }


def test_disclosing_words_match_brute_force(spark):
    data = _corpus()
    got, expected = _acting(edge.documents(spark, data)), brute_words(data)
    assert got.keys() == expected.keys()
    assert all(got[k][1] == expected[k][1] and abs(got[k][0] - expected[k][0]) < 1e-9 for k in got)
    actions = {w: a for (_, w), (_, a) in got.items()}
    assert actions["zorbo"] == "general" and actions["k7"] == "remove"
    assert not set(actions) & {"kwib", "report", "today", "filler", "number1"}


def test_query_matches_brute_force(spark, tmp_path):
    data = _corpus() + edge.rows() + [(700 + i, t, "en", "a") for i, t in enumerate(HARD)]
    data.append((800, "Zorbo@x k7 " * 2000 + "zed@mail.example.org k7.Zorbo@mail.example.org", "en", "a"))
    edge.documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.spans) for r in queries.op4_disclosure(spark, str(tmp_path)).collect()), key=repr)
    expected = brute_spans(data)
    assert got == sorted(((i, expected[t or ""]) for i, t, *_ in data), key=repr)
    assert sum("remove" in s for _, s in got) == 21 and any("general" in s for _, s in got)


def test_a_value_in_many_texts_leaves_common_and_single_words_alone(spark):
    """A third of all texts share an address; their rows grow with their own words only."""
    data = [(i, f"own{i} word{i % 7} a{i}b {'desk@mail.example.org' if i % 3 == 0 else ''}", "en", "a") for i in range(900)]
    docs = edge.documents(spark, data)
    assert {w for _, w in _acting(docs)} == {"desk", "mail", "example", "org"}  # the address's own parts
    met = disclosure.meetings(docs, disclosure.find(docs))
    assert met.count() <= 300 * 8


def test_the_answer_settles_as_the_corpus_grows(spark):
    seen = "sightings INT, total DOUBLE"
    pairs = spark.createDataFrame([(n, t) for n in (1, 2, 3, 14, 15) for t in (1e4, 1e6, 1e9)], seen)
    made = pairs.selectExpr("total", "'e' entity", "string(sightings) word", "sightings together", "double(sightings) of_word", "sightings of_entity")
    for total in (1e4, 1e6, 1e9):
        got = disclosure._rated(made.where(F.col("total") == total), total, 1.0, 0.25).collect()
        assert {(r.word, r.action) for r in got} == {("3", "general"), ("14", "general"), ("15", "remove")}


def test_sanitise(spark):
    docs = edge.documents(spark, _corpus())
    clean = disclosure.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] == f"report aaaa by [WORD] {'filler words ' * 20}  at [EMAIL] today number0 ends"
    assert texts[20] == "rarely seen kwib wrote [EMAIL] on it"
    assert texts[600] == "zorbo alone in a text of another subject"
    assert texts[601] == "[WORD] again, [EMAIL] and [EMAIL]"


def test_sanitise_overlaps_and_edges(spark):
    docs = edge.documents(spark, edge.rows() + [(300, "+4111111111111111 x", "en", "a")])
    texts = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert texts[300] == "+[CARD] x" or texts[300] == "[PHONE] x"
    assert texts[10].endswith("Mail me at [EMAIL] now") and texts[4] == "" and texts[3] is None
    assert disclosure.sanitise(edge.empty(spark)).count() == 0 and disclosure.spans(edge.empty(spark)).count() == 0
