"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are put together for every page:

* text: the likelihood of its visible text under each language's letter trigrams, which are
  counted over all labelled documents. Trigrams of one text depend on each other, so the
  likelihood counts like that of ``LETTERS`` independent ones at most.
* markup: how likely the language that the page declares is, given the true one;
* address: how likely the suffix of its host is, given the true one;
* host: a prior of the host's pages, smoothed towards its domain's, that towards all pages'.

The last three are learned from the pages themselves, by grouped sums of what the text alone
says about each page. A page's own part is taken out of the sums before they judge it. The
posterior is the normalised product.

Sums are arrays with a number for each language, added before the shuffle, so a host with a third
of all pages is one row for each task. They come back to the pages by joins: a table within the
broadcast bound is sent to the tasks, others are shuffled and adaptive execution splits hot keys.

Defined cases: a null text, address or declaration counts as empty; a page without any is judged
by the prior of all pages. Documents without a language are not learned from; without any labelled
document the language is null. Repeated rows count as pages of their own. No rows in, no rows out.
Only the id, address and page columns are read, and of documents the text and language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequill.functions.spans import let
from casequill.llm.common import BROADCAST_BYTES, whole_text
from casequill.operators.staging import stage

#: trigrams are hashed to so many numbers
BUCKETS = 1 << 14
#: independent trigrams that a text counts for at most
LETTERS = 40
#: pseudo-count of a trigram, of a declaration or suffix, and weight of the parent in a host's prior
TRIGRAM_PSEUDO, VALUE_PSEUDO, PARENT = 0.5, 1.0, 5.0
#: values of a declaration or suffix that share its pseudo-count
VALUES = 50

_HIDDEN = ("script", "style", "noscript", "template")
_ENTITY = re.compile(r"&(?:#?\w{1,10});")


def visible_text(html: str) -> str:
    """Text outside tags, comments and hidden elements. One pass from left to right."""
    out, at = [], 0
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        name = html[start + 1 : start + 10].lower()
        if name.startswith("!--"):
            end, step = html.find("-->", start + 4), 3
        elif hidden := next((h for h in _HIDDEN if name.startswith(h)), None):
            close = re.compile(rf"</{hidden}\s*>", re.I).search(html, start)
            end, step = (close.end() - 1, 1) if close else (-1, 0)
        else:
            end, step = html.find(">", start), 1
        if end < 0:  # nothing that is visible follows
            at = len(html)
            break
        at = end + step
    return _ENTITY.sub(" ", " ".join([*out, html[at:]]))


def trigrams(text: str) -> np.ndarray:
    """Numbers of the letter trigrams of a text; what is no letter is a single space."""
    letters = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not letters:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)
    return ((mixed ^ mixed >> np.uint64(15)) % np.uint64(BUCKETS)).astype(np.int64)


def count_trigrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all labelled documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = held.setdefault(language, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(value.as_py()), minlength=BUCKETS)
        for language, counts in held.items():
            some = np.flatnonzero(counts)
            columns = [pa.array([language] * len(some), pa.string()), pa.array(some), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), whole_text(text).alias("body"))
    counted = rows.mapInArrow(run, "lang string, bucket bigint, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram number in each of them."""
    counts = count_trigrams(docs, text, lang).collect()  # languages times BUCKETS rows at most
    languages = sorted({r.lang for r in counts})
    table = np.full((len(languages), BUCKETS), TRIGRAM_PSEUDO)
    for r in counts:
        table[languages.index(r.lang), r.bucket] += r.n
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], html: str, url: str, page_id: str) -> DataFrame:
    """(id, host, domain, suffix, declared, likely): log likelihoods of the text, largest 0, one for each language."""
    languages, table = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = []
            for value in batch.column(3):
                found = trigrams(visible_text(value.as_py()))
                sums = table[:, found].sum(axis=1) * min(1, LETTERS / max(1, len(found)))
                likely.append((sums - sums.max(initial=-np.inf)).tolist() if len(languages) else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(likely, pa.list_(pa.float64()))], ["id", "host", "declared", "likely"]
            )

    host = F.lower(F.regexp_extract(whole_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(whole_text(html), r"(?i)<html\s(?:[^>]*\s)?lang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select(F.col(page_id).alias("id"), host.alias("host"), declared.alias("declared"), whole_text(html).alias("page"))
    kind = dict(rows.dtypes)["id"]
    told = rows.mapInArrow(run, f"id {kind}, host string, declared string, likely array<double>")
    labels = F.split("host", r"\.")
    return told.select(
        "id", "host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"), "declared", "likely",
    )


def _normalised(logs: Column) -> Column:
    """exp of an array, scaled to the sum 1."""
    scaled = lambda xs: F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    shares = lambda xs: let(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(xs, lambda x: x / s))
    return let(let(logs, scaled), shares)


def _with_sums(pages: DataFrame, key: str, n: int) -> DataFrame:
    """Pages with the sums ``n_<key>`` of what the texts of all other pages of the same key say."""
    sums = stage(pages.groupBy(key).agg(F.array(*[F.sum(F.col("q")[i]) for i in range(n)]).alias("sums")))
    small = sums.count() * (64 + 8 * n) <= BROADCAST_BYTES
    joined = pages.join(F.broadcast(sums) if small else sums, key)
    others = F.zip_with("sums", "q", lambda s, q: F.greatest(s - q, F.lit(0.0)))
    return joined.withColumn(f"n_{key}", others).drop("sums")


def identify(
    pages: DataFrame, docs: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id",
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """One row per page: id, host, declared, text_lang, lang, score (posterior of ``lang``)."""
    model = train(docs, text, lang)
    languages = model[0]
    told = text_evidence(pages, model, html, url, page_id)
    if not languages:
        return told.select("id", "host", "declared", *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")], F.lit(None).cast("double").alias("score"))
    n = len(languages)
    told = stage(told.withColumn("q", _normalised(F.col("likely"))))
    everywhere = told.agg(*[F.coalesce(F.sum(F.col("q")[i]), F.lit(0.0)) for i in range(n)]).first()
    everything = sum(everywhere)
    overall = [(x + 1) / (everything + n) for x in everywhere]
    rows = told
    for key in ("host", "domain", "suffix", "declared"):
        rows = _with_sums(rows, key, n)

    def smoothed(counts: Column, parent: Column) -> Column:
        """Shares of counts, drawn towards the parent's shares."""
        of = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return let(of, lambda all_: F.zip_with(counts, parent, lambda x, p: (x + PARENT * p) / (all_ + PARENT)))

    def given_language(counts: Column) -> Column:
        """Log likelihood of a value for each language, from the pages of that value and of all values."""
        totals = F.array(*[F.lit(x) for x in everywhere])
        return F.zip_with(counts, totals, lambda x, t: F.log((x + VALUE_PSEUDO / VALUES) / (t + VALUE_PSEUDO)))

    rows = rows.withColumn("domain_prior", smoothed(F.col("n_domain"), F.array(*[F.lit(x) for x in overall])))
    rows = rows.withColumn("prior", smoothed(F.col("n_host"), F.col("domain_prior")))
    evidence = F.transform("prior", lambda p: F.log(p))
    for more in (F.col("likely"), given_language(F.col("n_suffix")), given_language(F.col("n_declared"))):
        evidence = F.zip_with(evidence, more, lambda a, b: a + b)
    rows = rows.withColumn("posterior", _normalised(evidence))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return rows.select(
        "id", "host", "declared", best("q").alias("text_lang"), best("posterior").alias("lang"), F.array_max("posterior").alias("score")
    )
