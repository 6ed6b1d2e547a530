"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every whole text is read once and turned into ``len(STATISTICS)`` numbers, which are written to
the shared folder. The labelled rows among them fit the model: a fixed random map approximates
the features of a Gaussian kernel, each task adds up its part of the normal equations, and the
sums over tasks, a table of a size that depends on ``features`` alone, are solved. Raw scores of
labelled rows that the equations did not use are counted in ``BINS`` bins, from which isotonic
regression gives the probability that a document of that raw score has label 1.

The fit uses at most about ``max_rows`` labelled rows, chosen by a hash of their id; all rows
are scored. Rows whose ``crc32`` of the id as text leaves remainder 0 by 5 are never learned from,
remainder 1 calibrates, the others give the equations.

Defined cases: a null text counts as empty, and empty texts get a score like others. Labels that
are null or not 0 or 1 are ignored, labels of one id are averaged. Without labelled rows of both
kinds every score is 0.5. A null id is never learned from and never held out. Repeated rows are
scored each. No rows in, no rows out. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequill.llm.common import keep_rows, text_tag, whole_text
from casequill.operators.staging import stage

#: the fit uses about so many labelled rows at most
MAX_ROWS = 60_000
#: random features; the normal equations have this number squared plus a few terms
FEATURES = 256
#: kernel width in units of the square root of the number of statistics
WIDTH = 0.7
RIDGE = 1e-3
BINS = 2000
#: a document is taken as good from this probability on
THRESHOLD = 0.3

#: what is counted of a text, in the order of ``statistics``
STATISTICS = [
    "log_bytes", "log_words", "mean_word", "sd_word", "log_longest_word", "upper_bytes", "digit_bytes", "blank_bytes",
    "stop_bytes", "mark_bytes", "symbol_bytes", "wide_bytes", "entropy", "distinct_words", "commonest_word",
    "repeated_neighbours", "distinct_pairs", "capital_words", "shouted_words", "words_with_end_mark", "short_words",
    "symbol_words", "log_lines", "distinct_lines", "words_per_sentence", "compressed",
]

_ENDS = (".", ",", ";", ":", "!", "?")


def statistics(text: str) -> list[float]:
    """Numbers in the order of ``STATISTICS``; all 0 for a text without words."""
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    share = lambda chars: float(held[list(chars)].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts, pairs = Counter(words), set(zip(words, words[1:]))
    lines = text.split("\n")
    full = held[held > 0]
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), float(lengths.std()), math.log1p(int(lengths.max())),
        share(range(65, 91)), share(range(48, 58)), share((9, 10, 11, 12, 13, 32)),
        share(b".?"), share(b",;:'\"-()"), share(b"!#$%&*+/<=>@[\\]^_`{|}~"), share(range(128, 256)),
        float(-(full * np.log2(full)).sum()), len(counts) / n, counts.most_common(1)[0][1] / n,
        sum(map(str.__eq__, words, words[1:])) / n, (len(pairs) + 1) / n,
        sum(map(str.istitle, words)) / n, sum(map(str.isupper, words)) / n, sum(w.endswith(_ENDS) for w in words) / n,
        float((lengths <= 3).mean()), 1 - sum(map(str.isalnum, words)) / n,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(n / (1 + stops)),
        len(zlib.compress(raw, 1)) / size,
    ]


def describe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, tag, stats) of every document; ``tag`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(x.as_py()) for x in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], stats], ["id", "tag", "stats"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_tag(text).alias("tag"), whole_text(text).alias("body"))
    return rows.mapInArrow(run, "id bigint, tag bigint, stats array<double>")


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


@dataclass(frozen=True)
class Model:
    """Centre and spread of the statistics, the random map, the weights, and the calibration's steps."""

    centre: np.ndarray
    spread: np.ndarray
    map: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.centre) / self.spread, -6, 6)
        waves = np.cos(scaled @ self.map + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.values)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of the products of features with each other and with the label; each task sends its sums once."""
    width, size = len(model.centre), len(model.phase) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column(0), width))
            sums += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        if sums[-1, -2]:
            yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(sums.tolist())], ["line", "sums"])

    parts = rows.select("stats", "label").mapInArrow(run, "line bigint, sums array<double>")
    added = parts.select("line", F.posexplode("sums")).groupBy("line", "pos").agg(F.sum("col").alias("col"))
    table = np.zeros((size, size + 1))
    for line, pos, value in added.collect():  # size * (size + 1) numbers, whatever the input
        table[line, pos] = value
    return table[:, :-1], table[:, -1]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` (pooling of adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist()):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[2] += n
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _calibrated(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Steps and values of the calibration, from counts of raw scores in bins."""
    width = len(model.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.floor((model.raw(_matrix(batch.column(0), width)) + 1) / 3 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "label"])

    held = rows.select("stats", "label").mapInArrow(run, "bin bigint, label double")
    counts = sorted(tuple(r) for r in held.groupBy("bin").agg(F.count("*"), F.sum("label")).collect())  # BINS rows at most
    if not counts:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    bins, n, good = (np.array(x, float) for x in zip(*counts))
    return (bins + 0.5) / BINS * 3 - 1, np.clip(isotonic(good / n, n), 0, 1)


def fit(
    described: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
    max_rows: int = MAX_ROWS, features: int = FEATURES, seed: int = 7,
) -> Model | None:
    """The model, or None if the rows to learn from don't hold both labels."""
    known = (
        labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("double").alias("label"))
        .where(F.col("label").isin(0.0, 1.0) & (fold("id") != 0))
        .groupBy("id")
        .agg(F.avg("label").alias("label"))
    )
    limit = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(limit * (1 << 20)))
    rows = stage(described.join(known, "id").withColumn("fold", fold("id")))
    kinds = rows.agg(F.min("label"), F.max("label"), *[f(F.col("stats")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)])
    low, high, *moments = kinds.first()
    if low is None or low == high:
        return None
    centre, spread = np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6)
    random, width = np.random.default_rng(seed), WIDTH * math.sqrt(len(STATISTICS))
    blank = np.zeros(features + 1)
    start = Model(
        centre, spread, random.normal(0, 1 / width, (len(STATISTICS), features)), random.uniform(0, 2 * math.pi, features),
        blank, np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    gram, moment = _normal_equations(rows.where("fold != 1"), start)
    ridge = RIDGE * max(gram[-1, -1], 1) / features
    weights = np.linalg.solve(gram + ridge * np.eye(len(gram)), moment)
    raw = Model(start.centre, start.spread, start.map, start.phase, weights, start.steps, start.values)
    return Model(raw.centre, raw.spread, raw.map, raw.phase, weights, *_calibrated(rows.where("fold = 1"), raw))


def score_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", **fit_options
) -> DataFrame:
    """One row per document: id, tag, held_out, score (probability of label 1)."""
    described = stage(describe(docs, text, doc_id))
    model = fit(described, labels, label, doc_id, **fit_options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _matrix(batch.column(2), len(STATISTICS))
            scores = model.score(stats) if model else np.full(len(stats), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores)], ["id", "tag", "score"])

    scored = described.mapInArrow(run, "id bigint, tag bigint, score double")
    return scored.select("id", "tag", F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score")


def good_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options
) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns as they were."""
    scored = score_documents(docs, labels, text, doc_id, **options)
    low = stage(scored.where(F.col("score") < threshold).select("id", "tag").distinct())
    return keep_rows(docs, doc_id, text, low, low.count(), "left_anti")
