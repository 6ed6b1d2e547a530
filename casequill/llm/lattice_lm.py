"""Probability of texts under a subword lattice, summed over all segmentations.

A text is its lower-cased words and one end. A word is a beginning mark and its letters, and every way to cut
it into pieces of an existing vocabulary counts: the forward recursion sums their products, in
logarithms, letter by letter. The pieces' weights start from the vocabulary's own scores and are
fitted to the corpus by rounds of expected counts over all different training words, which the scores then serve
as prior counts for. A letter that is no piece is spelled by the byte pieces.

Words of the training texts are further pieces of the lattice, one arc over the whole word. Their weight is
their count less a discount, over all training tokens, and what the discounts leave over
weights the vocabulary's paths: ``p(w) = max(c - D, 0) / N + D V / N * paths(w)``. D comes from the numbers of words seen once
and twice. Pieces do not cross words, since only a first piece has the mark, so the paths of a word
are computed once for all its occurrences, and the probability of a text is the product over its words and its end.

A task counts the words of a document; the distinct words of the corpus form a table, whose size grows with it. Scores
come back to documents by a join: words that most documents share, up to ``FREQUENT`` and of bounded length, are
broadcast, and only the others are shuffled. So no key is hot.

The base score is the add-one estimate ``(c + 1) / (N + V + 1)`` of the same tokens.

Defined cases: a null text counts as empty and has the end alone. Every row is a document of its own, whatever
its id. Where no document is learned from, the paths alone count and the end costs nothing. No rows in, no rows
out. Bytes that are no UTF-8 read as U+FFFD in the lattice. Only the id and text columns are read, and those that ``held_out`` names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.llm.common import whole_text
from casequill.operators.staging import stage

MARK = "▁"
#: rounds of fitting, and the prior counts that the vocabulary's scores stand for
ROUNDS, PRIOR = 2, 1000.0
#: words whose scores are sent to every executor, and the bytes that such a word has at most
FREQUENT, FREQUENT_BYTES = 100_000, 40
#: discount where no word was seen once or none twice
DISCOUNT = 0.5
_LN10 = math.log(10)
#: letters that go through the lattice at once, and words and bytes of a lot
_CELLS, _LOT_ROWS, _LOT_BYTES = 1 << 16, 50_000, 4 << 20


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, log-probabilities and, by byte, the places of the byte pieces, from a model file with scores.

    A unigram model's scores are log-probabilities. A merge model's are ranks, 0, -1, -2, ...; a
    piece then weighs one over its rank. Pieces that no lower-cased word can hold are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, spelled = [], [], {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled[int(piece[3:5], 16)] = len(pieces)
        elif MARK in piece[1:] or any("A" <= c <= "Z" for c in piece):
            continue
        pieces.append(piece)
        scores.append(model.get_score(i))
    if len(spelled) < 256:
        raise ValueError(f"{path} has no byte pieces")
    weights = np.array(scores)
    letters = np.array([i for i in range(len(pieces)) if i not in set(spelled.values())])
    if len(letters) and (weights[letters] == np.round(weights[letters])).all():
        weights[letters] = -np.log1p(weights[letters].max() - weights[letters])
        weights[list(spelled.values())] = weights[letters].min()
    weights -= np.logaddexp.reduce(weights)
    return pieces, weights, np.array([spelled[b] for b in range(256)])


class Lattice:
    """All segmentations of words into pieces; logarithms are natural. Words of equal length go letter by letter together."""

    def __init__(self, pieces: list[str], weights: np.ndarray, spelled: np.ndarray) -> None:
        self.weights, self.spelled = weights, spelled
        bytes_ = set(spelled.tolist())
        whole = [(place, piece) for place, piece in enumerate(pieces) if place not in bytes_]
        self.letters = np.array(sorted({ord(c) for _, piece in whole for c in piece}) or [0], np.int64)
        code = {c: i for i, c in enumerate(self.letters.tolist())}
        steps: dict[int, int] = {}  # from node and letter to node; 0 and 1 are the roots of first and of inner pieces
        ends = {}
        for place, piece in whole:
            node = 0 if piece.startswith(MARK) else 1
            for letter in piece:
                node = steps.setdefault(node * len(code) + code[ord(letter)], len(steps) + 2)
            ends[node] = place
        self.steps = np.array(sorted(steps) or [-1], np.int64)
        self.nodes = np.array([steps[x] for x in self.steps.tolist()] if steps else [0], np.int64)
        self.ends = np.full(len(steps) + 2, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.longest = max((len(piece) for _, piece in whole), default=1)

    def _bytes(self, point: int) -> np.ndarray:
        return self.spelled[list(chr(point).encode("utf-8", "replace"))]

    def _blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length and their code points, the mark first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            n = int(lengths[same[0]]) + 1 if len(same) else 1
            for start in range(0, len(same), max(1, _CELLS // n)):
                few = same[start : start + max(1, _CELLS // n)]
                text = "".join(MARK + words[i] for i in few.tolist())
                yield few, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(few), n).astype(np.int64)

    def _arcs(self, points: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and pieces of the arcs from the letters ``low`` to ``high - 1`` on, by word, letter and length less one.

        Piece -1 with a weight spells a letter in bytes, where it is no piece.
        """
        words, n = points.shape
        own = points[:, low : high + self.longest]
        codes = np.minimum(np.searchsorted(self.letters, own), len(self.letters) - 1)
        codes = np.where(self.letters[codes] == own, codes, -1)
        found = []
        word, at = np.divmod(np.arange(words * (high - low)), high - low)
        node = (at + low > 0).astype(np.int64)
        for length in range(self.longest):
            inside = at + low + length < n
            word, at, node = word[inside], at[inside], node[inside]
            code = codes[word, at + length]
            key = node * len(self.letters) + code
            step = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            ok = (self.steps[step] == key) & (code >= 0)
            word, at, node = word[ok], at[ok], self.nodes[step[ok]]
            if not len(node):
                break
            piece = self.ends[node]
            hit = piece >= 0
            found.append((word[hit], at[hit], piece[hit]))
        weights = np.full((words, high - low, max(1, len(found))), -np.inf)
        pieces = np.full(weights.shape, -1, np.int32)
        for length, (word, at, piece) in enumerate(found):
            weights[word, at, length], pieces[word, at, length] = self.weights[piece], piece
        odd = pieces[:, :, 0] < 0
        letters, place = np.unique(points[:, low:high][odd], return_inverse=True)
        weights[:, :, 0][odd] = np.array([self.weights[self._bytes(x)].sum() for x in letters.tolist()])[place] if len(letters) else 0
        return weights, pieces

    def _alpha(self, points: np.ndarray) -> np.ndarray:
        """Log-sums of all beginnings, from the empty one on; long words go on in parts."""
        words, n = points.shape
        wide = self.longest
        alpha = np.full((words, wide + n + 1), -np.inf)  # shifted, so that every end has ``wide`` places before it
        alpha[:, wide] = 0
        for low in range(0, n, _CELLS):
            high, base = min(n, low + _CELLS), max(0, low + 1 - wide)
            weights, _ = self._arcs(points, base, high)
            most = weights.shape[2]
            ending = np.full((high - low, words, most), -np.inf)  # by end, the shortest arc last
            for length in range(1, most + 1):
                first = max(base, low + 1 - length)
                if first <= high - length:
                    arcs = weights[:, first - base : high + 1 - length - base, length - 1]
                    ending[first + length - 1 - low : high - low, :, most - length] = arcs.T
            for end in range(low + 1, high + 1):
                alpha[:, wide + end] = _log_sum(alpha[:, wide + end - most : wide + end] + ending[end - 1 - low])
        return alpha[:, wide:]

    def forward(self, words: list[str]) -> np.ndarray:
        """The sum over all segmentations of each word."""
        sums = np.zeros(len(words))
        for places, points in self._blocks(words):
            sums[places] = self._alpha(points)[:, -1]
        return sums

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is used in the words, over all segmentations by their shares."""
        counts, wide = np.zeros(len(self.weights)), self.longest
        for _, points in self._blocks(words):
            alpha, n = self._alpha(points), points.shape[1]
            beta = np.full((len(points), n + 1 + wide), -np.inf)
            beta[:, n] = 0
            for low in range((n - 1) // _CELLS * _CELLS, -1, -_CELLS):
                high = min(n, low + _CELLS)
                weights, pieces = self._arcs(points, low, high)
                most = weights.shape[2]
                for i in range(high - 1, low - 1, -1):
                    beta[:, i] = _log_sum(weights[:, i - low] + beta[:, i + 1 : i + 1 + most])
                whole = pieces >= 0
                word, i, length = np.nonzero(whole)
                used = np.exp(alpha[word, low + i] + weights[whole] + beta[word, low + i + length + 1] - alpha[word, -1])
                counts += np.bincount(pieces[whole], used, len(counts))
                odd = ~whole[:, :, 0]
                word, i = np.nonzero(odd)
                used = np.exp(alpha[word, low + i] + weights[:, :, 0][odd] + beta[word, low + i + 1] - alpha[word, -1])
                letters, place = np.unique(points[word, low + i], return_inverse=True)
                for letter, times in zip(letters.tolist(), np.bincount(place, used).tolist()):
                    np.add.at(counts, self._bytes(letter), times)
        return counts


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log(sum(exp(x))) along the last axis; no row is all -inf."""
    if x.shape[1] == 1:
        return x[:, 0]
    most = x.max(axis=1)
    x -= most[:, None]
    return most + np.log(np.exp(x, out=x).sum(axis=1))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in lots that are worth the while; the first column has the words."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.column(0).nbytes
        if rows >= _LOT_ROWS or size >= _LOT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _decoded(words: pa.ChunkedArray) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words.to_pylist()]


def _words(docs: DataFrame, text: str, doc_id: str, held_out: Column) -> DataFrame:
    """One row per document: row, id, held_out, n_tokens, words, counts. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                found = [Counter(x.as_py().lower().split()) for x in few.column(2)]
                words = pa.array([list(x) for x in found], pa.list_(pa.binary()))
                counts = pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))
                tokens = pa.array([x.total() + 1 for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*few.columns[:2], tokens, words, counts], ["id", "held_out", "n_tokens", "words", "counts"])

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), whole_text(text).cast("binary").alias("body")
    )
    made = rows.mapInArrow(run, "id bigint, held_out boolean, n_tokens bigint, words array<binary>, counts array<int>")
    return stage(made.withColumn("row", F.monotonically_increasing_id()))


def _each_word(documents: DataFrame) -> DataFrame:
    return documents.select("row", "held_out", F.inline(F.arrays_zip("words", "counts")).alias("word", "k"))


def fit(words: DataFrame, vocabulary: tuple, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log-probabilities of the pieces after some rounds over the training words (``word``, different ones)."""
    pieces, start, spelled = vocabulary
    weights = start
    for _ in range(rounds):
        lattice = _Shared(words.sparkSession, pieces, weights, spelled)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, own = np.zeros(len(start)), lattice.here()
            for lot in _together(batches):
                counts += own.expected(_decoded(lot.column(0)))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["piece", "used"])

        # rounded, so that the order of sums makes no difference; a row for each piece of the vocabulary at most
        used = words.select("word").mapInArrow(run, "piece bigint, used double").groupBy("piece").agg(F.sum(F.round(F.col("used") * 1e6).cast("bigint")))
        counts = prior * np.exp(start)
        for piece, n in used.collect():
            counts[piece] += n / 1e6
        weights = np.log(counts / counts.sum())
    return weights


class _Shared:
    """A lattice that tasks build once for each Python worker, from pieces that Spark broadcasts (bounded by the vocabulary)."""

    _made: dict = {}

    def __init__(self, spark: SparkSession, pieces: list[str], weights: np.ndarray, spelled: np.ndarray) -> None:
        self.parts = spark.sparkContext.broadcast((pieces, weights, spelled))

    def here(self) -> Lattice:
        key = self.parts._path if hasattr(self.parts, "_path") else id(self.parts)
        if key not in self._made:
            self._made.clear()
            self._made[key] = Lattice(*self.parts.value)
        return self._made[key]


def _scored(words: DataFrame, vocabulary: tuple, weights: np.ndarray, facts: dict) -> DataFrame:
    """(word, known, base, score, paths) of different words (word, c); logarithms to the base 10."""
    shared = _Shared(words.sparkSession, vocabulary[0], weights, vocabulary[2])
    n, kinds, discount = facts["n"], facts["kinds"], facts["discount"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.here()
        for lot in _together(batches):
            c = lot.column(1).to_numpy().astype(float)
            paths = lattice.forward(_decoded(lot.column(0)))
            score = paths
            if n:
                with np.errstate(divide="ignore"):
                    score = np.logaddexp(np.log(np.maximum(c - discount, 0) / n), math.log(discount * kinds / n) + paths)
            base = np.log10((c + 1) / (n + kinds + 1))
            columns = [lot.column(0).combine_chunks(), pa.array(c > 0), pa.array(base), pa.array(score / _LN10), pa.array(paths / _LN10)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "known", "base", "score", "paths"])

    return words.select("word", "c").mapInArrow(run, "word binary, known boolean, base double, score double, paths double")


def score_documents(
    docs: DataFrame, vocabulary: str, held_out: Column, text: str = "text", doc_id: str = "doc_id",
    rounds: int = ROUNDS, prior: float = PRIOR, frequent: int = FREQUENT,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score and paths_score, without whole words."""
    pieces = read_vocabulary(vocabulary)
    documents = _words(docs, text, doc_id, held_out)
    seen = F.sum(F.when(~F.col("held_out"), F.col("k")).otherwise(0)).alias("c")
    words = stage(_each_word(documents).groupBy("word").agg(seen, F.count("*").alias("held")))
    tokens, kinds, once, twice = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    ends = documents.where("not held_out").count()
    n, kinds = tokens + ends, kinds + (ends > 0)
    facts = {"n": n, "kinds": kinds, "discount": once / (once + 2 * twice) if once and twice else DISCOUNT}
    weights = fit(words.where("c > 0"), pieces, rounds, prior)
    scores = stage(_scored(words, pieces, weights, facts).join(words.select("word", "held"), "word"))
    # the scores of words that many documents have are small enough to send: rows and the bytes of a row are bounded
    common = scores.where(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("held"), "word").limit(frequent)
    common = stage(common.drop("held"))
    rare = scores.drop("held").join(F.broadcast(common.select("word")), "word", "left_anti")
    each = _each_word(documents).select("row", "word", "k")
    add = [F.sum(F.col("k") * F.col(x)).alias(x) for x in ("base", "score", "paths")] + [F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("known")]
    often = each.join(F.broadcast(common), "word").groupBy("row").agg(*add)
    seldom = each.join(F.broadcast(common.select("word")), "word", "left_anti").join(rare, "word").groupBy("row").agg(*add)
    sums = often.union(seldom).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("base", "score", "paths", "known")])
    base_end = math.log10((ends + 1) / (n + kinds + 1))
    end = math.log10(max(ends - facts["discount"], 1e-9) / n) if n else 0.0
    zero = lambda name: F.coalesce(name, F.lit(0))
    return documents.select("row", "id", "held_out", "n_tokens").join(sums, "row", "left").select(
        "id", "held_out", "n_tokens", (zero("known") + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (zero("base") + base_end).alias("base_score"),
        (zero("score") + end).alias("score"), (zero("paths") + end).alias("paths_score"),
    )
