"""Hard negatives by an exact search of an inverted multi-index.

A row is a vector of integers: every component times ``scale``, rounded down. Its score against an
anchor is their inner product. The positives of an anchor are its best rows of the same label; its
hard negatives for a positive are the best rows of other labels whose scores lie between
``low`` and ``high`` per cent of the positive's.

The vectors are halved, and each half-space has a codebook of up to ``MAX_WORDS`` centres, learned by
a few rounds of k-means from at most ``SAMPLE_ROWS`` rows (``SAMPLE_BYTES``), those with the smallest
hashes. Every row is in the cell of its two nearest centres. By Cauchy and Schwarz no row of a cell
scores above the sum of two half-scores, each ``a . centre + |a| * radius``. For every
asked vector a multi-sequence heap visits the cells by falling sums. It stops where the sum
falls below all that is wanted, which certifies the rest; a cell's own radii rule out more cells.

A search has two rounds. The first visits the best cells up to ``PROBE_ROWS`` rows and so finds how
much a row must score to matter; the second visits all other cells that can still reach it.
Asked vectors are sent to the cells that they visit, cells are cut into blocks of bounded size, and
a block meets its visitors in slices, so a task holds one block and one slice.

Rows of equal label and vector are one class with its smallest ids, as many as any list can show,
so a vector that a third of the rows have is searched for, and found, once. Classes are told by
128-bit hashes.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take
no part, nor do vectors whose integers have a squared length of 2**62 or more, whose scores need not fit a long.
Shorter vectors count as filled up with zeros; an empty one scores 0. Rows that repeat an id are rows of their
own. An anchor without positives or without rows in a window gives none. No rows in, no rows out.
Only the id, label and vector columns are read, and those that ``anchors`` names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.operators.staging import stage

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: rows and bytes of the sample that the codebooks are learned from, and rounds of learning
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 20_000, 32 << 20, 8
#: classes for each cell that are aimed at, and most centres of a half-space
CELL_ROWS, MAX_WORDS = 1024, 64
#: classes that the first round of a search reads for each asked vector
PROBE_ROWS = 2048
#: bytes of the vectors in a block
BLOCK_BYTES = 8 << 20
#: asked vectors that meet a block at once, and rows that a task hands on at once
_TOGETHER, _OUT = 128, 2048
_KEY = ["k1", "k2"]
_WINDOWS = "array<struct<w:bigint,low:bigint,high:bigint>>"
_EXACT = float(1 << 53)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    made = np.zeros((len(lengths), width), np.int64)
    made[np.arange(width)[None, :] < lengths[:, None]] = flat
    return made


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of a few rounds of k-means, started from rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].astype(float) if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(ROUNDS if len(x) else 0):
        own = _nearest(x, centres)[0]
        held = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the distance to it."""
    own = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


class MultiIndex:
    """Two codebooks and, by cell, the number of classes and how far they lie from the centres."""

    def __init__(self, sample: np.ndarray, words: int) -> None:
        self.width = sample.shape[1]
        self.half = self.width // 2
        self.books = [_centres(part.astype(float), words) for part in self._halves(sample)]
        self.shape = (len(self.books[0]), len(self.books[1]))

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of vectors and the distances of their halves to the centres."""
        (i, near), (j, far) = (_nearest(part.astype(float), book) for part, book in zip(self._halves(x), self.books))
        return i * self.shape[1] + j, near, far

    def fill(self, cells: list, block_rows: int) -> None:
        """``cells``: (cell, rows, radius of the first half, radius of the second) of those that hold rows."""
        self.rows = np.zeros(self.shape, np.int64)
        self.radii = np.zeros((2, *self.shape))
        for cell, rows, first, second in cells:
            at = divmod(cell, self.shape[1])
            self.rows[at], self.radii[0][at], self.radii[1][at] = rows, first, second
        self.blocks = -(-self.rows // block_rows)

    def visits(self, a: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """All cells that hold rows by falling sum of half-score bounds: the sum, the cell, and the least and most a row of it can score."""
        parts = [p[0].astype(float) for p in self._halves(a[None, :])]
        norms = [math.sqrt(p @ p) for p in parts]
        scores = [book @ p for book, p in zip(self.books, parts)]
        spread = [self.radii[0].max(axis=1), self.radii[1].max(axis=0)]
        bounds = [s + n * r for s, n, r in zip(scores, norms, spread)]
        slack = 1 + 1e-9 * sum(np.abs(s).max() + n * r.max() for s, n, r in zip(scores, norms, spread))
        order = [np.argsort(-b, kind="stable") for b in bounds]
        first, second = (b[o].tolist() for b, o in zip(bounds, order))
        heap, open_ = [(-first[0] - second[0], 0, 0)], {(0, 0)}
        while heap:
            top, x, y = heapq.heappop(heap)
            i, j = int(order[0][x]), int(order[1][y])
            if self.rows[i, j]:
                mean = scores[0][i] + scores[1][j]
                reach = norms[0] * self.radii[0][i, j] + norms[1] * self.radii[1][i, j]
                yield slack - top, i * self.shape[1] + j, mean - reach - slack, mean + reach + slack
            for at in ((x + 1, y), (x, y + 1)):
                if at[0] < self.shape[0] and at[1] < self.shape[1] and at not in open_:
                    open_.add(at)
                    heapq.heappush(heap, (-first[at[0]] - second[at[1]], *at))


def _chosen(index: MultiIndex, a: np.ndarray, windows: list[dict], seen: int, probe: int | None) -> tuple[list[int], int]:
    """The cells to visit from the heap's place ``seen`` on, and its place afterwards; all that matter without ``probe``."""
    cells, rows, floor = [], 0, min(w["low"] for w in windows)
    for at, (bound, cell, least, most) in enumerate(index.visits(a)):
        if bound < floor or (probe is not None and rows >= probe):
            return cells, at
        if at >= seen and any(least <= w["high"] and most >= w["low"] for w in windows):
            cells.append(cell)
            rows += int(index.rows.flat[cell])
    return cells, index.rows.size


def _routed(asked: DataFrame, index: MultiIndex, probe: int | None) -> DataFrame:
    """A row of each asked vector for each block of each cell it visits, and how far its heap went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(3), index.width)
            out: list[tuple[int, int, int, int]] = []
            for i, (windows, seen) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                cells, place = _chosen(index, vectors[i], windows, seen, probe)
                out += [(i, cell, block, place) for cell in cells for block in range(int(index.blocks.flat[cell]))]
                if not cells and probe is not None:
                    out.append((i, -1, 0, place))
                while len(out) >= _OUT or (out and i == batch.num_rows - 1):
                    now, out = out[:_OUT], out[_OUT:]
                    rows, cell, block, places = (np.array(x, np.int64) for x in zip(*now))
                    own = batch.take(pa.array(rows)).columns[:5]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block), *own, pa.array(places)], names)

    names = ["cell", "block", *_KEY, "label", "vec", "windows", "seen"]
    schema = f"cell bigint, block bigint, k1 bigint, k2 bigint, label bigint, vec array<bigint>, windows {_WINDOWS}, seen bigint"
    return asked.select(*_KEY, "label", "vec", "windows", "seen").mapInArrow(run, schema)


class _Block:
    """Classes of a block; asked vectors stream by."""

    def __init__(self, parts: list[pa.RecordBatch], width: int) -> None:
        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.vectors = _matrix(held.column(3), width)
        self.labels, self.ids = held.column(2).to_numpy(), held.column(4).to_pylist()
        self.first = np.array([x[0] for x in self.ids], np.int64)
        self.floats = self.vectors.astype(float)
        self.longest = math.sqrt((self.floats**2).sum(axis=1).max())

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """Inner products; in double precision where all sums on the way are whole numbers below 2**53."""
        floats = asked.astype(float)
        if math.sqrt((floats**2).sum(axis=1).max()) * self.longest < _EXACT:
            return (floats @ self.floats.T).astype(np.int64)
        return asked @ self.vectors.T

    def best(self, asked: np.ndarray, labels: np.ndarray, windows: list[list[dict]], same: bool, most: int) -> list[tuple]:
        """(place of the asked vector, window, score, id) of the best rows in each window."""
        found = []
        for i, (scores, label) in enumerate(zip(self.scores(asked), labels.tolist())):
            fits = (self.labels == label) == same
            for window in windows[i]:
                at = np.flatnonzero(fits & (scores >= window["low"]) & (scores <= window["high"]))
                if len(at) > most:
                    at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
                at = at[np.lexsort((self.first[at], -scores[at]))][:most]
                rows = sorted((-int(scores[k]), row) for k in at.tolist() for row in self.ids[k])[:most]
                found += [(i, window["w"], -score, row) for score, row in rows]
        return found


def _met(placed: DataFrame, routed: DataFrame, width: int, same: bool, most: int) -> DataFrame:
    """(k1, k2, w, score, id): the best rows of each block for each of its visitors. The block's classes come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            changed = (np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(guest.astype(np.int8)) != 0)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                own = pa.RecordBatch.from_arrays(batch.slice(start, end - start).columns[3:], names)
                if (cell[start], number[start]) != key:
                    key, parts, block = (cell[start], number[start]), [], None
                if not guest[start]:
                    parts.append(own)
                    continue
                if not parts:
                    continue
                block = block or _Block(parts, width)
                for at in range(0, own.num_rows, _TOGETHER):
                    few = own.slice(at, _TOGETHER)
                    found = block.best(_matrix(few.column(3), width), few.column(2).to_numpy(), few.column(5).to_pylist(), same, most)
                    if found:
                        i, w, score, row = (pa.array(x, pa.int64()) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([few.column(0).take(i), few.column(1).take(i), w, score, row], [*_KEY, "w", "score", "id"])

    names = [*_KEY, "label", "vec", "ids", "windows"]
    home = placed.select("cell", "block", F.lit(False).alias("guest"), *_KEY, "label", "vec", "ids", F.lit(None).cast(_WINDOWS).alias("windows"))
    guests = routed.where("cell >= 0").select(
        "cell", "block", F.lit(True).alias("guest"), *_KEY, "label", "vec", F.lit(None).cast("array<bigint>").alias("ids"), "windows"
    )
    ordered = home.union(guests).repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")
    return ordered.mapInArrow(run, "k1 bigint, k2 bigint, w bigint, score bigint, id bigint")


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best rows of each asked vector and window, with their rank. Only so many of a task are shuffled."""
    order = Window.partitionBy(*_KEY, "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(placed: DataFrame, asked: DataFrame, index: MultiIndex, same: bool, most: int, probe: int = PROBE_ROWS) -> DataFrame:
    """(k1, k2, w, score, id, rank): for each asked (k1, k2, label, vec, windows) the best rows of the same or another label
    with scores in each window, all cells considered. Written."""
    first = stage(_routed(asked.withColumn("seen", F.lit(0).cast("bigint")), index, probe))
    found = stage(_top(_met(placed, first, index.width, same, most), most).drop("rank"))
    # what a full list holds at least is what other rows must score
    full = found.groupBy(*_KEY, "w").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= most)
    least = full.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))
    went = first.groupBy(*_KEY).agg(F.first("seen").alias("seen"))
    raised = F.transform("windows", lambda x: F.struct(
        x["w"].alias("w"), F.coalesce(F.greatest(x["low"], F.try_element_at("least", x["w"])), x["low"]).alias("low"), x["high"].alias("high")
    ))
    open_ = asked.join(went, _KEY).join(least, _KEY, "left").withColumn("windows", raised)
    second = stage(_routed(open_, index, None))
    if second.isEmpty():
        return stage(_top(found, most))
    visited = second.select("cell").distinct()
    return stage(_top(found.union(_met(placed.join(F.broadcast(visited), "cell", "left_semi"), second, index.width, same, most)), most))


def _classes(vectors: DataFrame, vector: str, vec_id: str, label: str, anchors: Column, scale: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Classes (k1, k2, label, vec, ids) of equal rows, and anchors (id, k1, k2). Both written."""
    v = F.col("raw")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("raw"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), 2))
    rows = rows.where(length < float(1 << 62)).withColumn("vec", F.transform(v, lambda x: F.floor(x * scale).cast("bigint"))).drop("raw")
    rows = stage(rows.withColumns({"k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit(1), "vec", "label")}))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*_KEY).orderBy("id"))).where(F.col("place") <= most)
    grouped = first.groupBy(*_KEY).agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))
    return stage(grouped), rows.where("anchor").select("id", *_KEY)


def build_index(classes: DataFrame, cell_rows: int = CELL_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[MultiIndex, DataFrame]:
    """The index and all classes with their cell and block. Written."""
    n, width = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    width = max(2, width or 0)
    words = max(1, min(MAX_WORDS, math.ceil(math.sqrt(n / cell_rows))))
    most = max(words, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    sample = classes.orderBy(F.xxhash64(*_KEY), *_KEY).limit(most).select("vec").toArrow().column(0).combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    index = MultiIndex(_matrix(sample, width) if len(sample) else np.zeros((0, width), np.int64), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, near, far = index.place(_matrix(batch.column(3), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near), pa.array(far)], names)

    names = [*_KEY, "label", "vec", "ids", "cell", "near", "far"]
    schema = "k1 bigint, k2 bigint, label bigint, vec array<bigint>, ids array<bigint>, cell bigint, near double, far double"
    placed = stage(classes.select(names[:5]).mapInArrow(run, schema))
    held = placed.groupBy("cell").agg(F.count("*"), F.max("near"), F.max("far"))
    index.fill(held.collect(), max(1, block_bytes // (8 * width)))  # a row for each cell, MAX_WORDS ** 2 at most
    blocks = F.get(F.lit(index.blocks.ravel().tolist() or [1]).cast("array<bigint>"), F.col("cell").cast("int"))
    return index, placed.withColumn("block", F.pmod("k1", blocks))


def mine(
    vectors: DataFrame, anchors: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    probe: int = PROBE_ROWS, **index_options,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` tells which rows are anchors."""
    classes, asked = _classes(vectors, vector, vec_id, label, anchors, scale, max(positives + 1, negatives))
    index, placed = build_index(classes, **index_options)
    queries = stage(classes.join(asked.select(*_KEY).distinct(), _KEY, "left_semi").select(*_KEY, "label", "vec"))
    everything = F.expr(f"array(named_struct('w', 0L, 'low', {-(1 << 62)}L, 'high', {1 << 62}L))").cast(_WINDOWS)
    # one more than asked for, since an anchor finds itself
    near = search(placed, queries.withColumn("windows", everything), index, True, positives + 1, probe)
    # no score below 0 has a window, as its upper end lies below its lower one
    exact = lambda x, up: F.expr(f"cast((cast(score as decimal(38,0)) * {x} + {up}) div 100 as bigint)")
    window = F.struct(F.col("score").alias("w"), exact(low, 99).alias("low"), exact(high, 0).alias("high"))
    windows = near.where("score >= 0").groupBy(*_KEY).agg(F.collect_set(window).alias("windows"))
    far = search(placed, queries.join(windows, _KEY), index, False, negatives, probe)
    own = near.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("near"))
    hard = far.groupBy(*_KEY, F.col("w").alias("positive_score")).agg(F.collect_list(F.struct("rank", "id", "score")).alias("hard"))
    pairs = asked.join(own, _KEY).withColumn("self", F.expr("array_position(transform(near, x -> x.id), id)"))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("self")), 1, positives)
    pairs = pairs.select(F.col("id").alias("anchor_id"), *_KEY, F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", *_KEY, F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"))
    rows = pairs.join(hard, [*_KEY, "positive_score"]).withColumn("n", F.explode("hard"))
    return rows.select(
        "anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", F.col("n.score").alias("negative_score"),
    )
