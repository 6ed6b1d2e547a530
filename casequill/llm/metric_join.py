"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length 1, where cosine ``s`` is the Euclidean distance
``sqrt(2 - 2 s)``, so a least cosine is a range. Pivots, vectors picked by a hash of their name,
partition the sphere: a vector's home is the cell of its nearest pivot. A vector is replicated to
another cell ``j`` only if something at home there can be within the range ``r``. The triangle
inequality rules that out if the vector is farther from pivot ``j`` than the cell's radius plus
``r``, or farther than its own pivot by over ``2 r``; its distance from the border of the two
cells, ``(d_j ** 2 - d_home ** 2) / (2 * d(home, j))``, rules it out beyond ``r``. Cells are then
joined independently: every vector meets all its neighbours in its home cell, once.

Equal vectors are one class before that, with the number of its copies as weight, so copies are
never expanded. Neither are links: a cell task multiplies matrices block by block, adds the
weights of neighbours for each home vector, and writes a spanning forest of the links it found,
at most one link for each member of a block. A cell with many home vectors is split into blocks of
``block_rows``; each gets all members of the cell, streamed. A task holds one block and one
batch.

Cosines that are within rounding of the bound are computed again from the vectors as given.

Defined cases: a vector that is null, empty, all zero or holds a null, NaN or infinite component
links with nothing, copies of it included, and is kept. Vectors of different length don't link.
Equal ids are vectors of their own; they link if their vectors do. Null ids count as
neighbours and carry links; a component of null ids alone has the id null. No rows in, no rows out. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequill.llm.components import smallest_reachable, with_least_id
from casequill.operators.staging import stage

LEAST_COSINE = 0.9
#: classes for each pivot that are aimed at, and most pivots
CELL_ROWS, MAX_PIVOTS = 5000, 4096
#: home vectors of a cell that one task holds
BLOCK_ROWS = 8192
_ROUNDING = 1e-9
#: members that are multiplied with a block at once
_TOGETHER = 1024


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length, with their vectors as a matrix."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        own = lists if len(at) == len(lists) else lists.take(pa.array(at))
        yield at, own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; first scaled by the largest component, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


class _Cells:
    """Pivots by vector length. Vectors of a length without a pivot are in cell -length."""

    def __init__(self, pivots: pa.Array) -> None:
        self.pivots = {x.shape[1]: (at, _unit(x)) for at, x in _by_length(pivots)}

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, and distances to the cells whose numbers come last."""
        n = x.shape[1]
        if n not in self.pivots:
            return np.full(len(x), -n), np.zeros((len(x), 1)), np.array([-n])
        numbers, pivots = self.pivots[n]
        distances = _distance(x, pivots)
        return numbers[distances.argmin(axis=1)], distances, numbers

    def reached(self, x: np.ndarray, radii: dict[int, float], r: float):
        """Home cells, the cells that any of the vectors belongs to, and a function that tells which do."""
        home, far, numbers = self.near(x)
        at = np.searchsorted(numbers, home)
        if len(numbers) == 1:
            return home, numbers.tolist(), lambda cell: np.ones(len(x), bool)
        own = far[np.arange(len(x)), at][:, None]
        pivots = self.pivots[x.shape[1]][1]
        radius = np.array([radii.get(c, -np.inf) for c in numbers.tolist()])
        slack = r + 1e-7  # distances come from rounded products
        belongs = (far**2 - own**2) <= 2 * slack * _distance(pivots, pivots)[at] + 1e-9
        belongs &= (far - own <= 2 * slack) & (far <= radius + slack)
        belongs[np.arange(len(x)), at] = True
        return home, numbers.tolist(), lambda cell: belongs[:, np.searchsorted(numbers, cell)]


def _first_pass(classes: DataFrame, cells: _Cells) -> DataFrame:
    """Radius and number of home vectors of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                home, far, numbers = cells.near(_unit(x))
                own = far[np.arange(len(x)), np.searchsorted(numbers, home)]
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(own)], ["cell", "radius"])

    homes = classes.select("vec").mapInArrow(run, "cell bigint, radius double")
    return homes.groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("rows"))


def _rows(batch: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, block: np.ndarray, guest: bool) -> pa.RecordBatch:
    """Some (name, weight, vec) rows with the cell and block that they are sent to."""
    sent = [pa.array(cell, pa.int64()), pa.array(block, pa.int64()), pa.array(np.full(len(rows), guest))]
    own = batch.take(pa.array(rows)).columns
    return pa.RecordBatch.from_arrays([*sent, *own], ["cell", "block", "guest", "name", "weight", "vec"])


def _dealt(classes: DataFrame, cells: _Cells, radii: dict[int, float], blocks: dict[int, int], r: float) -> DataFrame:
    """A home row for each class, and a guest row for every block of every cell that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for at, x in _by_length(batch.column(2)):
                home, reached, guests = cells.reached(_unit(x), radii, r)
                yield _rows(batch, at, home, names[at] % np.array([blocks[h] for h in home.tolist()]), False)
                for cell in reached:
                    own = at[guests(cell)]
                    for block in range(blocks.get(cell, 0)):
                        yield _rows(batch, own, np.full(len(own), cell), np.full(len(own), block), True)

    schema = f"cell bigint, block bigint, guest boolean, name bigint, weight bigint, vec {dict(classes.dtypes)['vec']}"
    return classes.select("name", "weight", "vec").mapInArrow(run, schema)


class _Forest:
    """Which members of a block are known to be connected."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


class _Block:
    """Home vectors of one block: neighbours are counted as members stream by."""

    def __init__(self, names: np.ndarray, raw: np.ndarray, least: float) -> None:
        self.names, self.raw, self.least = names, raw, least
        self.units = _unit(raw)
        self.short = self.units.astype(np.float32).T.copy()
        self.weights, self.forest, self.links = np.zeros(len(names), np.int64), _Forest(), []

    def meet(self, names: np.ndarray, weights: np.ndarray, raw: np.ndarray) -> None:
        units = _unit(raw)
        for start in range(0, len(names), _TOGETHER):
            some = slice(start, start + _TOGETHER)
            # single precision finds where links can be, double precision decides
            maybe = units[some].astype(np.float32) @ self.short >= self.least - 1e-4
            rows, homes = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if len(rows):
                self._decide(names[some][rows], weights[some][rows], raw[some][rows], units[some][rows], homes)

    def _decide(self, names: np.ndarray, weights: np.ndarray, raw: np.ndarray, units: np.ndarray, homes: np.ndarray) -> None:
        cosine = units @ self.units[homes].T
        linked = cosine >= self.least
        for m, h in np.argwhere(np.abs(cosine - self.least) <= _ROUNDING).tolist():
            x, y = raw[m], self.raw[homes[h]]
            linked[m, h] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= self.least
        linked &= names[:, None] != self.names[homes]
        self.weights[homes] += weights @ linked
        for m in np.flatnonzero(linked.any(axis=1)).tolist():
            own, trees = int(names[m]), {}
            for h in self.names[homes[linked[m]]].tolist():
                trees.setdefault(self.forest.root(h), h)
            for h in trees.values():  # one home of each tree that the member touches
                if self.forest.join(own, h):
                    self.links.append((own, h))


def _joined(dealt: DataFrame, least: float) -> DataFrame:
    """Weights of the neighbours of home classes (a, null, w) and links (a, b, null). Rows of a block lie together, home rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, block = None, [], None

        def result() -> pa.RecordBatch:
            linked = np.flatnonzero(block.weights)
            a = block.names[linked].tolist() + [x for x, _ in block.links]
            b = [None] * len(linked) + [y for _, y in block.links]
            w = block.weights[linked].tolist() + [None] * len(block.links)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, w)], ["a", "b", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            changed = (np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(guest.astype(np.int8)) != 0)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if (cell[start], number[start]) != key:
                    if block is not None:
                        yield result()
                    key, homes, block = (cell[start], number[start]), [], None
                names, weights = part.column(3).to_numpy(), part.column(4).to_numpy()
                raw = next(_by_length(part.column(5)))[1]  # a cell has vectors of one length
                if not guest[start]:
                    homes.append((names, raw))
                elif homes:
                    block = block or _Block(*(np.concatenate(x) for x in zip(*homes)), least)
                    block.meet(names, weights, raw)
        if block is not None:
            yield result()

    ordered = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")
    return ordered.mapInArrow(run, "a bigint, b bigint, w bigint")


def linked_vectors(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", least_cosine: float = LEAST_COSINE,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per vector: id, n_links, component_id."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("raw"))
    fine = usable(rows, "raw").select("id", F.col("raw").alias("vec"))
    groups = fine.groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    classes = stage(groups.withColumn("name", F.col("low")))
    n = classes.count()
    if classes.select("low").where("low IS NOT NULL").distinct().count() < n:  # null ids, or an id with several vectors
        classes = stage(classes.withColumn("name", F.monotonically_increasing_id()))
    count = min(MAX_PIVOTS, math.ceil(n / cell_rows))
    picked = classes.orderBy(F.xxhash64("name"), "name").limit(count).select("vec").collect() if count > 1 else []
    cells = _Cells(pa.array([list(p.vec) for p in picked], pa.list_(pa.float64())))
    r = math.sqrt(max(0.0, 2 - 2 * least_cosine))
    radii, blocks = {}, {}
    for cell, radius, held in _first_pass(classes, cells).collect():  # a row for each pivot
        radii[cell], blocks[cell] = radius, math.ceil(held / block_rows)
    found = stage(_joined(_dealt(classes, cells, radii, blocks, r), least_cosine))
    reached = smallest_reachable(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("w IS NOT NULL").groupBy(F.col("a").alias("name")).agg(F.sum("w").alias("others"))
    named = with_least_id(classes, reached).join(counts, "name", "left").select(
        "vec", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"), F.lit(True).alias("fine")
    )
    out = rows.withColumnRenamed("raw", "vec").join(named, "vec", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
