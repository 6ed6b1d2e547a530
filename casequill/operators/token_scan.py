"""Word tokens of texts, found in the bytes of Arrow batches.

A class for each byte, then the runs of letters: a few passes of array work over a batch, in place of an expression for each
token. The letters are those of the pattern ``chars.TOKEN`` by Spark itself, which is asked once for every code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions.spans import CONTEXT_RADIUS

#: bytes of text that are scanned together; a scan takes about 65 times as much memory, and a chunk with its tokens 5 times
CHUNK = 2 << 20
#: characters of a long text in one block; texts below twice that are one block
WIDTH = 4096
#: characters that a block knows of its neighbours: a context and one more, to see whether it is cut
MARGIN = CONTEXT_RADIUS + 1
_LETTER, _JOINT = 1, 2


_letters: dict[str, bytes] = {}


def letters(spark: SparkSession) -> bytes:
    """First and last code points of the runs of letters and marks, by Spark's own patterns."""
    if spark.version not in _letters:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        point = spark.range(0, 0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).where(F.regexp_like(char, F.lit(chars.LETTER_OR_MARK)))
        codes = np.sort(point.toArrow()["id"].to_numpy())
        cuts = np.flatnonzero(np.diff(codes) != 1)
        _letters[spark.version] = np.stack([codes[np.append(0, cuts + 1)], codes[np.append(cuts, len(codes) - 1)]]).tobytes()
    return _letters[spark.version]


@lru_cache(maxsize=1)
def _classes(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte below 128, and whether a code point is a letter or mark."""
    table = np.zeros(0x110000, np.uint8)
    for first, last in np.frombuffer(runs, np.int64).reshape(2, -1).T:
        table[first : last + 1] = _LETTER
    ascii_ = np.zeros(256, np.uint8)
    ascii_[:128] = table[:128]
    ascii_[[ord("-"), ord("'")]] = _JOINT
    return ascii_, table


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``CHUNK`` bytes of the column ``text``; a longer text is a batch of its own."""
    held, size = [], 0
    for batch in batches:
        text = batch.column("text")
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + CHUNK - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1] - before)
            at = end
            if size >= CHUNK or at < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.RecordBatch.from_arrays(
        [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], batches[0].schema.names
    )


class Scan:
    """The tokens of an array of texts: ``row``, and byte ranges ``start`` and ``end`` in all of them."""

    def __init__(self, texts: pa.Array, runs: bytes) -> None:
        self.texts = texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        size = int(offsets[-1] - offsets[0])
        self._bytes = texts.buffers()[2].slice(int(offsets[0]), size) if size else pa.py_buffer(b"")
        data, self.offsets = np.frombuffer(self._bytes, np.uint8), offsets - offsets[0]
        ascii_, table = _classes(runs)
        kind = ascii_[data]
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            self._classify(data, kind, high, table)
        first = np.zeros(size + 1, bool)
        first[self.offsets] = True
        inside = kind == _LETTER
        joint = np.flatnonzero(kind == _JOINT)
        joint = joint[(joint > 0) & (joint < size - 1)]
        joint = joint[inside[joint - 1] & inside[joint + 1] & ~first[joint] & ~first[joint + 1]]
        inside[joint] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:size]
        stops[:-1] &= ~inside[1:] | first[1:size]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.start, self.offsets)))
        # bytes that begin no character, before each byte
        self._more = np.concatenate([np.zeros(1, np.int32), np.cumsum((data & 0xC0) == 0x80, dtype=np.int32)]) if len(high) else None

    @staticmethod
    def _classify(data: np.ndarray, kind: np.ndarray, high: np.ndarray, table: np.ndarray) -> None:
        lead, last = data[high].astype(np.int64), len(data) - 1
        one, two, three = (data[np.minimum(high + k, last)].astype(np.int64) & 63 for k in (1, 2, 3))
        code = np.where(
            lead < 0xE0, (lead & 31) << 6 | one,
            np.where(lead < 0xF0, (lead & 15) << 12 | one << 6 | two, (lead & 7) << 18 | one << 12 | two << 6 | three),
        )
        found = high[table[np.minimum(code, len(table) - 1)] == _LETTER]
        wide = data[found]
        kind[found] = kind[found + 1] = _LETTER
        kind[found[wide >= 0xE0] + 2] = _LETTER
        kind[found[wide >= 0xF0] + 3] = _LETTER

    def tokens(self) -> pa.Array:
        """The tokens as strings."""
        if not len(self.start):
            return pa.array([], pa.string())
        ends = np.stack([self.start, self.end], 1).ravel().astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), self._bytes)
        return pieces.take(pa.array(np.arange(0, len(ends), 2)))

    def place(self, at: np.ndarray) -> np.ndarray:
        """Characters before a byte, over all texts."""
        return at if self._more is None else at - self._more[at]


def distinct_tokens(runs: bytes):
    """``mapInArrow`` function: batches with a column ``text`` to the tokens of each chunk, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pc.unique(Scan(batch.column("text"), runs).tokens())], ["token"])

    return run


def token_blocks(runs: bytes, keep: tuple[str, ...], units: tuple[str, ...], wanted=None):
    """``mapInArrow`` function: ``keep``, ``text`` and ``guards`` (ranges) to blocks of texts with their tokens outside of these ranges.

    A row is ``keep``, block_pos, lead, body, units, hits: the body is the block's text with margins, ``lead`` characters of them before
    ``block_pos``; hits are structs of start, end and token. ``units`` tells that a token may be one of the units. ``wanted``, a broadcast
    batch with a column ``token``, holds the only tokens that are asked for, and its other columns are added to the hits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            found = _blocks(batch)
            if found is not None:
                yield found

    def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        scan = Scan(batch.column("text"), runs)
        tokens, more = scan.tokens(), {}
        kept = np.arange(len(tokens))
        if wanted is not None:
            table = wanted.value
            number = _numbers(tokens, table.column("token"))
            kept = np.flatnonzero(number >= 0)
            number = number[kept]
        start, end = scan.place(scan.start[kept]), scan.place(scan.end[kept])
        bases = scan.place(scan.offsets)
        free = _outside(start, end, batch.column("guards"), bases)
        start, end, kept = start[free], end[free], kept[free]
        if not len(kept):
            return None
        tokens, row = tokens.take(pa.array(kept)), scan.row[kept]
        if wanted is not None:
            at = pa.array(number[free])
            more = {name: table.column(name).take(at) for name in table.schema.names if name != "token"}
        start, end = start - bases[row], end - bases[row]
        long = np.diff(bases)[row] >= 2 * WIDTH
        block = np.where(long, start // WIDTH, 0)
        first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(block) != 0)))
        last = np.append(first[1:], len(row)) - 1
        rows, position, lead, body = row[first], block[first] * WIDTH, np.zeros(len(first), np.int64), row[first].copy()
        parts, held, text = [], -1, ""
        for g in np.flatnonzero(long[first]).tolist():
            if rows[g] != held:
                held, text = rows[g], scan.texts[int(rows[g])].as_py()
            low = max(0, int(position[g]) - MARGIN)
            lead[g], body[g] = position[g] - low, len(scan.texts) + len(parts)
            parts.append(text[low : max(int(position[g]) + WIDTH, int(end[last[g]])) + MARGIN])
        texts = pa.concat_arrays([scan.texts, pa.array(parts, pa.string())]) if parts else scan.texts
        unit = np.flatnonzero(pc.is_in(pc.utf8_lower(tokens), pa.array(list(units), pa.string())).to_numpy(zero_copy_only=False))
        some = np.zeros(len(first), bool)
        some[np.searchsorted(first, unit, "right") - 1] = True
        hits = pa.StructArray.from_arrays(
            [pa.array(start, pa.int32()), pa.array(end, pa.int32()), tokens, *more.values()], ["start", "end", "token", *more]
        )
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), hits)
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(name).take(at) for name in keep], pa.array(position, pa.int32()), pa.array(lead, pa.int32()), texts.take(pa.array(body)), pa.array(some), lists],
            [*keep, "block_pos", "lead", "body", "units", "hits"],
        )

    return run


def _numbers(tokens: pa.Array, listed: pa.Array) -> np.ndarray:
    """The place of each token in a list of different ones, -1 if it is not there. The list is looked up in the tokens of the chunk: a
    hash table of the list would be made for every chunk, and be as large as the list."""
    coded = tokens.dictionary_encode()
    at = pc.index_in(listed, coded.dictionary)
    found = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
    place = np.full(len(coded.dictionary) + 1, -1, np.int64)
    place[at.drop_null().to_numpy()] = found
    return place[coded.indices.to_numpy()]


def _outside(start: np.ndarray, end: np.ndarray, guards: pa.Array, bases: np.ndarray) -> np.ndarray:
    """Numbers of the ranges that meet no guarded one. A range meets one of those that begin before its end if the farthest of their
    ends lies behind its start; a guarded range ends in its own text, so those of other texts can't."""
    spans = guards.flatten()
    if not len(spans):
        return np.arange(len(start))
    row = np.repeat(np.arange(len(guards)), pc.fill_null(pc.list_value_length(guards), 0).to_numpy(zero_copy_only=False))
    low, high = (bases[row] + spans.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.lexsort((high, low))
    order = order[low[order] < high[order]]
    low, far = low[order], np.append(-1, np.maximum.accumulate(high[order]))
    return np.flatnonzero(far[np.searchsorted(low, end, "left")] <= start)
