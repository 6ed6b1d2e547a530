"""Token ids in binary shards with a minimal perfect hash index.

``write_store`` orders documents by key, and every task writes its key range as shards: a
payload file that holds nothing but ids, one document after the other, and an index file. The
index maps a key to a slot, a slot to the document's place, and a place to its ids:

* levels of bit arrays. A key sets the bit that its hash picks; bits that several keys pick
  stay 0 and those keys go on to the next level. The number of bits set before a key's bit is
  its slot, so ``n`` keys use the slots 0 to ``n - 1``. Keys left after the last level are listed.
* for each slot a 32-bit fingerprint of the key, the place of its first document and how many
  share the key. A key that is not in the shard fails the fingerprint test but for 1 in 4 billion,
  and the stored key settles those.
* for each place the key and the offset of its ids.

A shard is closed at ``shard_bytes``, so a task holds one open shard's keys and offsets and one
document. Files of a task attempt have names of their own; only those in the manifest, a table
that Spark commits, belong to the store. A lost or repeated task therefore leaves unread files at most.

Ids take two bytes if the vocabulary fits, else four, low byte first.

Defined cases: a null text counts as empty and holds the end id alone. Documents with a null
key come first; they can be read in order but not by key. Equal keys lie next to each other, in
the order of a hash of their texts, and a key gives all of them. No rows in: a manifest without
rows. Only the key and text columns are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.llm.common import whole_text
from casequill.llm.tokens import Encoder
from casequill.operators.staging import new_path, stage

END_ID = 2
#: payload bytes after which a shard is closed
SHARD_BYTES = 128 << 20
#: bits of a level for each key in it
GAMMA = 2
LEVELS = 32
MAGIC = b"CQTOKEN1"
#: most tasks that read a store at once
MOST_READERS = 10_000
#: payload bytes that are read at once
_READ = 8 << 20

_MANIFEST = "part bigint, shard bigint, name string, first_key bigint, last_key bigint, documents bigint, tokens bigint"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of keys for a level; multiply-and-shift rounds."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Different 64-bit keys to the numbers 0 to n - 1. Keys that were not given get any number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        words = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(words)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.unique(keys)
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-len(left) * GAMMA // 64) * 64)
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            if not len(open_):
                return found
            at = start + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            place = at[hit]
            below = self.bits.view(np.uint64)[place >> 6] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            found[open_[hit]] = self.ranks[place >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            listed = self.rest[at] == keys[open_]
            found[open_[listed]] = self.ranks[-1] + at[listed]
        return found


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: list[int | None], offsets: list[int], width: int) -> bytes:
    """The index file of a shard: keys of its documents in order, and offsets of their ids with the end of the last."""
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    different, first, count = np.unique(known, return_index=True, return_counts=True)
    hashed = PerfectHash.build(different)
    slots = hashed.slots(different)
    prints, places, counts = np.zeros(len(slots), np.uint32), np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
    prints[slots], places[slots], counts[slots] = _fingerprints(different), first + nulls, count
    parts = {
        "sizes": hashed.sizes, "bits": hashed.bits, "rest": hashed.rest, "prints": prints, "places": places,
        "counts": counts, "keys": known, "offsets": np.array(offsets, np.int64),
    }
    head = json.dumps({"width": width, "nulls": nulls, "parts": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(v.tobytes() for v in parts.values())])


class Shard:
    """A shard opened for reading, in order or by key."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        raw = files.open_input_stream(f"{path}.index").readall()
        if raw[:8] != MAGIC:
            raise ValueError(f"{path}.index is no index of this format")
        at = 16 + int.from_bytes(raw[8:16], "little")
        head, parts = json.loads(raw[16:at]), {}
        for name, kind, n in head["parts"]:
            parts[name] = np.frombuffer(raw, kind, n, at)
            at += parts[name].nbytes
        self.dtype, self.nulls = np.dtype(f"<u{head['width']}"), head["nulls"]
        self.prints, self.places, self.counts = parts["prints"], parts["places"], parts["counts"]
        self.keys, self.offsets = parts["keys"], parts["offsets"]
        self.hash = PerfectHash(parts["sizes"], parts["bits"], parts["rest"])
        self.payload = files.open_input_file(f"{path}.ids")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first document and number of documents of each key; 0 documents if it is not in the shard."""
        keys = np.asarray(keys, np.int64)
        slots = self.hash.slots(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == _fingerprints(keys[ok])
        ok[ok] = self.keys[self.places[slots[ok]] - self.nulls] == keys[ok]
        places, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        places[ok], counts[ok] = self.places[slots[ok]], self.counts[slots[ok]]
        return places, counts

    def ids(self, place: int) -> np.ndarray:
        """The ids of one document."""
        start, end = self.offsets[place : place + 2].tolist()
        self.payload.seek(start * self.dtype.itemsize)
        return np.frombuffer(self.payload.read((end - start) * self.dtype.itemsize), self.dtype)

    def in_order(self) -> Iterator[np.ndarray]:
        """The ids of all documents; the payload is read in blocks."""
        place, width = 0, self.dtype.itemsize
        while place < len(self):
            end = max(place + 1, int(np.searchsorted(self.offsets, self.offsets[place] + _READ // width, "right")) - 1)
            start = int(self.offsets[place])
            self.payload.seek(start * width)
            block = np.frombuffer(self.payload.read((int(self.offsets[end]) - start) * width), self.dtype)
            for at in range(place, end):
                yield block[self.offsets[at] - start : self.offsets[at + 1] - start]
            place = end


def write_store(
    docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES, partitions: int | None = None, folder: str | None = None,
) -> tuple[str, DataFrame]:
    """Writes all documents; the store's folder and its manifest, one row for each shard in key order."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    width = 2 if max(Encoder.of(vocabulary).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), np.array([end_id], f"<u{width}").tobytes()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        part, shard, out = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            with files.open_output_stream(f"{base}/{name}.index") as index:
                index.write(index_bytes(keys, offsets, width))
            row = [part, shard, name, next((k for k in keys if k is not None), None), keys[-1], len(keys), offsets[-1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row],
                ["part", "shard", "name", "first_key", "last_key", "documents", "tokens"],
            )

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name, keys, offsets = f"{part:06d}-{uuid.uuid4().hex}", [], [0]
                    out = files.open_output_stream(f"{base}/{name}.ids", buffer_size=1 << 20)
                ids = np.frombuffer(encoder.encode(value.as_py()), "<u4").astype(f"<u{width}")
                out.write(ids.tobytes() + end)
                keys.append(key)
                offsets.append(offsets[-1] + len(ids) + 1)
                if offsets[-1] * width >= shard_bytes:
                    yield closed()
                    shard, out = shard + 1, None
        if out is not None:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("key"), whole_text(text).alias("body")).withColumn("tie", F.xxhash64("body"))
    ranged = rows.repartitionByRange(partitions, "key", "tie").sortWithinPartitions("key", "tie").select("key", "body")
    return folder, stage(ranged.mapInArrow(run, _MANIFEST))


def _starts(manifest: DataFrame) -> DataFrame:
    """Ids and documents before each shard. The window has one row for each shard."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _readers(manifest: DataFrame) -> int:
    """Tasks that read shards. Named, since adaptive execution sees the few bytes of the manifest only."""
    return max(1, min(MOST_READERS, manifest.count()))


def read_store(folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: key, start, n_tokens, ids_crc32, and ``ids`` where asked for.

    Each shard is read in key order, and its own index must lead from every key to its documents.
    """
    names = ["key", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(files, f"{base}/{name}")
                places, counts = shard.find(shard.keys)
                own = np.arange(shard.nulls, len(shard))
                if ((own < places) | (own >= places + counts)).any():
                    raise ValueError(f"the index of {name} misses keys that it holds")
                keys = [None] * shard.nulls + shard.keys.tolist()
                rows, payloads = [], []
                for place, ids in enumerate(shard.in_order()):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((keys[place], start + int(shard.offsets[place]), len(ids), zlib.crc32(raw)))
                    payloads.append(raw if with_ids else None)
                    if len(rows) == 4096 or place == len(shard) - 1:
                        columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                        yield pa.RecordBatch.from_arrays(
                            columns + [pa.array(payloads, pa.binary())] * with_ids, names + ["ids"] * with_ids
                        )
                        rows, payloads = [], []

    shards = _starts(manifest).select("name", "start")
    schema = ", ".join(f"{x} bigint" for x in names) + ", ids binary" * with_ids
    return shards.repartition(_readers(manifest), F.col("name")).mapInArrow(run, schema)


def lookup(folder: str, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, n_tokens, ids) for every document of every asked key that the store holds.

    Keys find their shards by the key ranges of the manifest: two numbers for each shard are sent
    to the tasks. Then each shard that is asked for is opened once and each key costs one probe.
    """
    shards = manifest.where("last_key IS NOT NULL").orderBy("part", "shard").select("name", "first_key", "last_key").collect()
    names, first, last = [r.name for r in shards], np.array([r.first_key for r in shards], np.int64), np.array([r.last_key for r in shards], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_numpy()
            low, high = np.searchsorted(last, asked, "left"), np.searchsorted(first, asked, "right")
            pairs = [(names[s], k) for k, a, b in zip(asked.tolist(), low.tolist(), high.tolist()) for s in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["name", "key"]
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        opened, shard = None, None
        for batch in batches:
            rows = []
            for name, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != opened:
                    opened, shard = name, Shard(files, f"{base}/{name}")
                places, counts = shard.find(np.array([asked]))
                rows += [
                    (asked, at, len(ids := shard.ids(at)), ids.astype("<u4").tobytes())
                    for at in range(int(places[0]), int(places[0] + counts[0]))
                ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "n_tokens", "ids"])

    asked = keys.select(F.col(key).cast("bigint").alias("key")).where("key IS NOT NULL").distinct()
    routed = asked.mapInArrow(route, "name string, key bigint").repartition(_readers(manifest), "name").sortWithinPartitions("name", "key")
    return routed.mapInArrow(probe, "key bigint, place bigint, n_tokens bigint, ids binary")
