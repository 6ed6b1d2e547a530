"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Fingerprint: the lower-cased text's word shingles are hashed to 64 bits; a fingerprint bit is 1
if it is set in over half of the hashes. Two documents link if their fingerprints differ in at
most ``radius`` bits.

Covering tables: every bit position gets a non-zero code of ``radius + 1`` bits, and
every non-zero code ``v`` gives one mask, with the positions whose code has an odd product with
``v``. The codes of ``radius`` differing positions can't span all codes, so some ``v`` is
orthogonal to all of them: in that table the two masked fingerprints are equal. All pairs
within the radius therefore collide in at least one of the ``2 ** (radius + 1) - 1`` tables.

Equal fingerprints are one class, named by the smallest id. Only classes enter the tables.
Inside a table entry, members are linked by a search that removes a member once it is reached,
and only the search tree is written: at most one link for each member, never all pairs. An
entry with over ``crowded`` members is split by a second covering family, under which its pairs
again collide at least once. Members share about half of their bits and the second family
parts the rest, so an entry stays large only while its members differ in few bits, and of those
there are few different ones.

Defined cases: a null text counts as empty. A text without words has the fingerprint 0, and
one with fewer words than a shingle has one shingle of all its words. Null ids form classes
and carry links like others; a component of null ids alone has the id null. Repeated rows are links of
the same class. No rows in, no rows out. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequill.llm.common import keep_rows, text_tag, whole_text
from casequill.llm.components import smallest_reachable, with_least_id
from casequill.operators.staging import stage

WIDTH = 4
RADIUS = 4
#: members of a table entry beyond which it is split by the second family
CROWDED = 4096
#: shingles counted at once, so that a very long text needs no more memory
_CHUNK = 1 << 16


def fingerprint(text: str, width: int = WIDTH) -> int:
    """SimHash of one text, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), (ends[width - 1 :] if len(words) >= width else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([digest(body[i:j], 42) for i, j in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(id, tag, print): a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), width) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints)], ["id", "tag", "print"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_tag(text).alias("tag"), whole_text(text).alias("body"))
    return rows.mapInArrow(run, "id bigint, tag bigint, print bigint")


def covering_masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """Masks such that any ``radius`` bit positions are all absent from at least one of them."""
    kinds = 2 ** (radius + 1) - 1
    codes = np.random.default_rng(seed).permutation(np.arange(64) % kinds) + 1  # evenly used, so masks are of like size
    return [
        sum(1 << bit for bit, code in enumerate(codes.tolist()) if bin(code & v).count("1") % 2)
        for v in range(1, kinds + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _with_tables(rows: DataFrame, masks: list[int], entry: str) -> DataFrame:
    """One row for each table: its number and the masked fingerprint are hashed into the entry's key."""
    keys = [F.xxhash64(F.lit(i), F.col(entry), F.col("print").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    return rows.select("name", "print", F.explode(F.array(*keys)).alias(entry))


def search_tree(names: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the members as all links within the radius would."""
    links, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                links.extend((int(names[at]), int(x)) for x in names[reached])
                frontier.extend(reached.tolist())
    return links


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Search trees of all entries; rows arrive sorted by entry, one entry is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def trees(block: np.ndarray) -> list[tuple[int, int]]:
            cuts = np.flatnonzero(np.diff(block[0])) + 1
            sizes = np.diff(np.concatenate(([0], cuts, [block.shape[1]])))
            found: list[tuple[int, int]] = []
            for start, size in zip(np.concatenate(([0], cuts))[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                part = block[:, start : start + size]
                found += search_tree(part[1], part[2].view(np.uint64), radius)
            return found

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([c.to_numpy() for c in batch.columns])
            last = int(np.searchsorted(now[0], now[0, -1]))  # where the batch's last entry begins
            if last == 0 and held and held[0][0, 0] == now[0, 0]:
                held.append(now)
                continue
            yield batch_of(trees(np.concatenate([*held, now[:, :last]], axis=1)))
            held = [now[:, last:]]
        if held:
            yield batch_of(trees(np.concatenate(held, axis=1)))

    return rows.select("entry", "name", "print").mapInArrow(run, "a bigint, b bigint")


def links(classes: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that connect the classes (name, print) as all pairs within the radius would."""
    entries = _with_tables(classes.withColumn("entry", F.lit(0).cast("bigint")), covering_masks(radius), "entry")
    sizes = stage(entries.groupBy("entry").agg(F.count("*").alias("members")).where("members > 1"))
    full = sizes.where(F.col("members") > crowded).select("entry")
    shared = entries.join(sizes.where(F.col("members") <= crowded).select("entry"), "entry", "left_semi")
    if not full.isEmpty():
        split = _with_tables(entries.join(full, "entry", "left_semi"), covering_masks(radius, seed=2), "entry")
        shared = shared.unionByName(split)
    found = _linked(shared.repartition("entry").sortWithinPartitions("entry"), radius)
    return found.distinct()


def near_copies(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = WIDTH,
    radius: int = RADIUS,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row per document: id, tag, print and component, the smallest id that its links reach."""
    prints = stage(fingerprints(docs, text, doc_id, width))
    classes = stage(prints.groupBy("print").agg(F.min("id").alias("low")))
    if classes.where("low IS NULL").isEmpty():
        classes = classes.withColumn("name", F.col("low"))
        found = links(classes, radius, crowded)
    else:  # classes of null ids get numbers, all others too, and classes that share an id are linked
        classes = stage(classes.withColumn("name", F.monotonically_increasing_id()))
        first = classes.where("low IS NOT NULL").groupBy("low").agg(F.min("name").alias("a"))
        found = links(classes, radius, crowded).union(classes.join(first, "low").select("a", F.col("name").alias("b")))
    named = with_least_id(classes, smallest_reachable(found)).select("print", F.col("least").alias("component"))
    return prints.join(named, "print").select("id", "tag", "print", "component")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the document of smallest id of each component, all columns as they were."""
    found = near_copies(docs, text, doc_id, **options)
    dropped = stage(found.where(~F.col("id").eqNullSafe(F.col("component"))).select("id", "tag").distinct())
    return keep_rows(docs, doc_id, text, dropped, dropped.count(), "left_anti")
