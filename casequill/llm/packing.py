"""Packing without padding: documents are cut into pieces of power-of-two length.

A document of ``n`` ids gives ``n // size`` pieces of ``size`` ids and one piece for every binary
digit of the rest, longest first. Pieces of equal length form a bucket, and each piece is one
sequence of its bucket, so no sequence crosses documents and none needs padding. A trainer
draws a batch from one bucket and takes ``size / length`` times as many sequences of it.

Sequences are numbered without gaps by bucket, longest first. A task counts the pieces that it
makes of each length; the counts, one row for each task and length, give every task its offset.
Nothing is shuffled but those counts.

Defined cases: a null text counts as empty and gives the end id alone. Rows with equal or
null ids are documents of their own. No rows in, no rows out. Only the id and text columns
are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.llm.common import whole_text
from casequill.llm.tokens import Encoder
from casequill.operators.staging import stage

#: ids in the longest sequence; a power of two
SIZE = 2048
END_ID = 1
#: documents whose pieces a task holds at once
_TOGETHER = 512


def piece_lengths(n: int, size: int) -> list[int]:
    """Full sequences, then the binary digits of the rest."""
    rest = n % size
    return [size] * (n // size) + [1 << bit for bit in range(size.bit_length() - 1, -1, -1) if rest >> bit & 1]


def cut(docs: DataFrame, vocabulary: str, text: str, doc_id: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length that the same task (``part``) made."""
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), np.array([end_id], "<u4").tobytes()
        part, made = TaskContext.get().partitionId(), Counter()
        few = (b.slice(at, _TOGETHER) for b in batches for at in range(0, b.num_rows, _TOGETHER))
        for batch in few:
            rows, payloads = [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(value.as_py()) + end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, size):
                    payload = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(payload), total, part, made[length]))
                    if with_ids:
                        payloads.append(payload)
                    made[length] += 1
                    start += length
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
            ids = [pa.array(payloads, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + ids, names + ["ids"] * with_ids)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), whole_text(text).alias("body"))
    return rows.mapInArrow(run, ", ".join(f"{x} bigint" for x in names) + ", ids binary" * with_ids)


def pack(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = SIZE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``ids`` where asked for."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    pieces = stage(cut(docs, vocabulary, text, doc_id, size, end_id, with_ids))
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = held.groupBy("length").agg(F.sum("held").alias("all")).select("length", F.sum("all").over(longer).alias("first"))
    offsets = held.select("length", "part", F.sum("held").over(earlier).alias("before")).join(buckets, "length")
    number = F.coalesce("first", F.lit(0)) + F.coalesce("before", F.lit(0)) + F.col("rank")
    return pieces.join(offsets, ["length", "part"]).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        *["ids"] * with_ids,
    )
