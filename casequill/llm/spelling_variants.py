"""Spelling variants: words that differ by one letter, found with integer pairs of trie nodes.

The words are numbered as the nodes of two tries, one of the words and one of the words read
backwards, so a node stands for a beginning or an ending. A word without its letter ``p`` is the
pair (node of the ``p`` first letters, node of the letters behind ``p``), and a word with a gap at
``q`` is the pair (node of the ``q`` first letters, node of the others). Two words that share a
skipped pair differ in that letter alone; a skipped pair of one that is a gapped pair of the other
means one more letter. Both are joins of two integers and exact: nothing is verified afterwards.

Tries are numbered without holding them: words are sorted by ranges, and a task numbers the nodes
that a word does not share with the one before it. The beginnings that a range shares with the
range before it take over the numbers given there; that needs the first and last word of every range.

No pairs of a group are formed. Words that share a skipped pair are counted, and each takes the
best of the others from their order. A gapped pair belongs to one word, so every skipped pair
meets at most one; in a run of equal letters only the first is skipped for that, so two words meet once.

A word's form is its near word of the largest count, if that is ``times`` the word's own or more. Counts
at least double along a chain of forms, so its end, the root, is reached by a few rounds of pointer doubling.

Defined cases: a null text has no words; a null id counts as an empty text where words are changed by id.
Ties of counts go to the smaller word in code-point order. Rows that repeat an id or text count again. Words
of any length are taken whole; a word of ``L`` letters costs ``2 L + 1`` rows of integers. No rows in, no rows out. Only
the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.llm.common import whole_text
from casequill.operators.staging import stage

LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: bytes of a text that are counted at once, and different words that a task holds before it hands on their counts
BLOCK, HELD_WORDS = 1 << 20, 300_000
#: node numbers: the range above, the number in the range below
_RANGE_BITS = 40
#: integers that a task hands on at once
_OUT = 1 << 18

#: runs of Latin letters up to U+00FF after A-Z became a-z, in UTF-8
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_NO_LETTER = re.compile(rb"[^a-z\x80-\xff]")

#: a change of a word by the id of its document: (crc32 of the id and a colon, word) to the word that counts
Change = Callable[[int, bytes], bytes]


def runs(body: bytes) -> Counter:
    """How often each run occurs in a lower-cased text; long texts are cut where no letter stands."""
    found: Counter = Counter()
    start = 0
    while start < len(body):
        cut = _NO_LETTER.search(body, start + BLOCK) if len(body) > start + BLOCK else None
        end = cut.start() if cut else len(body)
        found.update(_RUN.findall(body, start, end))
        start = end
    return found


def one_letter_less(modulus: int) -> Change:
    """Takes a letter out of one word in ``modulus``, told by the checksum of ``<id>:<word>``."""

    def change(start: int, word: bytes) -> bytes:
        code = zlib.crc32(word, start)
        if code % modulus:
            return word
        letters = word.decode()
        at = code % len(letters)
        return (letters[:at] + letters[at + 1 :]).encode()

    return change


def word_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, change: Change | None = None,
) -> DataFrame:
    """(word, n) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            words, counts = pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = runs(body.as_py().lower())
                if change:
                    start = zlib.crc32(f"{key}:".encode())
                    for word, n in found.items():
                        word = change(start, word)
                        held[word] = held.get(word, 0) + n
                else:
                    for word, n in found.items():
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield counted()
        if held:
            yield counted()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), whole_text(text).cast("binary").alias("body"))
    counts = rows.mapInArrow(run, "word string, n bigint").where(F.char_length("word") >= least_letters)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    return next(i for i in range(most) if a[i] != b[i])


class Trie:
    """Words sorted by ranges with the numbers of their trie nodes; ``taken`` has the numbers that a range takes over."""

    def __init__(self, words: DataFrame, backwards: bool) -> None:
        """``words``: (word, n)."""
        spelled = F.reverse("word") if backwards else F.col("word")
        rows = words.select("word", "n", spelled.alias("spelled"))
        parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartitionByRange(parts, "spelled").sortWithinPartitions("spelled")
        self.rows = stage(ordered.mapInArrow(_numbered, "word string, n bigint, part bigint, place bigint, nodes array<bigint>"))
        ranges = self.rows.groupBy("part").agg(
            F.min_by("word", "place"), F.max_by("word", "place"), F.max_by("nodes", "place"), F.count("*")
        )
        self.taken: dict[int, np.ndarray] = {}  # by range: numbers for the beginnings that the range before it has
        self.before: dict[int, int] = {}
        rank, last, nodes = 0, None, None
        for part, first, final, local, held in sorted(ranges.collect(), key=lambda r: r[0]):  # a row for each range
            first, final = (first[::-1], final[::-1]) if backwards else (first, final)
            self.taken[part] = nodes[: shared(last, first) + 1] if nodes is not None else np.empty(0, np.int64)
            self.before[part] = rank
            rank, last, nodes = rank + held, final, _settled(self.taken[part], np.array(local, np.int64))


def _settled(taken: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Nodes of a word of a range, with the numbers that the range takes over."""
    if not len(taken):
        return nodes
    local = nodes & ((1 << _RANGE_BITS) - 1)
    return np.where(local < len(taken), taken[np.minimum(local, len(taken) - 1)], nodes)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of every beginning of every word, the empty one first. The first word's nodes are 0, 1, 2, ..."""
    part, place, made, last, stack = TaskContext.get().partitionId(), 0, 0, None, []
    for batch in batches:
        words, counts, nodes, size, start = batch.column(2).to_pylist(), batch.column(1), [], 0, 0
        for i, word in enumerate(words):
            kept = 0 if last is None else shared(last, word) + 1
            fresh = len(word) + 1 - kept
            stack = stack[:kept] + list(range((part << _RANGE_BITS) + made, (part << _RANGE_BITS) + made + fresh))
            made, last = made + fresh, word
            nodes.append(stack)
            size += len(stack)
            if size >= _OUT or i == len(words) - 1:
                few = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, few), counts.slice(start, few), pa.array(np.full(few, part)),
                        pa.array(np.arange(place, place + few)), pa.array(nodes, pa.list_(pa.int64())),
                    ],
                    ["word", "n", "part", "place", "nodes"],
                )
                start, place, nodes, size = start + few, place + few, [], 0


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words as (id, word, n), ids in code-point order, and their pairs (a, b, gap, first, id, n). Both written."""
    forward, backward = Trie(words, False), Trie(words, True)
    forward_taken, backward_taken = forward.taken, backward.taken
    before = F.create_map(*[F.lit(x) for item in forward.before.items() for x in item]) if forward.before else F.lit(None).cast("map<bigint,bigint>")
    numbered = forward.rows.withColumn("id", (before[F.col("part")] + F.col("place")).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                key, n, word, part, other = row
                a = _settled(forward_taken[part], batch.column(5)[i].values.to_numpy())
                b = _settled(backward_taken[other], batch.column(6)[i].values.to_numpy())[::-1]
                letters = np.frombuffer(word.encode("utf-32-le"), "<u4")
                first = np.concatenate(([True], letters[1:] != letters[:-1], np.zeros(len(a), bool)))
                gap = np.arange(len(first)) >= len(letters)
                out.append((np.concatenate((a[:-1], a)), np.concatenate((b[1:], b)), gap, first, np.full(len(gap), key), np.full(len(gap), n)))
                size += len(gap)
                if size >= _OUT or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "gap", "first", "id", "n"])
                    out, size = [], 0

    both = numbered.join(backward.rows.select("word", F.col("part").alias("part_back"), F.col("nodes").alias("nodes_back")), "word")
    columns = both.select("id", "n", "word", "part", "part_back", "nodes", "nodes_back")
    pairs = columns.mapInArrow(run, "a bigint, b bigint, gap boolean, first boolean, id bigint, n bigint")
    return stage(numbered.select("id", "word", "n")), stage(pairs)


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): number of near words of each word that has any, and the best of them."""
    mark = F.struct((-F.col("n")).alias("minus"), "id")
    skipped = pairs.where("not gap").withColumn("mark", mark)
    same, order = Window.partitionBy("a", "b"), Window.partitionBy("a", "b").orderBy("mark")
    ranked = skipped.select(
        "id", "mark", F.count("*").over(same).alias("n"), F.min("mark").over(same).alias("top"), F.lead("mark").over(order).alias("next")
    )
    best = F.when(F.col("mark.id") == F.col("top.id"), F.col("next")).otherwise(F.col("top"))
    replaced = ranked.where("n > 1").select("id", (F.col("n") - 1).alias("n"), best.alias("best"))
    long = pairs.where("not gap AND first").select("a", "b", mark.alias("long"))
    short = pairs.where("gap").select("a", "b", mark.alias("short"))
    met = long.join(short, ["a", "b"])
    one = F.lit(1).cast("bigint").alias("n")
    found = replaced.union(met.select("long.id", one, "short")).union(met.select("short.id", one, "long"))
    near = found.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))
    return near.select("id", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for every word with a form; ``forms``: (id, form), without circles."""
    now = stage(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = stage(now.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.drop("moved")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """One row for each word of ``words`` (word, n): word, form, root, n, n_near, form_n."""
    listed, pairs = node_pairs(words)
    near = stage(near_words(pairs).join(listed.select("id", "n"), "id"))
    near = near.withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))).drop("n")
    ends = roots(near.where("form IS NOT NULL"))
    name = lambda key: listed.select(F.col("id").alias(f"{key}_id"), F.col("word").alias(key))
    rows = listed.join(near.withColumnRenamed("form", "form_id"), "id", "left").join(ends.withColumnRenamed("root", "root_id"), "id", "left")
    rows = rows.join(name("form"), "form_id", "left").join(name("root"), "root_id", "left")
    return rows.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"),
    )


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", times: int = TIMES, **counting) -> DataFrame:
    """The variants of all words of the documents; ``counting`` goes to ``word_counts``."""
    return variants(stage(word_counts(docs, text, doc_id, **counting)), times)
