"""Nearest dictionary words by blocks of the dictionary.

Words are compared without accents first. A letter with the number of its occurrence is a tag (``a0``,
``a1``, ``n0``), so a word is a set of tags, and two words can't have more letters in common than tags. A
ratio of ``r`` asks for ``r (la + lb) / 2`` common letters.

The dictionary is cut into blocks by length, and lengths with very many words by hashes as well; an asked word goes only to
the blocks of lengths that it may meet, once to each, so with a dictionary of one block it is shuffled once. In a block the words of one
length are held against the words of the lengths around it by a 52-bit set of tags, many at a time. (Index entries by rare tags,
which came before, let pass 99 of 100 of the same pairs, but had to be written and shuffled several times for each word.)
What passes is measured by a bit-parallel longest common subsequence, 64
letters at a time for many pairs together, which no matching ratio exceeds. Candidates are then scored
by falling bound until the best ones of the block are certain. All of it is exact: no pair that qualifies is lost.

The asked words of a block are cut into slices by hashes, so neither a common length nor a large dictionary is one
task. A task holds a block and streams a slice. Pairs with a word of over 64 letters are scored one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequill.functions.similarity import block_ratio
from casequill.functions.spans import rule_array
from casequill.functions.text import strip_accents
from casequill.operators.staging import stage

#: most letters of a word that is measured in bits
LONG = 64
#: letters by which the lengths of a pair may differ
LENGTHS = 2
#: dictionary words in one block, asked words of a block in one slice
BLOCK_ROWS, SLICE_ROWS = 8192, 8192
#: asked words that are measured at once, and those of them that meet a block's sets at once
_TOGETHER, _ROWS = 1024, 128
#: letters whose first and second occurrence make up the bounding set
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def tags(word: str) -> list[str]:
    """Letters with the number of their occurrence."""
    seen: Counter = Counter()
    out = []
    for letter in word:
        out.append(f"{letter}{seen[letter]}")
        seen[letter] += 1
    return out


def least_common(total: int | np.ndarray, ratio: float):
    """Common letters that words of so many letters together need."""
    return np.ceil(ratio * total / 2 - 1e-9).astype(np.int64)


def first_tags(skeleton: str, length: int, ratio: float, order: dict[str, int], marks: int = 0) -> list[str]:
    """The index entries of a word, rarest tag first; ``length`` counts its marks too, ``marks`` are the most of any word."""
    n = len(skeleton)
    # letters of the shortest partner: by the ratio, and by the length, which counts marks
    shortest = max(1, int(np.ceil(n * ratio / (2 - ratio) - 1e-9)))
    if n == length:
        shortest = max(shortest, n - LENGTHS - marks)
    kept = n - int(least_common(n + shortest, ratio)) + 1
    return sorted(tags(skeleton), key=lambda t: (order.get(t, -1), t))[:kept]


def signature(word: str) -> int:
    """Bit i for letter i, bit i + 26 for its second occurrence."""
    found = 0
    for letter in word:
        if (i := _LETTERS.get(letter)) is not None:
            found |= 1 << (i + 26 if found >> i & 1 else i)
    return found


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edit_ratio(a: str, b: str) -> float:
    """One minus the edit distance over the longer length."""
    return 1.0 - _edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words, filled up with 0."""
    width = max(map(len, words), default=0) or 1
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)


class Coded:
    """Dictionary words as numbers of their letters."""

    def __init__(self, words: list[str]) -> None:
        self.letters, codes = np.unique(_matrix(words), return_inverse=True)
        self.codes, self.lengths = codes.reshape(len(words), -1), _lengths(words)


class Pairs:
    """Bit-parallel measures of pairs (i, j) of asked words of at most 64 letters and dictionary words."""

    def __init__(self, asked: list[str], listed: Coded) -> None:
        letters, self.codes = listed.letters, listed.codes
        self.places = np.zeros((len(asked), len(letters)), np.uint64)
        own = _matrix(asked)
        code = np.minimum(np.searchsorted(letters, own), len(letters) - 1)
        row, at = np.nonzero((letters[code] == own) & (own > 0))
        np.bitwise_or.at(self.places, (row, code[row, at]), np.uint64(1) << at.astype(np.uint64))
        self.asked, self.listed = _lengths(asked), listed.lengths

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence."""
        open_ = np.full(len(i), ~np.uint64(0))
        for at in range(int(self.listed[j].max(initial=0))):
            hit = open_ & self.places[i, self.codes[j, at]]
            with np.errstate(over="ignore"):
                open_ = (open_ + hit) | (open_ - hit)
        width = self.asked[i].astype(np.uint64)
        own = np.where(width == 64, ~np.uint64(0), (np.uint64(1) << width % np.uint64(64)) - np.uint64(1))
        return np.bitwise_count(~open_ & own).astype(np.int64)

    def edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distance, by the signs of the differences down a column."""
        n = self.asked[i]
        up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
        last, one = np.uint64(1) << np.maximum(n - 1, 0).astype(np.uint64), np.uint64(1)
        found = n.copy()
        for at in range(int(self.listed[j].max(initial=0))):
            inside = at < self.listed[j]
            here = self.places[i, self.codes[j, at]]
            with np.errstate(over="ignore"):
                same = (((here & up) + up) ^ up) | here | down
            more, less = down | ~(same | up), up & same
            found += np.where(inside, ((more & last) != 0).astype(np.int64) - ((less & last) != 0), 0)
            more, less = (more << one) | one, less << one
            same = here | down
            up, down = np.where(inside, less | ~(same | more), up), np.where(inside, more & same, down)
        return np.where(n > 0, found, self.listed[j])


class _Block:
    """The dictionary words of a block, by length."""

    def __init__(self, rows: list[tuple[str, str]], ratio: float, limit: int, exact: bool) -> None:
        self.ratio, self.limit, self.exact = ratio, limit, exact
        rows = sorted(rows, key=lambda r: (len(r[0]), r[0]))
        self.words, self.skeletons = [r[0] for r in rows], [r[1] for r in rows]
        self.lengths, self.bare, self.signature = _lengths(self.words), _lengths(self.skeletons), _signatures(self.skeletons)
        self.plain = _equal(self.words, self.skeletons)
        self.coded = Coded(self.words), Coded(self.skeletons)

    def best(self, words: list[str], skeletons: list[str]) -> list[tuple]:
        """(number of the asked word, candidate, ratio, score) of the best candidates of each asked word."""
        lengths, bare, sign = _lengths(words), _lengths(skeletons), _signatures(skeletons)
        i, j = self._met(lengths, bare, sign)
        if not len(i):
            return []
        long = (lengths[i] > LONG) | (self.lengths[j] > LONG)
        if long.any():
            # all pairs of a word are ranked together
            whole = np.zeros(len(words), bool)
            whole[i[long]] = True
            slow = whole[i]
            return self._slowly(words, skeletons, i[slow], j[slow]) + self._measured(words, skeletons, i[~slow], j[~slow], lengths, bare)
        return self._measured(words, skeletons, i, j, lengths, bare)

    def _met(self, lengths: np.ndarray, bare: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose lengths and sets of letters allow the ratio."""
        order = np.lexsort((bare, lengths))
        cuts = np.flatnonzero((np.diff(lengths[order]) != 0) | (np.diff(bare[order]) != 0)) + 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for group in np.split(order, cuts):
            n, own = int(lengths[group[0]]), int(bare[group[0]])
            near = np.arange(*np.searchsorted(self.lengths, [n - LENGTHS, n + LENGTHS + 1]))
            total = own + self.bare[near]
            near = near[(self.bare[near] > 0) & (2 * np.minimum(own, self.bare[near]) >= self.ratio * total - 1e-9)]
            if not own or not len(near):
                continue
            total = own + self.bare[near]
            spare, sets = np.minimum(total - 2 * least_common(total, self.ratio), 64).astype(np.int8), self.signature[near]
            for at in range(0, len(group), _ROWS):
                some = group[at : at + _ROWS]
                x, y = np.nonzero(np.bitwise_count(sign[some][:, None] ^ sets).view(np.int8) <= spare)
                found.append((some[x], near[y]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _measured(self, words: list[str], skeletons: list[str], i: np.ndarray, j: np.ndarray, lengths: np.ndarray, bare: np.ndarray) -> list[tuple]:
        if not len(i):
            return []
        # of the long words none is left among the pairs
        short = lambda xs: [x if len(x) <= LONG else "" for x in xs]
        bares, plain = Pairs(short(skeletons), self.coded[1]), _equal(words, skeletons)
        if not self.exact:
            near = 1.0 - bares.edits(i, j) / np.maximum(bare[i], self.bare[j])
            i, j, near = (x[near >= self.ratio] for x in (i, j, near))
            own = 1.0 - Pairs(short(words), self.coded[0]).edits(i, j) / np.maximum(lengths[i], self.lengths[j])
            score = own * 0.65 + near * 0.35
            return self._ranked(words, i, j, own, score)
        base = bares.common(i, j) * 2.0 / (bare[i] + self.bare[j])
        i, j, base = (x[base >= self.ratio] for x in (i, j, base))
        own = base.copy()
        other = ~(plain[i] & self.plain[j])
        own[other] = Pairs(short(words), self.coded[0]).common(i[other], j[other]) * 2.0 / (lengths[i] + self.lengths[j])[other]
        return self._scored(words, skeletons, i, j, own * 0.65 + base * 0.35)

    def _ranked(self, words: list[str], i: np.ndarray, j: np.ndarray, own: np.ndarray, score: np.ndarray) -> list[tuple]:
        out, held = [], Counter()
        for k in np.lexsort((j, self.lengths[j], -score, i)).tolist():
            held[i[k]] += 1
            if held[i[k]] <= self.limit:  # words of the block are in order, so ties are
                out.append((int(i[k]), self.words[j[k]], float(own[k]), float(score[k])))
        return out

    def _scored(self, words: list[str], skeletons: list[str], i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> list[tuple]:
        """Scores by falling bound, until no other candidate of a word can be among the best."""
        out, order = [], np.lexsort((-bound, i))
        for group in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            found: list[tuple] = []
            for k in group.tolist():
                if len(found) >= self.limit and bound[k] < -found[self.limit - 1][0] - 1e-9:
                    break
                a, b = int(i[k]), int(j[k])
                base = block_ratio(skeletons[a], self.skeletons[b])
                if base >= self.ratio:
                    same = words[a] == skeletons[a] and self.plain[b]
                    own = base if same else block_ratio(words[a], self.words[b])
                    found.append((-(own * 0.65 + base * 0.35), len(self.words[b]), self.words[b], own))
                    found.sort()
                    del found[self.limit :]
            out += [(int(i[group[0]]), candidate, own, -minus) for minus, _, candidate, own in found]
        return out

    def _slowly(self, words: list[str], skeletons: list[str], i: np.ndarray, j: np.ndarray) -> list[tuple]:
        """Pairs of long words, one by one."""
        measure, found = block_ratio if self.exact else edit_ratio, {}
        for a, b in zip(i.tolist(), j.tolist()):
            base = measure(skeletons[a], self.skeletons[b])
            if base >= self.ratio:
                own = measure(words[a], self.words[b])
                found.setdefault(a, []).append((-(own * 0.65 + base * 0.35), len(self.words[b]), self.words[b], own))
        return [(a, candidate, own, -minus) for a, rows in found.items() for minus, _, candidate, own in sorted(rows)[: self.limit]]


def _lengths(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def _signatures(words: list[str]) -> np.ndarray:
    return np.fromiter(map(signature, words), np.uint64, len(words))


def _equal(a: list[str], b: list[str]) -> np.ndarray:
    return np.fromiter((x == y for x, y in zip(a, b)), bool, len(a))


_BAND = "low:int,high:int,first:bigint,blocks:bigint,slices:bigint"


def _bands(listed: dict[int, int], asked: dict[int, int]) -> list[dict]:
    """Runs of dictionary lengths with so many words as fit a block, or single lengths in several blocks.

    ``listed`` and ``asked`` count words by length."""
    runs: list[list[int]] = []  # low, high, words
    for n, rows in sorted(listed.items()):
        if runs and runs[-1][2] + rows <= BLOCK_ROWS:
            runs[-1][1:] = [n, runs[-1][2] + rows]
        else:
            runs.append([n, n, rows])
    bands, first = [], 0
    for low, high, rows in runs:
        guests = sum(k for n, k in asked.items() if low - LENGTHS <= n <= high + LENGTHS)
        bands.append({"low": low, "high": high, "first": first, "blocks": -(-rows // BLOCK_ROWS), "slices": max(1, -(-guests // SLICE_ROWS))})
        first += bands[-1]["blocks"]
    return bands


def nearest(sources: DataFrame, lookup: DataFrame, base_ratio: float, limit: int = 3, exact: bool = True) -> DataFrame:
    """(word, candidate, ratio, score): the best ``limit`` candidates of each word of each block.

    ``sources(word, source)``: a word is compared in its form ``source``. ``lookup(word, skeleton)`` is the dictionary. A candidate's length
    differs by ``LENGTHS`` at most and its accent-free form reaches ``base_ratio``. ``exact`` measures matching blocks, else edits.
    """
    spark = sources.sparkSession
    sources, lookup = stage(sources.select("word", "source")), stage(lookup.select("word", "skeleton"))  # each is read twice
    # a row for each length
    by_length = lambda df, name: {r.n: r.rows for r in df.groupBy(F.length(name).alias("n")).agg(F.count("*").alias("rows")).collect()}
    bands = rule_array(_bands(by_length(lookup, "word"), by_length(sources, "source")), _BAND)
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    length = F.length("word")
    home = lookup.select("word", "skeleton", F.explode(F.filter(bands, lambda b: length.between(b["low"], b["high"]))).alias("band")).select(
        (F.col("band.first") + F.pmod(F.xxhash64("word"), "band.blocks")).alias("block"), number(F.col("band.slices")).alias("slice"),
        F.lit(False).alias("guest"), F.col("word").alias("asked"), "word", "skeleton",
    )
    length = F.length("source")
    wanted = F.filter(bands, lambda b: length.between(b["low"] - LENGTHS, b["high"] + LENGTHS))
    guests = sources.select(
        "word", "source", F.explode(wanted).alias("band")
    ).select("word", "source", "band", number(F.col("band.blocks")).alias("block")).select(
        (F.col("band.first") + F.col("block")).alias("block"), F.pmod(F.xxhash64("source"), "band.slices").alias("slice"),
        F.lit(True).alias("guest"), F.col("word").alias("asked"), F.col("source").alias("word"), strip_accents(F.col("source")).alias("skeleton"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, listed, block = None, [], None
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*columns[:3]))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start] and end - start < _TOGETHER:
                    end += 1
                asked, words, skeletons = (c[start:end] for c in columns[3:])
                if keys[start][:2] != key:
                    key, listed, block = keys[start][:2], [], None
                if not keys[start][2]:
                    listed += zip(words, skeletons)
                elif listed:
                    block = block or _Block(listed, base_ratio, limit, exact)
                    found = [(asked[i], *rest) for i, *rest in block.best(words, skeletons)]
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], ["word", "candidate", "ratio", "score"]
                        )
                start = end

    # little data but much work for each row: a fixed number of partitions, which adaptive execution leaves as it is
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = home.union(guests).repartition(partitions, "block", "slice").sortWithinPartitions("block", "slice", "guest", F.length("word"))
    return ordered.mapInArrow(run, "word string, candidate string, ratio double, score double")
