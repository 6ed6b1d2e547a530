"""Mixing sources to target weights by temperature.

The share ``p`` of each source in all tokens (words of whole texts) becomes the weight
``p ** a``, normalised. The exponent ``a`` is bisected between 0 (all sources alike) and 1 (as
they are): it is the largest one that reaches the target entropy, raised where needed until no
source is repeated more often than the limit. Without a budget of its own a mix is as small as it
can be with every document in it once: the source with the largest weight per token is read
once, the others ``(weight * budget) / tokens`` times.

Budgets are realised as block permutations. A hash deals the documents of a source into blocks,
about as many as a block has documents. Each epoch orders the blocks by a hash of epoch and
block, and the documents of a block by a hash of epoch and id. Whole epochs are taken as long
as the budget lasts. In the last one all blocks before the cut are taken, and documents of the
cut block as long as they fit. So a source's share of the mix is three values, the cut block's
order, the cut document's order and the number of whole epochs, and which documents are taken is
decided where they are read: texts are not shuffled, and a hot source needs no special care.

Only the cut block of a source is ordered document by document, and only its blocks are summed
in order: both have about the square root of the source's documents.

Defined cases: a null text has no tokens, and null is a source like others. A source without
tokens is read once. Rows that repeat an id are drawn together. No rows in, no rows out. Only
the id, text and source columns are read to decide, and ``mixed_documents`` returns all columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casequill.llm.common import BROADCAST_BYTES, whole_text
from casequill.operators.staging import stage

#: no source is repeated more often on average
MAX_EPOCHS = 2.0
#: entropy that is aimed at, as a part of the largest possible one
TARGET_ENTROPY = 1.0
SEED = "mix"
#: halvings of the interval of exponents, and halvings that one aggregation prepares
HALVINGS, AT_ONCE = 40, 5


def n_tokens(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^ \t-\r]+")).cast("bigint")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def block_of(doc_id: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(_hash(doc_id), 1, 8), 16, 10).cast("bigint"), 32 - bits)


def block_order(source: Column, epoch: Column, block: Column) -> Column:
    return _hash(source, epoch, block)


def document_order(epoch: Column, doc_id: Column) -> Column:
    return _hash(epoch, doc_id)


def bisect(wanted: Callable[[list[float]], list[bool]]) -> float:
    """The largest exponent in 0 to 1 that is wanted, if wanted ones are below unwanted ones; 0 if none is.

    The middles of the next few halvings are known beforehand, so ``wanted`` gets them together.
    """
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // AT_ONCE):
        grid = [low + (high - low) * k / (1 << AT_ONCE) for k in range(1, 1 << AT_ONCE)]
        answers = wanted(grid)
        first, last = -1, len(grid)
        while last - first > 1:
            middle = (first + last) // 2
            first, last = (middle, last) if answers[middle] else (first, middle)
        low, high = (grid[first] if first >= 0 else low), (grid[last] if last < len(grid) else high)
    return high if high == 1.0 and wanted([1.0])[0] else low


def exponent(totals: DataFrame, target_entropy: float | None, max_epochs: float | None, budget: int | None) -> float:
    """The exponent for the token counts of the sources (``tokens``), which stay in the cluster."""
    totals = totals.where("tokens > 0")
    tokens, smallest, largest, n = totals.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or n == 1 or smallest == largest:
        return 1.0
    tokens = float(tokens)
    share = F.col("tokens") / F.lit(tokens)

    def sums(grid: list[float]) -> list[tuple[float, float]]:
        """Of p ** a, and of p ** a * ln p."""
        powers = [F.pow(share, F.lit(a)) for a in grid]
        row = totals.agg(*[F.sum(x) for x in powers], *[F.sum(x * F.log(share)) for x in powers]).first()
        return list(zip(row[: len(grid)], row[len(grid) :]))

    def flat(grid: list[float]) -> list[bool]:
        """Entropy of the weights is at least the target."""
        least = target_entropy * math.log(n) - 1e-12
        return [math.log(z) - a * s / z >= least for a, (z, s) in zip(grid, sums(grid))]

    def repeats(a: float, z: float) -> float:
        """Epochs of the smallest source, which has most."""
        return budget * (smallest / tokens) ** a / z / smallest if budget else (largest / smallest) ** (1 - a)

    def above(grid: list[float]) -> list[bool]:
        """Still repeats more than the limit."""
        return [repeats(a, z) > max_epochs * (1 + 1e-12) for a, (z, _) in zip(grid, sums(grid))]

    a = bisect(flat) if target_entropy is not None else 0.0
    return max(a, bisect(above)) if max_epochs is not None else a


def plan(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    target_entropy: float | None = TARGET_ENTROPY, max_epochs: float | None = MAX_EPOCHS, budget: int | None = None,
) -> tuple[DataFrame, int]:
    """One row per source: tokens, weight, quota, whole epochs, cut block's and cut document's order; and the bits of a block number."""
    if target_entropy is None and max_epochs is None:
        raise ValueError("a target entropy or a repetition limit is needed")
    rows = stage(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), n_tokens(text).alias("tokens")))
    totals = stage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    a = exponent(totals, target_entropy, max_epochs, budget)
    share, power = F.col("tokens") / F.lit(1.0), F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(1.0), F.lit(a))).otherwise(0.0)
    z, per_token, most = totals.agg(F.sum(power), F.max(F.when(share > 0, share / power)), F.max("documents")).first()
    bits = min(31, max(1, math.ceil(math.log2(most or 1) / 2)))
    # weight * budget, with budget = the largest of tokens / weight unless given
    quota = power * F.lit(per_token or 0.0) if budget is None else power / F.lit(z or 1.0) * F.lit(float(budget))
    sources = totals.select(
        "source", "tokens", (power / F.lit(z or 1.0)).alias("weight"), F.round(quota).cast("bigint").alias("quota")
    ).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1))
    sources = stage(sources.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")))
    partial = sources.where("rest > 0").select(F.col("source").alias("s"), "epochs", "rest")
    blocks = (
        rows.groupBy("source", block_of(F.col("id"), bits).alias("block")).agg(F.sum("tokens").alias("tokens"))
        .join(partial, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("block_key", block_order(F.col("source"), F.col("epochs"), F.col("block")))
    )
    in_order = Window.partitionBy("source").orderBy("block_key", "block")
    cut = (
        blocks.withColumn("before", F.sum("tokens").over(in_order) - F.col("tokens"))
        .where("before <= rest AND before + tokens > rest")
        .select(F.col("source").alias("s"), F.col("block").alias("cut_block"), "block_key", "epochs", (F.col("rest") - F.col("before")).alias("room"))
    )
    cut = stage(cut)
    inside = rows.join(
        _small(cut), F.col("source").eqNullSafe(F.col("s")) & (block_of(F.col("id"), bits) == F.col("cut_block"))
    ).withColumn("doc_key", document_order(F.col("epochs"), F.col("id")))
    taken = Window.partitionBy("s").orderBy("doc_key")  # rows of equal order count together
    last = (
        inside.withColumn("filled", F.sum("tokens").over(taken)).where("filled <= room").groupBy("s").agg(F.max("doc_key").alias("cut_doc"))
    )
    ends = cut.select("s", F.col("block_key").alias("cut_key"), "cut_block").join(
        last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left"
    )
    found = sources.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return stage(found.select("source", "tokens", "weight", "quota", "epochs", "rest", "cut_key", "cut_block", "cut_doc")), bits


def _small(sources: DataFrame) -> DataFrame:
    """Broadcast hint for a written table of one row per source, if it is within the bound."""
    return F.broadcast(sources) if sources.count() * 256 <= BROADCAST_BYTES else sources


def drawn(sources: DataFrame, bits: int, source: Column, doc_id: Column) -> tuple[Column, Column]:
    """For a document joined to its row of the plan: the epochs that it is part of, and its block."""
    block = block_of(doc_id, bits)
    key = block_order(source, F.col("_epochs"), block)
    in_last = (F.col("_rest") > 0) & (
        (key < F.col("_cut_key"))
        | ((block == F.col("_cut_block")) & (document_order(F.col("_epochs"), doc_id) <= F.col("_cut_doc")))
        | F.col("_cut_key").isNull()
    )
    n = F.col("_epochs") + F.when(in_last, 1).otherwise(0)
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")), block


def _joined(docs: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    named = _small(sources).select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in sources.columns[2:]])
    return docs.join(named, docs[source].eqNullSafe(F.col("_source")))


def draw(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document and epoch: id, source, n_tokens, weight, epoch, block and ``place``, which orders an epoch of a source."""
    sources, bits = plan(docs, text, source, doc_id, **options)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), n_tokens(text).alias("n_tokens"))
    epochs, block = drawn(sources, bits, F.col("source"), F.col("id"))
    out = _joined(rows, sources, "source").select(
        "id", "source", "n_tokens", F.col("_weight").alias("weight"), block.alias("block"), F.explode(epochs).alias("epoch")
    )
    place = F.concat(block_order(F.col("source"), F.col("epoch"), F.col("block")), document_order(F.col("epoch"), F.col("id")))
    return out.withColumn("place", place)


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each document as often as the mix has it, all columns as they were."""
    sources, bits = plan(docs, text, source, doc_id, **options)
    epochs, _ = drawn(sources, bits, docs[source], docs[doc_id])
    return _joined(docs, sources, source).withColumn("_copy", F.explode(epochs)).select(*[docs[c] for c in docs.columns])
