"""Match positions and edits inside one text value.

A span column is ``array<struct<start int, end int>>`` with 0-based, end-exclusive
code-point offsets. Everything here is a per-row expression: no shuffle, no UDF,
so the operators built on it also run on streams.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
STAND_IN = "\u0002"
SPAN_TYPE = "array<struct<start:int,end:int>>"
#: hits folded at a time; keeps the array appends short for texts with many hits
BLOCK = 32
#: characters of context on each side of a finding
CONTEXT_RADIUS = 55


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; an outer expression inside a lambda would be
    evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def rule_array(rows: list[dict], schema: str) -> Column:
    """A rule set as one constant array of structs, folded to a literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def empty_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def mark_hits(text: Column, pattern: Column | str, head_groups: bool = False) -> Column:
    """Text with every hit fenced by ``MARK``: ``gap MARK hit MARK gap ...``.

    With ``head_groups`` the pattern has two groups, context then hit, and only the
    second is fenced.
    """
    fenced = f"$1{MARK}$2{MARK}" if head_groups else f"{MARK}$0{MARK}"
    return F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, F.lit(fenced))


def split_hits(text: Column, pattern: Column | str, head_groups: bool = False) -> Column:
    """``[gap, hit, gap, hit, ..., gap]``; one pass of the pattern, and hits keep their
    lookaround context because the text itself is never cut before matching."""
    return F.split(mark_hits(text, pattern, head_groups), MARK)


def _block_spans(block: Column) -> Column:
    lengths = block["lengths"]

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.get(lengths, i * 2)
        end = start + F.get(lengths, i * 2 + 1)
        hit = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("pos"), F.concat(acc["out"], hit).alias("out"))

    return F.aggregate(
        F.sequence(F.lit(0), (F.size(lengths) / 2).cast("int") - 1),
        F.struct(block["pos"].alias("pos"), empty_spans().alias("out")),
        step,
        lambda acc: acc["out"],
    )


def prefix_sums(lengths: Column) -> Column:
    """The sum of the lengths before each element."""

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def spans_of_lengths(lengths: Column) -> Column:
    """Spans from ``[gap, hit, ..., gap]`` lengths: prefix sums, in blocks."""

    def blocks(ls: Column) -> Column:
        hits = (F.size(ls) / 2).cast("int")
        return F.transform(
            F.sequence(F.lit(0), ((hits - 1) / BLOCK).cast("int")),
            lambda b: F.slice(ls, b * (2 * BLOCK) + 1, F.least(F.lit(2 * BLOCK), (hits - b * BLOCK) * 2)),
        )

    placed_type = "array<struct<pos:int,lengths:array<int>>>"
    placed = F.aggregate(
        let(lengths, blocks),
        F.struct(F.lit(0).alias("pos"), F.array().cast(placed_type).alias("out")),
        lambda acc, block: F.struct(
            F.aggregate(block, acc["pos"], lambda s, x: s + x).alias("pos"),
            F.concat(
                acc["out"], F.array(F.struct(acc["pos"].alias("pos"), block.alias("lengths")))
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(placed, _block_spans))


def find_spans(text: Column, pattern: Column | str, head_groups: bool = False) -> Column:
    """All non-overlapping leftmost matches of ``pattern`` as spans.

    The pattern must not match the empty string. ``regexp_like`` keeps texts without a
    hit out of the array work.
    """
    pattern_col = F.lit(pattern) if isinstance(pattern, str) else pattern
    lengths = F.transform(split_hits(text, pattern_col, head_groups), lambda piece: F.length(piece))
    return F.when(F.regexp_like(text, pattern_col), spans_of_lengths(lengths)).otherwise(empty_spans())


def find_hits(text: Column, pattern: Column | str) -> Column:
    """``find_spans`` with the text of each as ``hit``. The pieces of the split are the hits, so none is looked for by its position,
    which would go through the text from its start for every hit."""
    pattern_col = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(pieces: Column) -> Column:
        def whole(span: Column, piece: Column) -> Column:
            return F.when(F.contains(piece, F.lit(STAND_IN)), substring_of(text, span)).otherwise(piece)

        return F.transform(
            spans_of_lengths(F.transform(pieces, lambda piece: F.length(piece))),
            lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), whole(s, F.get(pieces, i * 2 + 1)).alias("hit")),
        )

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(F.regexp_like(text, pattern_col), let(split_hits(text, pattern_col), placed)).otherwise(none)


def substring_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def occupancy(text: Column, spans: Column) -> Column:
    """A string as long as ``text`` with ``1`` under the given disjoint, ordered spans."""

    def build(ss: Column) -> Column:
        cells = F.transform(
            ss,
            lambda s, i: F.concat(
                F.repeat(F.lit("0"), s["start"] - F.coalesce(F.get(ss, i - 1)["end"], F.lit(0))),
                F.repeat(F.lit("1"), s["end"] - s["start"]),
            ),
        )
        tail = F.length(text) - F.coalesce(F.element_at(ss, -1)["end"], F.lit(0))
        return F.concat(F.array_join(cells, ""), F.repeat(F.lit("0"), tail))

    return F.when(F.size(spans) == 0, F.lit("")).otherwise(let(spans, build))


def is_free(mask: Column, span: Column) -> Column:
    """True when no occupied cell lies under the span. The mask is binary, of which a part is found without going through what
    is before it."""
    return ~F.contains(substring_of(mask, span), F.lit(b"1"))


def keep_free(text: Column, taken: Column, fresh: Column) -> Column:
    """Spans of ``fresh`` that overlap no span of ``taken`` (disjoint and ordered)."""
    return F.when(F.size(taken) == 0, fresh).otherwise(
        let(occupancy(text, taken).cast("binary"), lambda mask: F.filter(fresh, lambda s: is_free(mask, s)))
    )


def by_start(spans: Column) -> Column:
    return F.sort_array(spans)


def first_come(ranked: Column, element_type: str) -> Column:
    """Ordered fold: keep an element unless it overlaps one kept before it.

    ``ranked`` is in priority order with ``start`` and ``end`` fields. For short
    arrays (phrase hits); the layered rules use ``keep_free``.
    """
    return F.aggregate(
        ranked,
        F.array().cast(element_type),
        lambda kept, x: F.when(
            F.exists(kept, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"])), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def rebuild(text: Column, edits: Column, piece) -> Column:
    """Text with every edit range replaced by ``piece(edit, original)``.

    ``edits`` are disjoint with ``start``/``end``; they are put in order and the text is
    rebuilt from left to right in one pass, which gives the same result as applying
    them right to left.
    """

    def build(es: Column) -> Column:
        parts = F.transform(
            es,
            lambda e, i: let(
                F.coalesce(F.get(es, i - 1)["end"], F.lit(0)),
                lambda left: F.concat(
                    F.substring(text, left + 1, e["start"] - left), piece(e, substring_of(text, e))
                ),
            ),
        )
        last = F.coalesce(F.element_at(es, -1)["end"], F.lit(0))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text) - last))

    return F.when(F.size(edits) == 0, text).otherwise(let(F.array_sort(edits), build))


def apply_edits(text: Column, edits: Column) -> Column:
    """Replace each edit range by its ``suggestion`` field."""
    return rebuild(text, edits, lambda e, _original: e["suggestion"])


def escape_html(text: Column) -> Column:
    escaped = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def mark_ranges(text: Column, edits: Column) -> Column:
    """HTML-escaped text with ``<mark class=severity title=message>`` around each range."""

    def build(es: Column) -> Column:
        parts = F.transform(
            es,
            lambda e, i: let(
                F.coalesce(F.get(es, i - 1)["end"], F.lit(0)),
                lambda left: F.concat(
                    escape_html(F.substring(text, left + 1, e["start"] - left)),
                    F.lit('<mark class="'), e["severity"],
                    F.lit('" title="'), escape_html(e["message"]), F.lit('">'),
                    escape_html(substring_of(text, e)),
                    F.lit("</mark>"),
                ),
            ),
        )
        last = F.coalesce(F.element_at(es, -1)["end"], F.lit(0))
        rest = F.substring(text, last + 1, F.length(text) - last)
        return F.concat(F.array_join(parts, ""), escape_html(rest))

    return F.when(F.size(edits) == 0, escape_html(text)).otherwise(let(F.array_sort(edits), build))


def context_snippet(text: Column, start: Column, end: Column, radius: int = CONTEXT_RADIUS) -> Column:
    """``radius`` characters on both sides, line breaks as blanks, an ellipsis on cut sides."""
    left = F.greatest(F.lit(0), start - radius)
    right = F.least(F.length(text), end + radius)
    return F.concat(
        F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
        F.replace(F.substring(text, left + 1, right - left), F.lit("\n"), F.lit(" ")),
        F.when(right < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )
