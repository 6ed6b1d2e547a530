"""Reviewed replacement lists of any length, applied to documents.

A list's items are rows. Replacements act one after the other, longest first, and later ones see
what earlier ones wrote. Lists of words of which no replacement holds another give the same in any order and
are applied in one pass for each different replacement. To run only the items that can act, the words of all items are joined with
the words of the text and of the replacements: a match covers whole words, so an item of which one
word occurs in neither can never match. What remains is folded over the text.

Lists of ``FEW_ITEMS`` items or fewer are gathered as one array per document and cleaned there, so their
items are shuffled once. Longer lists stay rows until the items that can act are known.

One kind of item can make new words out of two neighbours: where ``old`` starts or ends outside a
word and ``new`` inside one. Documents with such an item keep all their items.

Defined cases: a null ``old`` is empty, an empty ``new`` becomes the default mask; empty items and
repeats of an ``old`` in other letter case are rejected and counted. A null text stays null. A null
id has no list. Documents without a list come back as they are. No limits unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions.spans import let
from casequill.operators.pii import REPLACEMENTS_TYPE, parse_replacements, replace_all
from casequill.operators.sizing import broadcast_if_small
from casequill.operators.staging import stage
from casequill.sources import rules

RUN = chars.WORD_CHAR + "+"
#: lists up to this length are one array and go to the fold as they are; the filter costs more than it saves there
FEW_ITEMS = 200


def items_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``doc_id, seq, old, new`` rows of lists given as JSON."""
    rows = payloads.select("doc_id", F.posexplode(parse_replacements(F.col(payload))).alias("seq", "item"))
    return rows.select("doc_id", "seq", "item.old", "item.new")


def _runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))


def _trimmed(items: DataFrame, max_length: int | None) -> DataFrame:
    trimmed = items.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), F.trim(F.coalesce("old", F.lit(""))).alias("old"),
        F.coalesce(F.nullif(F.trim("new"), F.lit("")), F.lit(rules.MASK_DEFAULT)).alias("new"),
    )
    long = F.lit(False) if max_length is None else F.greatest(F.length("old"), F.length("new")) > max_length
    return trimmed.withColumn("problem", F.when(F.col("old") == "", "empty").when(long, "too long"))


def clean_items(items: DataFrame, max_length: int | None = None) -> DataFrame:
    """Trimmed items with ``problem``: null, ``empty``, ``too long`` or ``repeated`` (not the first of its ``old``)."""
    marked = stage(_trimmed(items, max_length))
    # the first of an old: a hash aggregation, so no list is gathered in one place
    fine = marked.where("problem IS NULL").groupBy("doc_id", F.lower("old").alias("key"))
    first = stage(fine.agg(F.min(F.struct("seq", "old", "new")).alias("item"), F.count("*").alias("n")))
    kept = first.select("doc_id", "item.*", F.lit(None).cast("string").alias("problem"), F.lit(1).cast("bigint").alias("n"))
    again = first.where("n > 1").select("doc_id", "item.*", F.lit("repeated").alias("problem"), (F.col("n") - 1).alias("n"))
    return kept.unionByName(again).unionByName(marked.where("problem IS NOT NULL").withColumn("n", F.lit(1).cast("bigint")))


def acting_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The items, ``doc_id, seq, old, new``, that can match at their turn."""
    inside = lambda side, name: F.regexp_like(name, F.lit(f"^{chars.WORD_CHAR}" if side == "l" else rf"{chars.WORD_CHAR}\z"))
    joining = (~inside("l", "old") & inside("l", "new")) | (~inside("r", "old") & inside("r", "new"))
    whole = items.groupBy("doc_id").agg(F.max(joining).alias("joining")).where("joining").select("doc_id")
    texts = documents.select("doc_id", "text").join(items.select("doc_id").distinct(), "doc_id", "left_semi")
    present = texts.select("doc_id", F.explode(_runs(F.col("text"))).alias("run"))
    present = present.union(items.select("doc_id", F.explode(_runs(F.col("new"))).alias("run"))).distinct()
    asked = items.withColumn("runs", _runs(F.col("old")))
    wanted = asked.select("doc_id", "seq", F.size("runs").alias("need"), F.explode("runs").alias("run"))
    met = wanted.join(present, ["doc_id", "run"]).groupBy("doc_id", "seq").agg(F.count("*").alias("met"), F.first("need").alias("need"))
    able = met.where("met = need").select("doc_id", "seq")
    able = able.union(asked.where(F.size("runs") == 0).select("doc_id", "seq")).union(items.join(whole, "doc_id", "left_semi").select("doc_id", "seq"))
    return items.join(able, ["doc_id", "seq"], "left_semi").select("doc_id", "seq", "old", "new")


def _reason(max_items: int | None) -> Column:
    reason = F.when(F.col("usable") == 0, F.lit("nothing selected"))
    return reason if max_items is None else F.when(F.col("given") > max_items, F.lit("too many replacements")).otherwise(reason)


_COUNTS = ["usable", "empty", "too_long", "repeated"]
_LISTED = ["doc_id", *_COUNTS, "reject_reason", "items"]


def _in_order(items: Column) -> Column:
    """``old, new`` of ``seq, old, new`` structs, longest ``old`` first, then by ``seq``."""
    ranked = F.transform(items, lambda r: F.struct((-F.length(r["old"])).alias("rank"), r["seq"].alias("seq"), r["old"].alias("old"), r["new"].alias("new")))
    return F.transform(F.array_sort(ranked), lambda r: F.struct(r["old"].alias("old"), r["new"].alias("new")))


def replace_listed(text: Column, items: Column) -> Column:
    """``replace_all``, in one pass for each different ``new`` where the items can't act on one another.

    That is so when each ``old`` is a run of word characters and equals no run of a ``new``: an ``old`` then replaces the
    whole runs of the text that equal it, whatever the order. Other lists are folded item by item.
    """
    olds = F.transform(items, lambda r: r["old"])
    made = F.flatten(F.transform(F.array_distinct(F.transform(items, lambda r: r["new"])), _runs))
    free = F.forall(olds, lambda old: F.regexp_like(old, F.lit(rf"^{RUN}\z"))) & ~F.arrays_overlap(olds, made)

    def at_once(present: Column) -> Column:
        def step(acc: Column, new: Column) -> Column:
            olds = F.transform(F.filter(present, lambda r: r["new"] == new), lambda r: r["old"])
            pattern = F.concat(F.lit(chars.WORD_START + "(?:"), F.array_join(olds, "|"), F.lit(")" + chars.WORD_END))
            return let(
                F.split(acc["text"], pattern, -1),
                lambda gaps: F.struct(F.call_function("array_join", gaps, new).alias("text"), (acc["replaced"] + F.size(gaps) - 1).alias("replaced")),
            )

        start = F.struct(text.alias("text"), F.lit(0).alias("replaced"))
        return F.aggregate(F.array_distinct(F.transform(present, lambda r: r["new"])), start, step)

    once = let(F.filter(items, lambda r: F.contains(text, r["old"])), at_once)
    return F.when(free, once).otherwise(replace_all(text, items))


def _short_lists(items: DataFrame, max_items: int | None, max_length: int | None) -> DataFrame:
    """Counts and the items to fold, one row per document; lists are short, so they fit in a row."""
    gathered = _trimmed(items, max_length).groupBy("doc_id").agg(F.collect_list(F.struct("seq", "old", "new", "problem")).alias("all"))
    n = lambda problem: F.size(F.filter("all", lambda r: r["problem"] == problem))
    fine = F.filter("all", lambda r: r["problem"].isNull())
    keyed = F.array_sort(F.transform(fine, lambda r: F.struct(F.lower(r["old"]).alias("key"), r["seq"].alias("seq"), r["old"].alias("old"), r["new"].alias("new"))))
    first = let(keyed, lambda ks: F.filter(ks, lambda r, i: (i == 0) | (F.get(ks, i - 1)["key"] != r["key"])))
    rows = gathered.withColumn("first", first).select(
        "doc_id", F.size("first").alias("usable"), n("empty").alias("empty"), n("too long").alias("too_long"),
        F.size("all").alias("given"), _in_order(F.col("first")).alias("items"),
    )
    rows = rows.withColumn("repeated", F.col("given") - F.col("usable") - F.col("empty") - F.col("too_long")).withColumn("reject_reason", _reason(max_items))
    return rows.select(*_LISTED)


def _long_lists(documents: DataFrame, items: DataFrame, max_items: int | None, max_length: int | None) -> DataFrame:
    """The same for lists of any length, of which only the items that can act come into a row."""
    cleaned = stage(clean_items(items, max_length))
    n = lambda problem: F.sum(F.when(F.col("problem") == problem, F.col("n")).otherwise(0))
    lists = cleaned.groupBy("doc_id").agg(
        F.count_if(F.col("problem").isNull()).alias("usable"), n("empty").alias("empty"), n("too long").alias("too_long"),
        n("repeated").alias("repeated"), F.sum("n").alias("given"),
    )
    lists = stage(lists.withColumn("reject_reason", _reason(max_items)))
    fine = cleaned.where("problem IS NULL").join(lists.where("reject_reason IS NULL"), "doc_id", "left_semi")
    acting = acting_items(documents, fine)
    folded = acting.groupBy("doc_id").agg(_in_order(F.collect_list(F.struct("seq", "old", "new"))).alias("items"))
    return lists.join(folded, "doc_id", "left").select(*_LISTED)


def apply_lists(documents: DataFrame, items: DataFrame, max_items: int | None = None, max_length: int | None = None, few: int = FEW_ITEMS) -> DataFrame:
    """``doc_id, text, replaced, usable, empty, too_long, repeated, reject_reason`` for every document.

    ``items(doc_id, seq, old, new)``; ``seq`` is distinct within a document. A list over ``max_items`` is refused whole.
    Lists of more than ``few`` items are filtered by words first, which changes no result.
    """
    many = stage(items.groupBy("doc_id").count().where(F.col("count") > few).select("doc_id"))
    if many.isEmpty():
        lists = _short_lists(items, max_items, max_length)
    else:
        short = items.join(broadcast_if_small(many), "doc_id", "left_anti")
        long = items.join(broadcast_if_small(many), "doc_id", "left_semi")
        lists = _short_lists(short, max_items, max_length).unionByName(_long_lists(documents, long, max_items, max_length))
    rows = documents.select("doc_id", "text").join(lists, "doc_id", "left")
    usable = F.when(F.col("reject_reason").isNull(), F.col("items"))
    done = rows.withColumn("r", replace_listed(F.col("text"), F.coalesce(usable, F.array().cast(REPLACEMENTS_TYPE))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return done.select("doc_id", "r.text", F.col("r.replaced").cast("bigint").alias("replaced"), *[zero(c) for c in _COUNTS], "reject_reason")
