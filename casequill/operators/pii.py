"""Personal data in documents: detection, masks, aliases, replacement.

Detection is a projection: every detector is an array expression over the document
text, so there is no shuffle and the same code runs on streams.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions.spans import find_spans, let, substring_of
from casequill.functions.text import compare_key, literal_pattern, strip_chars
from casequill.sources import rules

ENTITY_TYPE = "array<struct<type:string,value:string,first_pos:int,suggestion:string>>"
S, W, L, U = chars.SPACE, chars.WORD_CHAR, chars.LETTER, chars.UPPER
NAME_WORD = rf"{L}+(?:[-']{L}+)?"
NAME_WORDS = rf"{NAME_WORD}(?:{S}+{NAME_WORD}){{0,4}}"


class PiiRules(NamedTuple):
    """Rule pack of one language; the defaults are Vietnamese legal text."""

    honorifics: tuple[str, ...] = rules.HONORIFICS
    surnames: tuple[str, ...] = rules.SURNAMES
    non_name_terms: tuple[str, ...] = rules.NON_NAME_TERMS
    address_labels: tuple[str, ...] = rules.ADDRESS_LABELS
    address_stops: tuple[str, ...] = rules.ADDRESS_STOP_LABELS


VIETNAMESE = PiiRules()


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{Nd}]", "")


def phones(text: Column) -> Column:
    """Distinct phone numbers with a plausible digit count."""
    hits = F.regexp_extract_all(
        text, F.lit(r"(?<!\p{Nd})(?:\+84|0)(?:[ .-]?\p{Nd}){9,10}(?!\p{Nd})"), F.lit(0)
    )

    def plausible(v: Column) -> Column:
        n = F.length(_digits(v))
        return F.when(F.startswith(v, F.lit("+84")), n.isin(11, 12)).otherwise(n.isin(10, 11))

    return F.array_distinct(F.filter(hits, plausible))


def numbers_of_length(text: Column, n: int) -> Column:
    """Distinct digit runs of exactly ``n`` digits."""
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(rf"(?<!\p{{Nd}})\p{{Nd}}{{{n}}}(?!\p{{Nd}})"), F.lit(0))
    )


def _mentions(text: Column, terms) -> Column:
    """Cheap test in generated code that keeps the long patterns off most documents."""
    low = F.lower(text)
    test = F.lit(False)
    for t in terms:
        test = test | F.contains(low, F.lit(t.lower()))
    return test


def addresses(text: Column, pack: PiiRules = VIETNAMESE) -> Column:
    """Distinct labelled addresses: up to the sentence or line end or the next field."""
    labels = chars.alternation(pack.address_labels, longest_first=False)
    stops = "|".join(chars.quote(s) + rf"{S}*:" for s in pack.address_stops)
    pattern = rf"(?iu)(?:{labels}){S}*[:\-]?{S}*([^\n]+?)(?={S}*(?:[.;\n]|{stops}|\z))"
    hits = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda a: strip_chars(a, " ,:-")
    )
    found = F.array_distinct(F.filter(hits, lambda a: F.length(a) >= 5))
    return F.when(_mentions(text, pack.address_labels), found).otherwise(F.array().cast("array<string>"))


def clean_name(raw: Column) -> Column:
    """Leading capitalised words of a candidate, cut before a following field word."""
    cut = F.regexp_replace(
        raw,
        rf"(?ius){S}+(?=sinh{S}+năm|sinh{S}+ngày|địa{S}+chỉ|trú{S}+tại|thường{S}+trú|CCCD|CMND|"
        rf"là{S}+|có{S}+|đã{S}+).*",
        "",
    )
    word = rf"{U}(?:{L}*)(?:[-']{L}+)?"
    return F.regexp_replace(F.regexp_extract(cut, rf"^{word}(?:{S}+{word})*", 0), S + "+", " ")


def is_probable_name(name: Column, terms=rules.NON_NAME_TERMS) -> Column:
    """Two to five words and none of the terms that mark institutions and documents."""
    key = compare_key(name)
    excluded = F.lit(False)
    for t in terms:
        excluded = excluded | F.contains(key, F.lit(t))
    return F.size(F.split(name, " ")).between(2, 5) & ~excluded


def _name_patterns(pack: PiiRules) -> tuple[str, ...]:
    honorifics = chars.alternation(pack.honorifics)
    surnames = chars.alternation(pack.surnames, longest_first=False)
    return (
        rf"(?iu)({chars.WORD_START}(?:{honorifics}){S}*[:\-]?{S}+)({NAME_WORDS})",
        rf"(?iu)({chars.WORD_START}(?:họ{S}*(?:và)?{S}*tên|họ tên|tên người){S}*[:\-]{S}*)({NAME_WORDS})",
        rf"(?iu)({chars.WORD_START})((?:{surnames})(?:{S}+{NAME_WORD}){{1,4}})",
    )


def _inner_phrases(name_key: Column) -> Column:
    """Every proper run of whole words inside a name key; words also end at ``-`` and ``'``."""
    atoms = F.regexp_extract_all(name_key, F.lit(rf"{L}+[-' ]?"), F.lit(0))

    def runs(parts: Column) -> Column:
        n = F.size(parts)
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.transform(
                    F.sequence(F.lit(1), n - i + 1),
                    lambda k: F.regexp_replace(F.array_join(F.slice(parts, i, k), ""), "[-' ]$", ""),
                ),
            )
        )

    return F.filter(let(atoms, runs), lambda p: p != name_key)


def names(text: Column, found_addresses: Column, pack: PiiRules = VIETNAMESE) -> Column:
    """Distinct personal names in the order of first appearance.

    A candidate that overlaps an address is dropped; so is one that is a run of whole
    words inside a longer name that was found.
    """
    none = F.array().cast("array<string>")
    address_spans = F.flatten(
        F.transform(found_addresses, lambda a: find_spans(text, F.concat(F.lit(r"\Q"), a, F.lit(r"\E"))))
    )

    def candidates(blocked: Column) -> Column:
        spans = F.concat(*[find_spans(text, p, head_groups=True) for p in _name_patterns(pack)])
        cleaned = F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), clean_name(substring_of(text, s)).alias("name"))
        )
        free = F.filter(
            cleaned,
            lambda c: ~F.exists(
                blocked,
                lambda b: (c["start"] < b["end"]) & (c["start"] + F.length(c["name"]) > b["start"]),
            ),
        )
        return F.array_distinct(
            F.filter(
                F.transform(free, lambda c: c["name"]),
                lambda n: is_probable_name(n, pack.non_name_terms),
            )
        )

    def longest_only(found: Column) -> Column:
        inner = F.flatten(F.transform(found, lambda n: _inner_phrases(compare_key(n))))
        return let(
            F.array_distinct(inner), lambda runs: F.filter(found, lambda n: ~F.array_contains(runs, compare_key(n)))
        )

    def ordered(kept: Column) -> Column:
        placed = F.transform(
            kept,
            lambda n: F.struct(
                F.instr(F.lower(text), F.lower(n)).alias("pos"),
                F.instr(text, n).alias("own_pos"),
                n.alias("name"),
            ),
        )
        return F.transform(F.array_sort(placed), lambda p: p["name"])

    triggers = pack.honorifics + pack.surnames + ("họ", "tên người")
    found = let(address_spans, candidates)
    return F.when(_mentions(text, triggers), let(let(found, longest_only), ordered)).otherwise(none)


def mask_phone(phone: Column) -> Column:
    digits = _digits(phone)
    return F.when(
        F.length(digits) >= 7, F.concat(F.substring(digits, 1, 4), F.lit("xxxx"), F.right(digits, F.lit(3)))
    ).otherwise(F.lit(rules.MASK_PHONE))


def mask_number(number: Column) -> Column:
    return F.when(
        F.length(number) >= 6, F.concat(F.substring(number, 1, 3), F.lit("xxx"), F.right(number, F.lit(3)))
    ).otherwise(F.lit(rules.MASK_NUMBER))


def alias(index: Column) -> Column:
    """``Tên-A`` to ``Tên-Z`` for the first 26 names (0-based index), then ``Tên-27`` and on."""
    return F.concat(
        F.lit(rules.ALIAS_PREFIX),
        F.when(index < 26, F.char(index + 65)).otherwise((index + 1).cast("string")),
    )


def entities_column(text: Column, pack: PiiRules = VIETNAMESE) -> Column:
    """All entities of a document: phones, 12-digit, 9-digit numbers, addresses, names, each in
    the order of first occurrence, without repeats of the same normalised value."""

    def entity(kind: str, value: Column, suggestion: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            value.alias("value"),
            (F.instr(text, value) - 1).alias("first_pos"),
            suggestion.alias("suggestion"),
        )

    def by_position(values: Column) -> Column:
        placed = F.transform(values, lambda v: F.struct(F.instr(text, v).alias("pos"), v.alias("value")))
        return F.transform(F.array_sort(placed), lambda p: p["value"])

    def listed(kind: str, values: Column, mask) -> Column:
        return F.transform(by_position(values), lambda v: entity(kind, v, mask(v)))

    def with_addresses(found: Column) -> Column:
        return F.concat(
            listed(rules.TYPE_ADDRESS, found, lambda _v: F.lit(rules.MASK_ADDRESS)),
            F.transform(
                names(text, found, pack), lambda n, i: entity(rules.TYPE_NAME, n, alias(i))
            ),
        )

    everything = F.concat(
        listed(rules.TYPE_PHONE, phones(text), mask_phone),
        listed(rules.TYPE_ID12, numbers_of_length(text, 12), mask_number),
        listed(rules.TYPE_ID9, numbers_of_length(text, 9), mask_number),
        let(addresses(text, pack), with_addresses),
    ).cast(ENTITY_TYPE)

    def first_of_key(all_entities: Column) -> Column:
        keys = F.transform(all_entities, lambda e: F.concat(e["type"], F.lit("\u0001"), compare_key(e["value"])))
        return let(
            keys,
            lambda ks: F.filter(
                all_entities, lambda e, i: F.array_position(ks, F.get(ks, i)) == (i + 1).cast("bigint")
            ),
        )

    return let(everything, first_of_key)


def detect(documents: DataFrame, pack: PiiRules = VIETNAMESE) -> DataFrame:
    """Entities as rows: doc_id, entity_no, type, value, first_pos, suggestion."""
    found = documents.select("doc_id", F.posexplode(entities_column(F.col("text"), pack)).alias("pos", "e"))
    return found.select(
        "doc_id", (F.col("pos") + 1).alias("entity_no"), "e.type", "e.value", "e.first_pos", "e.suggestion"
    )


def flag_phone_overlap(entities: DataFrame) -> DataFrame:
    """Mark 9-digit numbers that are the tail of a phone number of the same document."""
    phone = entities.where(F.col("type") == rules.TYPE_PHONE).select(
        "doc_id", F.right(_digits(F.col("value")), F.lit(9)).alias("value")
    ).distinct().withColumn("overlaps_phone", F.lit(True))
    return entities.join(phone, ["doc_id", "value"], "left").withColumn(
        "overlaps_phone", F.coalesce("overlaps_phone", F.lit(False)) & (F.col("type") == rules.TYPE_ID9)
    )


# --- replacement -----------------------------------------------------------------------

REPLACEMENTS_TYPE = "array<struct<old:string,new:string>>"


def parse_replacements(payload: Column) -> Column:
    """Replacement payload as JSON: a list of old/new, or the older ``{old: new}`` map."""
    listed = F.from_json(payload, REPLACEMENTS_TYPE)
    mapped = F.transform(
        F.map_entries(F.from_json(payload, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("old"), e["value"].alias("new")),
    )
    return F.when(F.startswith(F.ltrim(payload), F.lit("[")), listed).otherwise(mapped)


def clean_replacements(items: Column) -> Column:
    """Trimmed, without empty or over-long items, first per case-insensitive ``old``; an empty
    ``new`` becomes the default mask. Longest ``old`` first, ties in input order."""
    limit = rules.MAX_REPLACEMENT_LENGTH
    trimmed = F.transform(
        items,
        lambda r: F.struct(
            F.trim(F.coalesce(r["old"], F.lit(""))).alias("old"),
            F.coalesce(F.nullif(F.trim(r["new"]), F.lit("")), F.lit(rules.MASK_DEFAULT)).alias("new"),
        ),
    )
    valid = F.filter(
        trimmed, lambda r: (F.length(r["old"]) > 0) & (F.length(r["old"]) <= limit) & (F.length(r["new"]) <= limit)
    )

    def first_only(vs: Column) -> Column:
        return let(
            F.transform(vs, lambda r: F.lower(r["old"])),
            lambda ks: F.filter(vs, lambda r, i: F.array_position(ks, F.get(ks, i)) == (i + 1).cast("bigint")),
        )

    ranked = F.transform(
        let(valid, first_only),
        lambda r, i: F.struct(
            (-F.length(r["old"])).alias("rank"), i.alias("seq"), r["old"].alias("old"), r["new"].alias("new")
        ),
    )
    return F.transform(
        F.array_sort(ranked), lambda r: F.struct(r["old"].alias("old"), r["new"].alias("new"))
    )


def reject_reason(items: Column, cleaned: Column) -> Column:
    """Why a replacement list is refused; null when it is fine."""
    return F.when(items.isNull() | (F.size(items) > rules.MAX_REPLACEMENTS), F.lit("too many replacements")).when(
        F.size(cleaned) == 0, F.lit("nothing selected")
    )


def replace_all(text: Column, cleaned: Column) -> Column:
    """``struct<text, replaced>``: whole-word literal replacements applied one after the other,
    later ones seeing the result of earlier ones. An ``old`` with a line break matches nothing,
    because replacement works within paragraphs."""

    def step(acc: Column, r: Column) -> Column:
        pattern = literal_pattern(r["old"])
        applies = F.contains(acc["text"], r["old"]) & ~F.contains(r["old"], F.lit("\n"))
        # one pass of the pattern gives both the text and the count
        changed = let(
            F.split(acc["text"], pattern, -1),
            lambda gaps: F.struct(
                F.call_function("array_join", gaps, r["new"]).alias("text"), (acc["replaced"] + F.size(gaps) - 1).alias("replaced")
            ),
        )
        return F.when(applies, changed).otherwise(acc)

    start = F.struct(text.alias("text"), F.lit(0).alias("replaced"))
    return F.aggregate(cleaned, start, step)


def replace_in_documents(documents: DataFrame, replacements: DataFrame) -> DataFrame:
    """Apply ``replacements(doc_id, items)`` to ``documents(doc_id, text)``.

    Result: doc_id, text, replaced, reject_reason. Refused lists leave the text as it is.
    """
    joined = documents.select("doc_id", "text").join(replacements.select("doc_id", "items"), "doc_id")
    cleaned = joined.withColumn("cleaned", clean_replacements(F.col("items")))
    judged = cleaned.withColumn("reject_reason", reject_reason(F.col("items"), F.col("cleaned")))
    usable = F.when(F.col("reject_reason").isNull(), F.col("cleaned")).otherwise(
        F.array().cast(REPLACEMENTS_TYPE)
    )
    done = judged.select("doc_id", "reject_reason", replace_all(F.col("text"), usable).alias("r"))
    return done.select("doc_id", "r.text", "r.replaced", "reject_reason")


def collect_items(rows: DataFrame) -> DataFrame:
    """``doc_id, seq, old, new`` rows to ``doc_id, items``.

    One item more than the limit is kept per document, which is enough to refuse the list,
    so a document with too many rows never builds a long array.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    kept = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rules.MAX_REPLACEMENTS + 1)
    items = F.array_sort(F.collect_list(F.struct("n", "old", "new")))
    return kept.groupBy("doc_id").agg(
        F.transform(items, lambda r: F.struct(r["old"].alias("old"), r["new"].alias("new"))).alias("items")
    )


def anonymise(documents: DataFrame, pack: PiiRules = VIETNAMESE) -> DataFrame:
    """Detect and replace in one projection: doc_id, text, replaced, entities.

    Every detected entity is accepted; edits by a user come in through
    ``replace_in_documents``. The list limit guards typed-in lists and does not apply here.
    """
    found = documents.select("doc_id", "text", entities_column(F.col("text"), pack).alias("entities"))
    items = F.transform(
        "entities", lambda e: F.struct(e["value"].alias("old"), e["suggestion"].alias("new"))
    )
    done = found.select("doc_id", "entities", replace_all(F.col("text"), clean_replacements(items)).alias("r"))
    return done.select("doc_id", "r.text", "r.replaced", "entities")
