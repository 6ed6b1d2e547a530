"""Personal data and the words that give it away.

Base findings come from four patterns: e-mail addresses, IP addresses, payment cards and phone
numbers. Each finding's value is a protected entity. Other words may disclose it as well: a
nickname, a flat, a file number. Words are runs of letters and digits of whole texts; texts and
pairs are counted by different texts, so copies are one observation. For an entity ``c`` and a
word ``t``, with counts of texts and the share ``p = n_c / N`` of texts with the entity:

* The entity's own information is ``own = log2(1 / p)``.
* ``q`` is the lower confidence bound (Wilson, ``CONFIDENCE``) of the probability that a text with
  the word has the entity, so few sightings say little. ``rest = log2(1 / q)`` is what the word
  leaves unknown, ``told = own - rest`` the pointwise mutual information.
* ``evidence = n_t * KL(n_ct / n_t, p)`` in natural units. By the Chernoff bound, words that have nothing
  to do with the entity reach it with probability ``exp(-evidence)`` at most.

A word acts where ``rest`` is at most ``generalise`` bits, half of ``own`` is told at least, and the
probability of chance is at most ``LEVEL``: it is replaced by a general term in the texts that hold
the entity and, where ``rest`` is at most ``remove`` bits, taken out. Words seen with an entity once or twice never
pass. For given counts the answer settles as the corpus grows, as ``rest`` does not depend on its size.

What can't pass is left out before pairs are formed: values and words in fewer texts than the bound
needs, and words in more texts than the value's count allows. The remaining rows (text, entity, word)
are written once; a text's words come from its own rows, so a value in many texts costs its own
rows only.

All of it are built-in functions. Texts are read where they lie: for findings, for the words of
all documents, and for the documents concerned. Words are counted once per document and summed
before the shuffle.

Defined cases: a null text counts as empty. Copies of a text are one text and get the same spans; ids play no
part in the counts, so a null id is an id like others. No rows in, no rows out.
Only the id and text columns are read; ``sanitise`` returns all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequill.functions.spans import apply_edits, find_spans
from casequill.llm.common import BROADCAST_BYTES, whole_text
from casequill.operators.staging import stage

#: kinds in the order of reports. A match starts where a run of its first characters does, or right
#: behind the match before, which is where the plain pattern finds it too, without trying every
#: character of a long run. Repeats that need not give back characters never do.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: a word that may disclose something
TOKEN = r"[\p{L}\p{N}]+"
#: bits that a word may leave unknown of an entity to be generalised, or removed
GENERALISE = 1.0
REMOVE = 0.25
#: normal quantile of the confidence bound, one-sided 95 %
CONFIDENCE = 1.645
#: probability of an acting pair by chance
LEVEL = 1e-6
#: what takes the place of a span
STAND_INS = {**{kind: f"[{kind.upper()}]" for kind in PATTERNS}, "general": "[WORD]", "remove": ""}

_SPAN = "struct<kind: string, start: int, end: int, value: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Checksum of payment cards: every second digit from the right counts double, less 9 beyond 9."""

    def add(total: Column, i: Column) -> Column:
        digit = digits.substr(i, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = (F.length(digits) - i) % 2 == 1
        return total + F.when(doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.regexp_like(value, F.lit(IP_PARTS))
    if kind == "card":
        return F.when(n.between(13, 19), passes_luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """Spans of a pattern with the text under them."""
    return F.zip_with(
        find_spans(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda span, value: F.struct(span["start"].alias("start"), span["end"].alias("end"), value.alias("value")),
    )


def base_spans(text: Column) -> Column:
    """All base findings of a text, kinds in order, each in text order."""

    def of(kind: str) -> Column:
        hits = F.filter(_found(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(
            hits, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        )

    first = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    some = [F.when(first.get(kind, F.lit(True)), of(kind)).otherwise(F.array().cast(f"array<{_SPAN}>")) for kind in PATTERNS]
    return F.concat(*some)


def _entity(span: Column) -> Column:
    """The same value however it is written."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(whole_text(text).alias("body")).withColumn("tag", F.xxhash64("body"))


def _small(rows: DataFrame, *strings: str) -> DataFrame:
    """A written table, broadcast if its rows are few; the bytes of its strings are counted."""
    held = F.sum(F.lit(32) + sum((F.octet_length(c) for c in strings), F.lit(0)))
    return F.broadcast(rows) if (rows.agg(held).first()[0] or 0) <= BROADCAST_BYTES else rows


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, tag, spans, entities) per document; ``tag`` is the hash of its text. Written."""
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("body")).withColumn("tag", F.xxhash64("body"))
    rows = rows.withColumn("spans", base_spans(F.col("body")))
    return stage(rows.select("id", "tag", "spans", F.array_distinct(F.transform("spans", _entity)).alias("entities")))


def certainty(both: Column, of_word: Column) -> Column:
    """Lower confidence bound of the probability that a text with the word has the entity."""
    q, z = both / of_word, CONFIDENCE
    spread = z * F.sqrt(q * (1 - q) / of_word + z * z / (4 * of_word * of_word))
    return (q + z * z / (2 * of_word) - spread) / (1 + z * z / of_word)


def _rated(pairs: DataFrame, total: float, generalise: float, remove: float) -> DataFrame:
    """(entity, word, rest, action) of the acting ones of ``pairs(entity, word, together, of_word, of_entity)``."""
    p, q = F.col("of_entity") / F.lit(total), F.col("together") / F.col("of_word")
    beyond = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    evidence = F.col("of_word") * (q * F.log(q / p) + beyond)
    rest, own = -F.log2(certainty(F.col("together"), F.col("of_word"))), -F.log2(p)
    acting = (p < 1) & (q > p) & (rest <= generalise) & (own - rest >= own / 2) & (evidence >= -math.log(LEVEL))
    action = F.when(rest <= remove, "remove").otherwise("general")
    return pairs.where(acting).select("entity", "word", rest.alias("rest"), action.alias("action"))


def meetings(docs: DataFrame, found: DataFrame, text: str = "text", generalise: float = GENERALISE) -> DataFrame | None:
    """(tag, entity, word, of_entity, of_word) for each text and the pairs in it that may act; None without any. Written."""
    least_q = 2.0**-generalise
    least = math.ceil(CONFIDENCE**2 * least_q / (1 - least_q)) if least_q < 1 else math.inf  # of n texts, n / (n + z * z) is the bound
    spread = found.where("size(entities) > 0").select("tag", F.explode("entities").alias("entity")).distinct()
    often = stage(spread.groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= least))
    values, most = often.agg(F.count("*"), F.max("of_entity")).first()
    if not values:
        return None
    held = stage(spread.join(_small(often, "entity"), "entity"))
    tags = stage(held.select("tag").distinct())
    rows = _texts(docs, text)
    # each of n copies of a text counts 1 / n
    copies = stage(found.groupBy("tag").count().where("count > 1"))
    each = rows.join(_small(copies), "tag", "left").select(
        F.explode(_words(F.col("body"))).alias("word"), (1 / F.coalesce("count", F.lit(1))).alias("part")
    )
    counted = each.groupBy("word").agg(F.round(F.sum("part")).alias("of_word"))
    counted = stage(counted.where((F.col("of_word") >= least) & (F.col("of_word") * least_q <= most)))
    near = rows.join(_small(tags), "tag", "left_semi").select("tag", F.explode(_words(F.col("body"))).alias("word")).distinct()
    near = near.join(_small(counted, "word"), "word")
    return stage(near.join(held, "tag").where(F.col("of_word") * least_q <= F.col("of_entity")))


def disclosing_words(met: DataFrame, total: int, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, word, rest, action) of acting pairs among ``meetings`` in a corpus of ``total`` different texts. Written."""
    pairs = met.groupBy("entity", "word").agg(
        F.count("*").alias("together"), F.first("of_entity").alias("of_entity"), F.first("of_word").alias("of_word")
    )
    pairs = pairs.withColumn("of_word", F.greatest("of_word", F.col("together").cast("double")))
    return stage(_rated(pairs, float(total), generalise, remove))


def _placed(docs: DataFrame, found: DataFrame, acts: DataFrame, text: str) -> DataFrame:
    """(tag, words): where the words of ``acts(tag, word, action)`` stand in the texts, base findings aside."""
    tags = _small(stage(acts.select("tag").distinct()))
    one = _texts(docs, text).join(tags, "tag", "left_semi").groupBy("tag").agg(F.first("body").alias("body"))
    tokens = one.select("tag", F.explode(_found(F.col("body"), TOKEN)).alias("s"))
    hits = tokens.select("tag", "s.*", F.lower("s.value").alias("word")).join(acts, ["tag", "word"])
    hits = hits.select("tag", "start", "end", F.col("action").alias("kind"), "value")
    taken = found.join(tags, "tag", "left_semi").select("tag", F.explode("spans").alias("s"))
    taken = taken.select("tag", "s.start", "s.end", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value")).distinct()
    # a word is free if no finding that starts before reaches it and the next one starts behind it
    base = F.col("kind").isNull()
    reached = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("tag").orderBy("start"))
    following = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("tag").orderBy(F.desc("start")))
    marked = hits.unionByName(taken).withColumn("reached", reached).withColumn("following", following)
    free = marked.where("kind IS NOT NULL AND coalesce(reached <= start, true) AND coalesce(following >= end, true)")
    return free.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("words"))


def spans(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """One row per document: id, tag (hash of its text), base findings, and findings of disclosing words by kind and start."""
    found = find(docs, text, doc_id)
    none = F.array().cast(f"array<{_SPAN}>")
    met = meetings(docs, found, text, generalise)
    if met is None:
        return found.select("id", "tag", "spans", none.alias("words"))
    rated = disclosing_words(met, found.select("tag").distinct().count(), generalise, remove)
    # the strongest action of a word in a text; "general" sorts before "remove"
    acting = met.join(_small(rated, "entity", "word"), ["entity", "word"])
    acts = stage(acting.groupBy("tag", "word").agg(F.max("action").alias("action")))
    placed = _placed(docs, found, acts, text)
    return found.join(placed, "tag", "left").select("id", "tag", "spans", F.coalesce("words", none).alias("words"))


def as_string(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _disjoint(spans: Column) -> Column:
    """Spans in text order; one that begins inside another is dropped and what it has beyond stays with the longer."""

    def take(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["suggestion"].alias("suggestion")
        )
        inside = (F.size(kept) > 0) & (s["start"] < last["end"])
        return F.when(inside, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(joined))).otherwise(F.concat(kept, F.array(s)))

    stand_in = F.create_map(*[F.lit(x) for pair in STAND_INS.items() for x in pair])
    edits = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(stand_in, s["kind"]).alias("suggestion"))
    )
    return F.aggregate(F.array_sort(edits), F.array().cast("array<struct<start: int, end: int, suggestion: string>>"), take)


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with findings replaced by their kind, disclosing words generalised or removed."""
    found = spans(docs, text, doc_id, **options).where("size(spans) + size(words) > 0")
    edits = stage(found.select("id", "tag", _disjoint(F.concat("spans", "words")).alias("edits")).dropDuplicates(["id", "tag"]))
    rows = docs.withColumn("_tag", F.xxhash64(whole_text(text)))
    joined = rows.join(edits.select(F.col("id").alias("_id"), F.col("tag").alias("_tag2"), F.col("edits").alias("_edits")),
                       rows[doc_id].eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("_tag2")), "left")
    new = F.when(F.col("_edits").isNull(), rows[text]).otherwise(apply_edits(rows[text], F.col("_edits")))
    return joined.select(*[new.alias(c) if c == text else rows[c] for c in docs.columns])
