"""Text checking: wrong phrases, formatting, words outside the dictionary.

Paragraph rules are per-row arrays (no shuffle). The dictionary check works on
distinct words: tokens outside the dictionary are grouped once, suggestions are
computed per distinct word, and joined back to the few tokens concerned.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from casequill.functions import chars
from casequill.functions.spans import (
    by_start,
    context_snippet,
    empty_spans,
    find_hits,
    find_spans,
    first_come,
    keep_free,
    let,
    rule_array,
    substring_of,
)
from casequill.functions.text import copy_capital, is_upper, nfc
from casequill.operators import token_scan
from casequill.operators.sizing import MAX_BROADCAST_ROWS, broadcast_if_small, is_small
from casequill.operators.staging import stage
from casequill.operators.word_index import nearest
from casequill.sources import rules

ISSUE_TYPE = (
    "struct<start:int,end:int,kind:string,severity:string,suggestion:string,"
    "message:string,confidence:int>"
)
ISSUES_TYPE = f"array<{ISSUE_TYPE}>"


class FormatRule(NamedTuple):
    pattern: str
    #: replacement for the hit, applied with ``find``; ``None`` appends a blank
    find: str | None
    replace: str
    message: str
    #: cheaper pattern found in every text that has a hit; ``None`` is the pattern itself
    hint: str | None = None


S = chars.SPACE
#: a mark with a blank before it, or with neither a blank nor a digit behind it
_MARKED = rf"[,;:!?](?:[^{chars.SPACE_SET}\p{{Nd}}]|(?<={S}[,;:!?]))"
FORMAT_RULES = (
    FormatRule(r"[ \t]{2,}", r"(?s).+", " ", rules.MESSAGE_SPACES, r"[ \t]{2}"),
    FormatRule(rf"{S}+[,;:!?]", rf"{S}+", "", rules.MESSAGE_SPACE_BEFORE, _MARKED),
    FormatRule(rf"[,;:!?](?=[^{chars.SPACE_SET}\p{{Nd}}])", None, " ", rules.MESSAGE_NO_SPACE_AFTER, _MARKED),
    FormatRule(r"([!?;,])\1+", r"(?s)^(.).*", "$1", rules.MESSAGE_REPEATED, _MARKED),
)


class SpellRules(NamedTuple):
    """Rule pack of one language; the defaults are Vietnamese legal text."""

    phrases: dict[str, str] = rules.PHRASE_ERRORS
    formats: tuple[FormatRule, ...] = FORMAT_RULES
    acronyms: tuple[str, ...] = rules.ACRONYMS
    units: tuple[str, ...] = rules.UNITS
    role_labels: tuple[str, ...] = rules.ROLE_LABELS
    #: put repeated punctuation first, where "no blank after" cannot shadow it
    repeat_first: bool = False


VIETNAMESE = SpellRules()


def _issue(span: Column, kind: str, severity: str, suggestion: Column, message, confidence: int):
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        F.lit(kind).alias("kind"),
        F.lit(severity).alias("severity"),
        suggestion.alias("suggestion"),
        F.lit(message).alias("message"),
        F.lit(confidence).alias("confidence"),
    )


def phrase_issues(text: Column, pack: SpellRules = VIETNAMESE) -> Column:
    """Wrong phrases, longest rule first; an earlier rule takes the place of later ones."""
    none = F.array().cast(ISSUES_TYPE)
    if not pack.phrases:
        return none
    ordered = sorted(pack.phrases.items(), key=lambda kv: len(kv[0]), reverse=True)
    table = rule_array(
        [
            {
                "rank": rank,
                "wrong": wrong.lower(),
                "pattern": f"(?iu){chars.WORD_START}{chars.quote(wrong)}{chars.WORD_END}",
                "right": right,
            }
            for rank, (wrong, right) in enumerate(ordered)
        ],
        "rank:int,wrong:string,pattern:string,right:string",
    )
    span_type = "array<struct<rank:int,start:int,end:int,right:string>>"

    def hits_of(rule: Column) -> Column:
        return F.transform(
            find_spans(text, rule["pattern"]),
            lambda s: F.struct(
                rule["rank"].alias("rank"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                rule["right"].alias("right"),
            ),
        )

    def detect(present: Column) -> Column:
        ranked = F.array_sort(F.flatten(F.transform(present, hits_of)))
        return by_start(
            F.transform(
                first_come(ranked, span_type),
                lambda s: _issue(
                    s,
                    rules.KIND_PHRASE,
                    "error",
                    copy_capital(substring_of(text, s), s["right"]),
                    rules.MESSAGE_PHRASE,
                    rules.CONFIDENCE_PHRASE,
                ),
            )
        )

    # plain substring tests first, in generated code, and one constant pattern over all phrases: nearly every
    # paragraph has no wrong phrase
    any_phrase = reduce(or_, [F.contains(F.lower(text), F.lit(w.lower())) for w in pack.phrases]) & F.regexp_like(text, F.lit(f"(?iu){chars.WORD_START}(?:{chars.alternation(pack.phrases)}){chars.WORD_END}"))
    present = let(F.lower(text), lambda low: F.filter(table, lambda r: F.contains(low, r["wrong"])))
    return F.when(any_phrase, detect(present)).otherwise(none)


FORMAT_RULE_FIELDS = "pattern:string,find:string,replace:string,message:string"


def format_issues(text: Column, taken: Column, pack: SpellRules = VIETNAMESE) -> Column:
    """Formatting hits in rule order, each dropped when it overlaps one kept before.

    An ordered fold over the rules; one pattern over all of them keeps clean paragraphs
    out of it.
    """
    ordered = pack.formats
    if pack.repeat_first:
        ordered = tuple(sorted(ordered, key=lambda r: r.message != rules.MESSAGE_REPEATED))
    # back references count groups from the left, so patterns with a group come first
    any_hit = "|".join(f"(?:{r.pattern})" for r in sorted(ordered, key=lambda r: "\\1" not in r.pattern))
    table = rule_array([r._asdict() for r in ordered], FORMAT_RULE_FIELDS)

    def suggestion(rule: Column, hit: Column) -> Column:
        return F.when(rule["find"].isNull(), F.concat(hit, rule["replace"])).otherwise(
            F.regexp_replace(hit, rule["find"], rule["replace"])
        )

    def layer(kept: Column, rule: Column) -> Column:
        fresh = F.transform(
            keep_free(text, kept, find_hits(text, rule["pattern"])),
            lambda s: _issue(
                s,
                rules.KIND_FORMAT,
                "style",
                suggestion(rule, s["hit"]),
                rule["message"],
                rules.CONFIDENCE_FORMAT,
            ),
        )
        return by_start(F.concat(kept, fresh.cast(ISSUES_TYPE)))

    hints = dict.fromkeys(r.hint for r in ordered)
    hinted = [F.lit(True)] if None in hints or not hints else [F.regexp_like(text, F.lit(hint)) for hint in hints]
    active = F.when(reduce(or_, hinted) & F.regexp_like(text, F.lit(any_hit)), table).otherwise(F.array().cast(f"array<struct<{FORMAT_RULE_FIELDS}>>"))
    return F.aggregate(active, taken.cast(ISSUES_TYPE), layer)


def rule_issues(text: Column, pack: SpellRules = VIETNAMESE) -> Column:
    """Phrase and formatting issues of a paragraph, disjoint, ordered by start."""
    return format_issues(text, phrase_issues(text, pack), pack)


def protected_patterns(pack: SpellRules = VIETNAMESE) -> tuple[str, ...]:
    """Ranges where the dictionary is not asked: links, e-mail, numbers, acronyms, named persons."""
    w, s, letter = chars.WORD_CHAR, chars.SPACE, chars.LETTER
    edge = rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    labels = chars.alternation(pack.role_labels, longest_first=False)
    return (
        rf"https?://[^{chars.SPACE_SET}]+",
        rf"{edge}[{chars.WORD_SET}.+\-]+@[{chars.WORD_SET}.\-]+\.{w}+{edge}",
        rf"{edge}\p{{Nd}}+[A-ZĐ]?[-/.]\p{{Nd}}[{chars.WORD_SET}./\-]*{edge}",
        rf"{edge}[A-ZĐ]{{2,12}}{edge}",
        rf"(?:{labels}){s}+(?:[A-ZĐ]{letter}+(?:{s}+|$)){{2,5}}",
    )


def protected_hints(text: Column, pack: SpellRules = VIETNAMESE) -> tuple[Column, ...]:
    """For each of ``protected_patterns`` a cheap test that every text with a hit passes."""
    # a label is followed by blanks and a capital; tests that begin with a capital of a to z are the fast ones
    ends = "".join(sorted({chars.quote(label[-1]) for label in pack.role_labels if label}))
    other = F.contains(text, F.lit("Đ"))
    named = F.regexp_like(text, F.lit(rf"[A-Z](?<=[{ends}{chars.SPACE_SET}]{S}[A-Z])")) | other if all(pack.role_labels) and ends else F.lit(True)
    return (
        F.contains(text, F.lit("://")), F.contains(text, F.lit("@")), F.regexp_like(text, F.lit(r"[-/.]\p{Nd}")),
        F.regexp_like(text, F.lit("[A-Z][A-ZĐ]")) | other, named,
    )


def protected_spans(text: Column, pack: SpellRules = VIETNAMESE) -> Column:
    none = empty_spans()
    return F.concat(*[F.when(hint, find_spans(text, p)).otherwise(none) for p, hint in zip(protected_patterns(pack), protected_hints(text, pack))])


def guarded_spans(text: Column, pack: SpellRules = VIETNAMESE, rule_ranges: bool = True) -> Column:
    """Ranges where the dictionary is not asked, those of rule issues among them; they may overlap."""
    spans = protected_spans(text, pack)
    if rule_ranges:
        spans = F.concat(spans, F.transform(rule_issues(text, pack), lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"))))
    return spans


def after_number(before: Column) -> Column:
    """The text before a token, cut to 40 characters, ends in a number or a range of numbers."""
    number = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
    interval = rf"{number}(?:{S}*(?:-|–|—|đến){S}*{number})?"
    return F.regexp_like(F.right(before, F.lit(40)), F.lit(rf"(?iu){interval}{S}*$"))


#: characters per position bin of the join with given issues
BIN = 256


def _before(text: Column, first: Column) -> Column:
    """The 40 characters of a text before a position."""
    return F.substring(text, F.greatest(first - 40, F.lit(0)) + 1, F.least(first, F.lit(40)))


def token_rows(paras: DataFrame, *keep: str, guards: Column | None = None, units: tuple[str, ...] = (), wanted: pa.RecordBatch | None = None) -> DataFrame:
    """One row per word token: kept columns, start, end, token, and the block it stands in (block_pos, lead, body).

    Texts are scanned in Arrow batches. ``guards`` are ranges, as of ``guarded_spans``; tokens that meet one are left out, and so
    are ``units`` after a number. With ``wanted`` only tokens of its column ``token`` are rows, and its other columns are added.
    """
    spark = paras.sparkSession
    asked = paras.select(*keep, F.make_valid_utf8("text").alias("text"), (empty_spans() if guards is None else guards).alias("guards"))
    more = [] if wanted is None else [StructField(f.name, from_arrow_type(f.type)) for f in wanted.schema if f.name != "token"]
    hit = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("token", StringType()), *more])
    block = StructType().add("block_pos", "integer").add("lead", "integer").add("body", "string").add("units", "boolean").add("hits", ArrayType(hit))
    schema = StructType([*(asked.schema[name] for name in keep), *block])
    held = None if wanted is None else spark.sparkContext.broadcast(wanted)
    blocks = asked.mapInArrow(token_scan.token_blocks(token_scan.letters(spark), keep, units, held), schema)
    first = lambda t: t["start"] - F.col("block_pos") + F.col("lead")
    counted = F.filter("hits", lambda t: ~(F.lower(t["token"]).isin(*units) & after_number(_before(F.col("body"), first(t)))))
    hits = F.when(F.col("units"), counted).otherwise(F.col("hits")) if units else F.col("hits")
    # an outer explode: Spark puts a filter on the size of its array before a plain one, which makes the array again
    rows = blocks.select(*keep, "block_pos", "lead", "body", F.explode_outer(hits).alias("t")).where(F.col("t").isNotNull())
    return rows.select(*keep, "block_pos", "lead", "body", "t.*")


PARA_KEY = ("doc_id", "para_no", "location")


def _same(a: str, b: str, *names: str) -> Column:
    return reduce(and_, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def _bins(start: Column, end: Column) -> Column:
    """The position bins that a range touches."""
    return F.sequence((start / BIN).cast("int"), ((end - 1) / BIN).cast("int"))


def outside(tokens: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``tokens(*keys, start, end)`` that overlap no row of ``spans(*keys, start, end)``.

    Both are dealt to position bins and joined there, so a long text with many spans is no nested
    loop, and its bins lie in many tasks. Null keys equal null keys. Both joins are merged: the rows come out of
    explodes, of which Spark's size estimate knows nothing, so it would send them through the driver.
    """
    spread = lambda df: df.select(*keys, "start", "end", F.explode(_bins(F.col("start"), F.col("end"))).alias("bin"))
    t, s = spread(tokens).alias("t"), spread(spans).alias("s")
    overlap = (F.col("t.start") < F.col("s.end")) & (F.col("t.end") > F.col("s.start"))
    met = t.join(s.hint("merge"), _same("t", "s", *keys) & (F.col("t.bin") == F.col("s.bin")) & overlap, "left_semi").select(*keys, "start")
    return tokens.alias("t").join(met.distinct().alias("m").hint("merge"), _same("t", "m", *keys, "start"), "left_anti")


def _is_asked(token: Column, pack: SpellRules) -> Column:
    """Tokens that the dictionary is asked for at all."""
    return (F.length(token) > 1) & ~is_upper(token) & ~F.regexp_like(token, F.lit("[²³¹⁰⁴-⁹₀-₉]")) & ~token.isin(*pack.acronyms)


def asked_tokens(paras: DataFrame, words: DataFrame, pack: SpellRules = VIETNAMESE) -> DataFrame:
    """Distinct tokens outside the dictionary with their words, also those in guarded ranges, which are few. Each chunk of the texts
    gives a token once."""
    found = paras.select(F.make_valid_utf8("text").alias("text")).mapInArrow(token_scan.distinct_tokens(token_scan.letters(paras.sparkSession)), "token string")
    asked = found.distinct().where(_is_asked(F.col("token"), pack)).withColumn("word", F.lower("token"))
    return asked.join(broadcast_if_small(words.select("word")), "word", "left_anti")


def asked_words(paras: DataFrame, words: DataFrame, pack: SpellRules = VIETNAMESE) -> DataFrame:
    """The distinct words of ``asked_tokens``."""
    return asked_tokens(paras, words, pack).select("word").distinct()


def _asked_tokens(paras: DataFrame, words: DataFrame, pack: SpellRules, max_broadcast: int, guards: Column | None, *keys: str) -> DataFrame:
    """Tokens outside the dictionary that meet no guarded range: keys, start, end, token, word, context."""
    token = F.col("token")
    candidates = token_rows(paras, *keys, guards=guards, units=pack.units).where(_is_asked(token, pack)).withColumn("word", F.lower("token"))
    known = words.select("word")
    small = is_small(known, max_broadcast)
    if small:
        candidates = candidates.join(F.broadcast(known), "word", "left_anti")
    placed = candidates.select(*keys, "start", "end", "token", "word", _block_context().alias("context"))
    return placed if small else placed.join(known, "word", "left_anti")


def _block_context() -> Column:
    """The context of a token in its block."""
    offset = F.col("lead") - F.col("block_pos")
    return context_snippet(F.col("body"), F.col("start") + offset, F.col("end") + offset)


def unknown_tokens(
    paras: DataFrame, words: DataFrame, pack: SpellRules = VIETNAMESE, max_broadcast: int = MAX_BROADCAST_ROWS,
    issues: DataFrame | None = None,
) -> DataFrame:
    """Checked tokens outside the dictionary: doc_id, para_no, location, start, end, token, word, context.

    With a dictionary within ``max_broadcast`` rows known tokens are dropped where they are produced,
    else by a join of token rows. Ranges where the dictionary is not asked, protected ones and those of rule
    issues, are looked up in the paragraph's own row; nothing is written and texts are not shuffled. ``issues``, with
    the columns of ``tagged_rule_issues``, takes the place of the rules; its rows are joined by position.
    """
    if issues is None:
        return _asked_tokens(paras, words, pack, max_broadcast, guarded_spans(F.col("text"), pack), *PARA_KEY)
    keys = (*PARA_KEY, "tag")
    tagged = paras.select(*PARA_KEY, "text", F.xxhash64("text").alias("tag"))
    # read twice by the overlap join
    placed = stage(_asked_tokens(tagged, words, pack, max_broadcast, guarded_spans(F.col("text"), pack, rule_ranges=False), *keys))
    return outside(placed, issues.select(*keys, "start", "end"), *keys).drop("tag")


#: most tokens with a fix that every Python worker holds, and their bytes
MAX_HELD_ROWS, MAX_HELD_BYTES = 4_000_000, 192 << 20

MIN_BASE_RATIO = 0.67
MIN_RATIO, MIN_RATIO_CAPITAL = 0.78, 0.86


def top_suggestions(scored: DataFrame, limit: int = 3) -> DataFrame:
    """Best candidates per word: score, then shorter, then alphabetical. The rank filter is
    applied before the shuffle as well."""
    order = Window.partitionBy("word").orderBy(
        F.col("score").desc(), F.length("candidate"), F.col("candidate")
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def suggestions(
    sources: DataFrame, lookup: DataFrame, limit: int = 3, exact: bool = True, base_ratio: float = MIN_BASE_RATIO
) -> DataFrame:
    """Top suggestions for distinct words: word, rank, candidate, ratio, score.

    ``sources(word, source)``; ``lookup`` is the dictionary with accent-free forms. The score is 0.65 of the ratio
    and 0.35 of the accent-free forms' ratio, by matching blocks, or by edits where not ``exact``.
    """
    return top_suggestions(nearest(sources, lookup, base_ratio, limit, exact), limit)


def corrections(unknown: DataFrame, words: DataFrame, lookup: DataFrame, exact: bool = True) -> DataFrame:
    """``word, suggestion, ratio`` for distinct unknown words with an acceptable best suggestion.

    Words whose composed form is in the dictionary drop out here (text in decomposed Unicode).
    """
    distinct = unknown.select("word").distinct().withColumn("source", nfc(F.col("word")))
    fresh = distinct.join(words.select(F.col("word").alias("source")), "source", "left_anti").where(
        F.length("source") > 1
    )
    best = suggestions(fresh, lookup, 1, exact)
    return best.where(F.col("ratio") >= MIN_RATIO).select(
        "word", F.col("candidate").alias("suggestion"), "ratio"
    )


def dictionary_issues(
    paras: DataFrame, words: DataFrame, lookup: DataFrame, pack: SpellRules = VIETNAMESE, exact: bool = True,
    issues: DataFrame | None = None,
) -> DataFrame:
    """Warnings for tokens outside the dictionary that have a close enough suggestion."""
    # the texts are read twice, so that no token rows are written: first for the distinct tokens alone
    asked = stage(asked_tokens(paras, words, pack))
    ratio, capital = F.col("ratio"), F.regexp_like("token", F.lit("^" + chars.UPPER))
    fixes = asked.join(corrections(asked, words, lookup, exact), "word").where(ratio >= F.when(capital, MIN_RATIO_CAPITAL).otherwise(MIN_RATIO))
    accepted = stage(fixes.select(
        "token", copy_capital(F.col("token"), F.col("suggestion")).alias("suggestion"),
        F.least(F.lit(95), F.greatest(F.lit(62), F.bround(ratio * 100).cast("int"))).alias("confidence"),
    ))
    if issues is None and is_small(accepted, MAX_HELD_ROWS, MAX_HELD_BYTES):
        # the scan looks its tokens up, so only those with a fix become rows
        guards = guarded_spans(F.col("text"), pack)
        found = token_rows(paras, *PARA_KEY, guards=guards, units=pack.units, wanted=_held(accepted)).withColumn("context", _block_context())
    else:
        # beyond that size token rows are shuffled
        found = unknown_tokens(paras, words, pack, issues=issues).drop("word").join(broadcast_if_small(accepted), "token")
    return found.select(
        "doc_id",
        "para_no",
        "location",
        "start",
        "end",
        F.lit(rules.KIND_SPELLING).alias("kind"),
        F.lit("warning").alias("severity"),
        F.col("token").alias("original"),
        "suggestion",
        F.lit(rules.MESSAGE_SPELLING).alias("message"),
        "confidence",
        "context",
    )


def _held(rows: DataFrame) -> pa.RecordBatch:
    """The rows as one batch in the driver, for a broadcast to the Python workers."""
    table = rows.toArrow().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def tagged_rule_issues(paras: DataFrame, pack: SpellRules = VIETNAMESE) -> DataFrame:
    """Phrase and formatting issues as rows, with a ``tag`` that tells apart texts with equal keys."""
    exploded = paras.select(*PARA_KEY, "text", F.explode(rule_issues(F.col("text"), pack)).alias("i"))
    text, issue = F.col("text"), F.col("i")
    return exploded.select(
        *PARA_KEY,
        F.xxhash64("text").alias("tag"),
        issue["start"].alias("start"),
        issue["end"].alias("end"),
        issue["kind"].alias("kind"),
        issue["severity"].alias("severity"),
        substring_of(text, issue).alias("original"),
        issue["suggestion"].alias("suggestion"),
        issue["message"].alias("message"),
        issue["confidence"].alias("confidence"),
        context_snippet(text, issue["start"], issue["end"]).alias("context"),
    )


def explode_rule_issues(paras: DataFrame, pack: SpellRules = VIETNAMESE) -> DataFrame:
    """Phrase and formatting issues as rows with the columns of ``dictionary_issues``."""
    return tagged_rule_issues(paras, pack).drop("tag")


def check(
    paras: DataFrame, words: DataFrame, lookup: DataFrame, pack: SpellRules = VIETNAMESE, exact: bool = True
) -> DataFrame:
    """All issues of the paragraphs as rows. The rules run twice, for their issues and for the ranges where the
    dictionary is not asked; that is cheaper than writing either."""
    return explode_rule_issues(paras, pack).unionByName(dictionary_issues(paras, words, lookup, pack, exact))


def number_issues(issues: DataFrame) -> DataFrame:
    """Add ``id`` (``issue-n`` within the document) and ``para_index`` (within the paragraph).

    Order: start, longest, kind. The numbering is a window over a document's issues, not
    its text; a document is one input row, so its issues are bounded by that row.
    """
    in_para = Window.partitionBy("doc_id", "para_no").orderBy(
        "start", (F.col("start") - F.col("end")), "kind"
    )
    in_doc = Window.partitionBy("doc_id").orderBy(
        "para_no", "start", (F.col("start") - F.col("end")), "kind"
    )
    return issues.withColumn("para_index", F.row_number().over(in_para)).withColumn(
        "id", F.concat(F.lit("issue-"), F.row_number().over(in_doc))
    )


def severity_counts(issues: DataFrame, *by: str) -> DataFrame:
    """Issue counts per severity; one partial aggregation, no pivot pass over the values."""
    return issues.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES]
    )


def visible(issues: DataFrame, severity: str = "all") -> DataFrame:
    return issues if severity == "all" else issues.where(F.col("severity") == severity)


def default_accepted(issues: DataFrame) -> DataFrame:
    """Issue keys accepted at first: every error."""
    return issues.where(F.col("severity") == "error").select("doc_id", "id")


def accept(accepted: DataFrame, shown: DataFrame) -> DataFrame:
    return accepted.select("doc_id", "id").union(shown.select("doc_id", "id")).distinct()


def unaccept(accepted: DataFrame, shown: DataFrame) -> DataFrame:
    return accepted.select("doc_id", "id").join(shown.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def applicable(issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted issues that carry a suggestion."""
    return issues.where(F.col("suggestion") != "").join(accepted, ["doc_id", "id"], "left_semi")


def nest_issues(paras: DataFrame, issues: DataFrame) -> DataFrame:
    """Non-blank paragraphs with their issues as an array (empty when clean).

    The array of a paragraph is bounded by the paragraph itself.
    """
    nested = issues.groupBy("doc_id", "para_no").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "start", "end", "kind", "severity", "original", "suggestion", "message",
                    "confidence", "context",
                )
            )
        ).alias("issues")
    )
    empty = F.array().cast(nested.schema["issues"].dataType)
    return paras.join(nested, ["doc_id", "para_no"], "left").withColumn(
        "issues", F.coalesce("issues", empty)
    )


def detection_quality(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """Recall on cases with a target, false alarms on cases without.

    ``cases(case_id, target)``; ``issues(case_id, original, severity)``. A case counts as
    caught when an issue's original contains the target. Hits are aggregated per case
    before counting.
    """
    joined = cases.join(issues.select("case_id", "original", "severity"), "case_id", "left")
    per_case = joined.groupBy("case_id", "target").agg(
        F.max(F.coalesce(F.contains("original", F.col("target")), F.lit(False))).alias("caught"),
        F.max(F.coalesce(F.col("severity") == "error", F.lit(False))).alias("alarmed"),
    )
    is_error = F.col("target").isNotNull()
    return per_case.agg(
        F.count_if(is_error).alias("error_cases"),
        F.count_if(is_error & F.col("caught")).alias("caught"),
        F.count_if(~is_error).alias("clean_cases"),
        F.count_if(~is_error & F.col("alarmed")).alias("false_alarms"),
    )


def parse_accepted(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Accepted issue ids given as a JSON list per document, as ``doc_id, id`` rows."""
    return payload.select("doc_id", F.explode(F.from_json(column, "array<string>")).alias("id")).distinct()
