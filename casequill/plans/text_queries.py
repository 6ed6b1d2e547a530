"""Registered queries over documents, notes and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions.spans import apply_edits, mark_ranges
from casequill.functions.text import count_words
from casequill.operators import pii, reviewed, spell
from casequill.operators.staging import shared_folder, stage
from casequill.plans import inputs
from casequill.sources import documents as docs
from casequill.sources import rules
from casequill.sources.sinks import as_json
from casequill.streaming import drop_folder

TEST_PACK = spell.VIETNAMESE._replace(phrases=inputs.TEST_PHRASES)


def long(column, name):
    return F.col(column).cast("bigint").alias(name)


def paragraph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.document_paragraphs(spark, sf_dir).select("doc_id", long("para_no", "para_no"), "location", "text")


def paragraph_join(spark, sf_dir):
    return docs.join_paragraphs(inputs.document_paragraphs(spark, sf_dir))


def word_counts(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select("doc_id", count_words(F.col("text")).cast("bigint").alias("words"))


def rule_issue_counts_by_source(spark, sf_dir):
    paras = docs.non_blank(inputs.document_paragraphs(spark, sf_dir, "source"))
    issues = paras.select("source", F.explode(spell.rule_issues(F.col("text"), TEST_PACK)).alias("i"))
    return spell.severity_counts(issues.select("source", "i.severity"), "source")


def rule_issue_counts_by_document(spark, sf_dir):
    paras = docs.non_blank(inputs.document_paragraphs(spark, sf_dir))
    issues = paras.select("doc_id", F.explode(spell.rule_issues(F.col("text"), TEST_PACK)).alias("i"))
    return spell.severity_counts(issues.select("doc_id", "i.severity"), "doc_id")


def _format_rows(spark, sf_dir):
    pack = spell.VIETNAMESE._replace(phrases={})
    return spell.explode_rule_issues(docs.non_blank(inputs.document_paragraphs(spark, sf_dir)), pack)


def formatting_issues(spark, sf_dir):
    return _format_rows(spark, sf_dir).select(
        "doc_id", long("para_no", "para_no"), long("start", "start_pos"), long("end", "end_pos"),
        "original", "suggestion", "message", "context",
    )


def phrase_issue_counts(spark, sf_dir):
    hits = F.explode(spell.phrase_issues(F.col("text"), TEST_PACK))
    issues = inputs.documents(spark, sf_dir).select("doc_id", hits.alias("i")).select("doc_id", "i.suggestion")
    return issues.groupBy("doc_id", F.lower("suggestion").alias("suggestion")).agg(F.count("*").alias("hits"))


def numbered_issues(spark, sf_dir):
    numbered = spell.number_issues(_format_rows(spark, sf_dir))
    return numbered.select("doc_id", "id", long("para_no", "para_no"), long("para_index", "para_index"), long("start", "start_pos"))


def accepted_issues(spark, sf_dir):
    """Accept what a style view shows, clear one message again, keep what can be applied."""
    issues = stage(spell.number_issues(_format_rows(spark, sf_dir)))
    shown = spell.accept(spell.default_accepted(issues), spell.visible(issues, "style"))
    cleared = spell.unaccept(shown, issues.where(F.col("original").isin("?", "!")))
    return spell.applicable(issues, cleared).groupBy("doc_id").agg(F.count("*").alias("accepted"))


def reviewed_texts(spark, sf_dir):
    pack = spell.VIETNAMESE._replace(phrases={})
    rows = inputs.document_paragraphs(spark, sf_dir).select(
        "doc_id", "para_no", "text", spell.rule_issues(F.col("text"), pack).alias("issues")
    )
    return rows.select(
        "doc_id",
        long("para_no", "para_no"),
        apply_edits(F.col("text"), F.col("issues")).alias("corrected"),
        mark_ranges(F.col("text"), F.col("issues")).alias("marked"),
    )


def issue_payloads(spark, sf_dir):
    paras = docs.non_blank(inputs.document_paragraphs(spark, sf_dir)).select("doc_id", "para_no", "text")
    nested = spell.nest_issues(paras, _format_rows(spark, sf_dir))
    short = F.transform("issues", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["original"].alias("original"), i["severity"].alias("severity")))
    return nested.select("doc_id", long("para_no", "para_no"), as_json(short.alias("issues")).alias("payload"))


def detection_quality(spark, sf_dir):
    """Benchmark texts with a blank put before commas, and as they are."""
    base = inputs.table(spark, sf_dir, "benchmark")
    broken = base.where(F.contains("text", F.lit(", "))).select(
        (F.col("item_id") * 2).alias("doc_id"), F.replace("text", F.lit(", "), F.lit(" , ")).alias("text"), F.lit(" ,").alias("target")
    )
    clean = base.select((F.col("item_id") * 2 + 1).alias("doc_id"), "text", F.lit(None).cast("string").alias("target"))
    cases = broken.unionByName(clean)
    issues = spell.explode_rule_issues(docs.paragraphs(cases)).withColumnRenamed("doc_id", "case_id")
    return spell.detection_quality(cases.withColumnRenamed("doc_id", "case_id"), issues)


def token_statistics(spark, sf_dir):
    tokens = inputs.documents(spark, sf_dir, "lang").select(
        "lang", F.explode(F.regexp_extract_all("text", F.lit(chars.TOKEN), F.lit(0))).alias("token")
    )
    # count per word first: the distinct count then runs over one row per word
    per_word = tokens.groupBy("lang", F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    return per_word.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_words"))


def unknown_words(spark, sf_dir):
    """Words of other documents that no document of good quality uses, with their uses."""
    good = inputs.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    all_docs = inputs.documents(spark, sf_dir)
    words = inputs.words_of(all_docs.join(good, "doc_id", "left_semi"))
    tokens = all_docs.join(good, "doc_id", "left_anti").select(
        F.explode(F.regexp_extract_all("text", F.lit(chars.TOKEN), F.lit(0))).alias("token")
    )
    used = tokens.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("uses"))
    return used.join(words, "word", "left_anti")


def _unknown_sources(spark, sf_dir):
    known = inputs.benchmark_words(spark, sf_dir)
    words = inputs.words_of(inputs.documents(spark, sf_dir)).where(F.length("word") > 1)
    return words.join(known, "word", "left_anti").withColumn("source", F.col("word"))


def suggestions_by_edits(spark, sf_dir):
    best = spell.suggestions(_unknown_sources(spark, sf_dir), inputs.benchmark_lookup(spark, sf_dir), exact=False)
    return best.select("word", long("rank", "rank"), "candidate", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


def suggestions_by_blocks(spark, sf_dir):
    best = spell.suggestions(_unknown_sources(spark, sf_dir), inputs.benchmark_lookup(spark, sf_dir), exact=True)
    return best.select("word", long("rank", "rank"), "candidate", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


def checked_documents(spark, sf_dir):
    """The whole check: phrases, formatting and dictionary, counted per source."""
    paras = docs.non_blank(inputs.document_paragraphs(spark, sf_dir))
    words = inputs.benchmark_words(spark, sf_dir)
    issues = spell.check(paras, words, inputs.benchmark_lookup(spark, sf_dir), TEST_PACK)
    per_doc = spell.severity_counts(issues, "doc_id")
    sources = inputs.table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        per_doc.join(sources, "doc_id")
        .groupBy("source")
        .agg(*[F.sum(s).alias(s) for s in rules.SEVERITIES])
    )


def protected_tokens(spark, sf_dir):
    """Tokens outside the dictionary in lines full of ranges where it is not asked."""
    paras = docs.paragraphs(inputs.guarded_notes(spark, sf_dir))
    unknown = spell.unknown_tokens(paras, inputs.benchmark_words(spark, sf_dir), TEST_PACK)
    return unknown.select("doc_id", long("para_no", "para_no"), long("start", "start_pos"), long("end", "end_pos"), "token", "word", "context")


def dictionary_warnings(spark, sf_dir):
    """Warnings for misspelt words, with suggestions by edits: acceptance, capitals and confidence."""
    paras = docs.paragraphs(inputs.misspelt_notes(spark, sf_dir))
    issues = spell.dictionary_issues(paras, inputs.benchmark_words(spark, sf_dir), inputs.benchmark_lookup(spark, sf_dir), exact=False)
    return issues.select("doc_id", long("start", "start_pos"), long("end", "end_pos"), "kind", "severity", "original", "suggestion", long("confidence", "confidence"))


# --- personal data -----------------------------------------------------------------------


def note_entities(spark, sf_dir):
    return pii.detect(spread_notes(spark, sf_dir)).select(
        "doc_id", long("entity_no", "entity_no"), "type", "value", long("first_pos", "first_pos"), "suggestion"
    )


def spread_notes(spark, sf_dir):
    return inputs.case_notes(spark, sf_dir)


def anonymised_notes(spark, sf_dir):
    return pii.anonymise(spread_notes(spark, sf_dir)).select("doc_id", "text", long("replaced", "replaced"))


def entity_payloads(spark, sf_dir):
    found = spread_notes(spark, sf_dir).select("doc_id", pii.entities_column(F.col("text")).alias("entities"))
    short = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), e["suggestion"].alias("suggestion")))
    return found.select("doc_id", as_json(short.alias("entities")).alias("payload"))


def personal_numbers(spark, sf_dir):
    """Phone and identity numbers in documents and conversations."""
    texts = inputs.table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), "doc_id", F.lit(0).cast("bigint").alias("turn"), "text").unionByName(
        inputs.table(spark, sf_dir, "conversations").select(
            F.lit("conversation").alias("origin"), F.col("conv_id").alias("doc_id"), "turn", "text"
        )
    )
    text = F.col("text")
    kinds = F.array(
        F.struct(F.lit(rules.TYPE_PHONE).alias("type"), F.transform(pii.phones(text), lambda v: F.struct(v.alias("value"), pii.mask_phone(v).alias("mask"))).alias("found")),
        F.struct(F.lit(rules.TYPE_ID12).alias("type"), F.transform(pii.numbers_of_length(text, 12), lambda v: F.struct(v.alias("value"), pii.mask_number(v).alias("mask"))).alias("found")),
        F.struct(F.lit(rules.TYPE_ID9).alias("type"), F.transform(pii.numbers_of_length(text, 9), lambda v: F.struct(v.alias("value"), pii.mask_number(v).alias("mask"))).alias("found")),
    )
    found = texts.select("origin", "doc_id", "turn", F.explode(kinds).alias("k"))
    return found.select("origin", "doc_id", "turn", "k.type", F.explode("k.found").alias("f")).select("origin", "doc_id", "turn", "type", "f.value", "f.mask")


def document_entities(spark, sf_dir):
    return pii.detect(inputs.documents(spark, sf_dir)).groupBy("type").agg(
        F.count("*").alias("entities"), F.count_distinct("doc_id").alias("documents")
    )


def replaced_terms(spark, sf_dir):
    """Hide the first word of every document and rewrite its last one, both wherever they occur."""
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    listed = inputs.documents(spark, sf_dir).select("doc_id", "text", tokens.alias("w")).where(F.size("w") > 0).select(
        "doc_id",
        "text",
        F.array(
            F.struct(F.get("w", 0).alias("old"), F.lit("  ").alias("new")),
            F.struct(F.element_at("w", -1).alias("old"), F.lit("$1-\\").alias("new")),
        ).alias("items"),
    )
    cleaned = listed.select("doc_id", pii.replace_all(F.col("text"), pii.clean_replacements(F.col("items"))).alias("r"))
    return cleaned.select("doc_id", "r.text", long("r.replaced", "replaced"))


def replacement_lists(spark, sf_dir):
    """Typed-in lists joined to documents: the words of one benchmark text each, under review limits."""
    benchmark = inputs.table(spark, sf_dir, "benchmark")
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % benchmark.count()).alias("item_id"))
    words = benchmark.select(
        "item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("seq", "old")
    )
    lists = pii.collect_items(words.select(F.col("item_id").alias("doc_id"), "seq", "old", F.lit("#").alias("new")))
    per_doc = documents.join(lists.withColumnRenamed("doc_id", "item_id"), "item_id").select("doc_id", "items")
    cleaned = pii.clean_replacements(F.col("items"))
    return per_doc.select(
        "doc_id",
        F.size(cleaned).cast("bigint").alias("usable"),
        F.get(cleaned, 0)["old"].alias("first_old"),
        pii.reject_reason(F.col("items"), cleaned).alias("reject_reason"),
    )


def reviewed_documents(spark, sf_dir):
    """Every document under a list of a benchmark text's words and blanks, given as JSON for even ids and as rows for odd ones."""
    benchmark = inputs.table(spark, sf_dir, "benchmark")
    texts = inputs.documents(spark, sf_dir)
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    made = F.transform(words, lambda w, i: F.struct(w.alias("old"), F.when(i % 3 == 0, "").otherwise("<#>").alias("new")))
    blank = F.array(F.struct(F.lit(" ").alias("old"), F.lit("x").alias("new")))
    lists = benchmark.select("item_id", F.concat(made, blank).alias("items"))
    listed = texts.select("doc_id", (F.col("doc_id") % benchmark.count()).alias("item_id")).join(lists, "item_id")
    as_rows = listed.where("doc_id % 2 = 1").select("doc_id", F.posexplode("items").alias("seq", "item")).select("doc_id", "seq", "item.old", "item.new")
    as_text = listed.where("doc_id % 2 = 0").select("doc_id", F.to_json("items").alias("payload"))
    done = reviewed.apply_lists(texts, as_rows.unionByName(reviewed.items_from_json(as_text)))
    return done.drop("too_long")


# --- bytes and streams -------------------------------------------------------------------


def decoded_texts(spark, sf_dir):
    """Texts written in three encodings and read back through the fallback chain."""
    text = F.col("text")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.encode(text, "UTF-8"))
        .when(F.col("doc_id") % 3 == 1, F.encode(text, "UTF-16"))
        .otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
    )
    files = inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit(0).alias("length"), content.alias("content"))
    read = docs.text_files(files)
    return read.select(F.col("path").alias("doc_id"), F.md5("text").alias("digest"), "truncated")


def streamed_issue_counts(spark, sf_dir):
    """The drop folder: documents as a file stream through the paragraph rules, then counted."""
    table = f"{sf_dir.rstrip('/')}/documents.parquet"
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream = drop_folder.read_table(spark, table, spark.read.parquet(table).schema)
    paras = docs.non_blank(docs.paragraphs(stream.select("doc_id", "text", "source"), "source"))
    issues = paras.select("source", F.explode(spell.rule_issues(F.col("text"), TEST_PACK)).alias("i")).select("source", "i.severity")
    drop_folder.run_available(issues, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    written = spark.read.schema("source string, severity string").parquet(f"{folder}/out")
    return spell.severity_counts(written, "source")


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_scan, paragraph_join, word_counts, rule_issue_counts_by_source, rule_issue_counts_by_document,
        formatting_issues, phrase_issue_counts, numbered_issues, accepted_issues, reviewed_texts, issue_payloads,
        detection_quality, token_statistics, unknown_words, suggestions_by_edits, suggestions_by_blocks,
        checked_documents, protected_tokens, dictionary_warnings, reviewed_documents, note_entities, anonymised_notes, entity_payloads, personal_numbers, document_entities,
        replaced_terms, replacement_lists, decoded_texts, streamed_issue_counts,
    )
}
