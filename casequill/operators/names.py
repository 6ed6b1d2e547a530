"""File names: quality reasons, normalised names, rename plan with conflicts, batch figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequill.functions import chars
from casequill.functions.spans import let, rule_array
from casequill.functions.text import evaluate_once, file_stem, file_suffix, nfc, remove_diacritics, squeeze_spaces
from casequill.operators.sizing import running_total
from casequill.operators.staging import stage
from casequill.sources import rules
from casequill.sources.files import describe_paths, visible_files

SPECIAL = rf"[^{chars.WORD_SET}{chars.SPACE_SET}\-.()\[\],&+]"
HAS_ACCENT = f"(?iu)[{rules.ACCENTED_LETTERS}]"


def name_reasons(stem: Column, max_length: int = rules.MAX_STEM_LENGTH) -> Column:
    """What is wrong with a file stem, as an array of reasons (empty when fine)."""
    special = F.array_distinct(
        F.slice(F.regexp_extract_all(stem, F.lit(SPECIAL + "+"), F.lit(0)), 1, 3)
    )
    before, after = rules.REASON_LENGTH.format(length="\u0001", limit=max_length).split("\u0001")
    checks = F.array(
        F.when(F.regexp_like(stem, F.lit(HAS_ACCENT)), F.lit(rules.REASON_ACCENTS)),
        F.when(
            F.length(stem) > max_length, F.concat(F.lit(before), F.length(stem).cast("string"), F.lit(after))
        ),
        F.when(F.size(special) > 0, F.concat(F.lit(rules.REASON_SPECIAL), F.array_join(special, ", "))),
        F.when(F.contains(stem, F.lit("  ")), F.lit(rules.REASON_SPACES)),
        F.when(F.contains(stem, F.lit("__")), F.lit(rules.REASON_UNDERSCORES)),
    )
    return F.filter(checks, lambda r: r.isNotNull())


def clean_special(text: Column) -> Column:
    """Drop special characters; collapse blanks, ``--`` and ``__``."""
    kept = squeeze_spaces(F.regexp_replace(text, SPECIAL, ""))
    return F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), "_{2,}", "_")


def _feeds_later_rule(table: dict[str, str]) -> bool:
    """True when some abbreviation is a new word that a phrase of the table contains, so that
    applying one rule can make another one match."""
    inside = {w for phrase in table for w in phrase.lower().split()}
    new = {w for phrase, short in table.items() for w in short.lower().split() if w not in phrase.lower().split()}
    return bool(inside & new)


def abbreviate(text: Column, table=rules.ABBREVIATIONS) -> Column:
    """Whole-word abbreviations, longest phrase first, each seeing the result of the last.

    An ordered fold over the rules whose phrase occurs in the text; they are picked once by
    plain substring tests, unless the table is such that one rule can enable another.
    """
    ordered = sorted(((k, v) for k, v in table.items() if v), key=lambda kv: len(kv[0]), reverse=True)
    steps = rule_array(
        [
            {
                "full": f" {full.lower()} ",
                "pattern": f"(?iu){chars.WORD_START}{chars.quote(full)}{chars.WORD_END}",
                "short": short,
            }
            for full, short in ordered
        ],
        "full:string,pattern:string,short:string",
    )
    spaced = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, chars.NOT_WORD_CHAR, " ")), F.lit(" "))
    if _feeds_later_rule(table):
        present = steps
    else:
        present = let(spaced, lambda low: F.filter(steps, lambda s: F.contains(low, s["full"])))
    return squeeze_spaces(
        F.aggregate(present, text, lambda acc, s: F.regexp_replace(acc, s["pattern"], s["short"]))
    )


def shorten(text: Column, max_length: int = rules.MAX_STEM_LENGTH, table=rules.ABBREVIATIONS) -> Column:
    """At most ``max_length``: abbreviate, then drop dates, then cut with ``..``."""
    dates = "|".join(rules.DATE_WORDS)
    date_pattern = rf"(?iu){chars.WORD_START}(?:{dates}){chars.SPACE}+\p{{Nd}}+{chars.WORD_END}"

    def without_dates(short: Column) -> Column:
        cut = F.concat(F.rtrim(F.substring(short, 1, max_length - 2)), F.lit(".."))
        return F.when(F.length(short) <= max_length, short).otherwise(cut)

    def abbreviated(short: Column) -> Column:
        return F.when(F.length(short) <= max_length, short).otherwise(
            let(squeeze_spaces(F.regexp_replace(short, date_pattern, "")), without_dates)
        )

    return F.when(F.length(text) <= max_length, text).otherwise(let(abbreviate(text, table), abbreviated))


def clean_name(
    stem: Column,
    suffix: Column,
    max_length: int = rules.MAX_STEM_LENGTH,
    table=rules.ABBREVIATIONS,
    map_dstroke: bool = False,
) -> Column:
    """Normalised name of a composed (NFC) stem, with its suffix.

    ``đ`` survives the accent removal by default, so abbreviations for words with ``đ`` do
    not apply; ``map_dstroke`` maps it to ``d`` first.
    """
    plain = F.translate(stem, "đĐ", "dD") if map_dstroke else stem
    unaccented = F.when(F.regexp_like(plain, F.lit(HAS_ACCENT)), remove_diacritics(plain)).otherwise(plain)
    if map_dstroke:
        unaccented = F.when(F.regexp_like(stem, F.lit(HAS_ACCENT)), remove_diacritics(plain)).otherwise(stem)

    def finish(short: Column) -> Column:
        named = F.when(short == "", F.lit("file")).otherwise(short)
        room = F.lit(rules.LONG_NAME_LENGTH) - F.length(suffix)
        too_long = (F.length(named) + F.length(suffix) > rules.MAX_NAME_LENGTH) & (room > 5)
        return F.concat(
            F.when(too_long, F.rtrim(F.substring(named, F.lit(1), room))).otherwise(named), suffix
        )

    return let(
        abbreviate(clean_special(unaccented), table),
        lambda short: let(shorten(short, max_length, table), finish),
    )


def compose_stems(files: DataFrame) -> DataFrame:
    """Add ``composed``: the NFC stem. Only rows with combining marks pass through Python."""
    marked = F.regexp_like("stem", F.lit(r"\p{Mn}"))
    return (
        files.where(~marked)
        .withColumn("composed", F.col("stem"))
        .unionByName(files.where(marked).withColumn("composed", nfc(F.col("stem"))))
    )


def is_problem(stem: Column, max_length: int = rules.MAX_STEM_LENGTH) -> Column:
    """True when ``name_reasons`` has something to say; plain tests in generated code."""
    return (
        (F.length(stem) > max_length)
        | F.contains(stem, F.lit("  "))
        | F.contains(stem, F.lit("__"))
        | F.regexp_like(stem, F.lit(HAS_ACCENT))
        | F.regexp_like(stem, F.lit(SPECIAL))
    )


def problem_files(files: DataFrame, max_length: int = rules.MAX_STEM_LENGTH) -> DataFrame:
    """Described files with ``reasons``, only those with at least one."""
    return files.where(is_problem(F.col("stem"), max_length)).withColumn(
        "reasons", name_reasons(F.col("stem"), max_length)
    )


def proposals(
    files: DataFrame,
    overrides: DataFrame | None = None,
    max_length: int = rules.MAX_STEM_LENGTH,
    map_dstroke: bool = False,
) -> DataFrame:
    """Files to rename: path, folder, name, target, reason, custom.

    ``overrides(path, new_name)`` replace the generated name when not blank; they are
    keyed by path.
    """
    clean = clean_name(F.col("composed"), F.col("suffix"), max_length, map_dstroke=map_dstroke)
    named = evaluate_once(compose_stems(problem_files(files, max_length)), "generated", clean).where(
        F.col("generated") != F.col("name")
    )
    if overrides is None:
        joined = named.withColumn("typed", F.lit(None).cast("string"))
    else:
        joined = named.join(
            overrides.select("path", F.nullif(F.trim("new_name"), F.lit("")).alias("typed")), "path", "left"
        )
    return joined.select(
        "path",
        "folder",
        "name",
        F.coalesce("typed", "generated").alias("target"),
        F.array_join("reasons", "; ").alias("reason"),
        F.col("typed").isNotNull().alias("custom"),
    ).where(F.col("target") != F.col("name"))  # a typed name can be the name it has


def _numbered_forms(names: DataFrame) -> DataFrame:
    """``folder, target, n`` for names of the form stem_n.suffix with n from 1 on."""
    form = r"(?s)^(.*)_([1-9][0-9]{0,8})(\.[^.]+)?$"
    parts = names.select("folder", *[F.regexp_extract("name", form, i).alias(c) for i, c in ((1, "base"), (2, "n"), (3, "tail"))])
    numbered = parts.where(F.col("n") != "")
    return numbered.select("folder", F.concat("base", "tail").alias("target"), F.col("n").cast("bigint").alias("n"))


def resolve_conflicts(wanted: DataFrame, existing: DataFrame, max_tries: int | None = None) -> DataFrame:
    """Give each wanted target a free name: itself, else ``_1``, ``_2`` .. in path order.

    ``existing(folder, name)`` are the names in place. Names that exist and names other
    files will get are both avoided. The file of rank ``r`` (from 0) gets the free number with
    ``r`` free ones below it, which is ``r`` plus the taken numbers with at most ``r`` free ones
    below them. Ranks and counts are running totals over ranges, so a crowded name is never one
    group. With ``max_tries`` numbers from there on are refused and ``new_name`` is null.
    """
    group = ["folder", "target"]
    ranked = running_total(wanted, group, ["path"], F.lit(1), "rank").withColumn("at", F.col("rank") - 1).drop("rank")
    reserved = wanted.select("folder", F.col("target").alias("name"))
    taken = (
        existing.select("folder", F.col("name").alias("target"), F.lit(0).cast("bigint").alias("n"))
        .unionByName(_numbered_forms(existing.select("folder", "name").unionByName(reserved)))
        .join(wanted.select(*group).distinct(), group, "left_semi")
        .distinct()
    )
    free_below = running_total(taken, group, ["n"], F.lit(1), "upto").select(*group, (F.col("n") - F.col("upto") + 1).alias("at"))
    both = free_below.withColumn("is_file", F.lit(0)).unionByName(ranked.withColumn("is_file", F.lit(1)), allowMissingColumns=True)
    placed = running_total(both, group, ["at", "is_file", "path"], 1 - F.col("is_file"), "skipped").where("is_file = 1")
    placed = placed.withColumn("n", F.col("at") + F.col("skipped"))
    stem, suffix = file_stem(F.col("target")), file_suffix(F.col("target"))
    named = F.when(F.col("n") == 0, F.col("target")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), suffix))
    return placed.select(*wanted.columns, (named if max_tries is None else F.when(F.col("n") < max_tries, named)).alias("new_name"))


def rename_plan(
    files: DataFrame,
    overrides: DataFrame | None = None,
    max_length: int = rules.MAX_STEM_LENGTH,
    skip_folders=rules.SKIP_FOLDERS,
    map_dstroke: bool = False,
    max_tries: int | None = None,
) -> DataFrame:
    """Dry-run plan for an inventory of paths: path, folder, old_name, new_name, new_path,
    reason, custom, status, error."""
    described = describe_paths(visible_files(files.select("path"), skip_folders))
    # read four times below: ranking, reserved names, crowded names
    wanted = stage(proposals(described, overrides, max_length, map_dstroke))
    existing = describe_paths(files.select("path")).select("folder", "name")
    resolved = resolve_conflicts(wanted, existing, max_tries)
    parent = F.regexp_extract("path", r"(?s)^(.*/)[^/]*$", 1)
    failed = F.col("new_name").isNull()
    return resolved.select(
        "path",
        "folder",
        F.col("name").alias("old_name"),
        "new_name",
        F.concat(parent, F.col("new_name")).alias("new_path"),
        "reason",
        "custom",
        F.when(failed, F.lit("ERROR")).otherwise(F.lit("PROPOSED")).alias("status"),
        F.when(failed, F.lit(rules.ERROR_NO_FREE_NAME)).alias("error"),
    )


def plan_totals(files: DataFrame, plan: DataFrame, skip_folders=rules.SKIP_FOLDERS) -> DataFrame:
    """Batch totals: scanned files, files with a problem, proposed, unchanged, errors, custom."""
    described = describe_paths(visible_files(files.select("path"), skip_folders))
    scanned = described.agg(
        F.count("*").alias("total_scanned"), F.count_if(is_problem(F.col("stem"))).alias("total_problematic")
    )
    outcome = plan.agg(
        F.count_if(F.col("status") == "PROPOSED").alias("total_proposed"),
        F.count_if(F.col("status") == "ERROR").alias("total_errors"),
        F.count_if("custom").alias("custom_used"),
    )
    both = scanned.unionByName(outcome, allowMissingColumns=True)
    totals = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    return totals.withColumn(
        "total_unchanged", F.col("total_problematic") - F.col("total_proposed") - F.col("total_errors")
    )


def files_per_folder(plan: DataFrame) -> DataFrame:
    return plan.groupBy("folder").agg(F.count("*").alias("files"), F.count_if("custom").alias("custom_files"))


def report_lines(plan: DataFrame) -> DataFrame:
    """Readable plan, one text block per file, for a sorted text sink."""
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("path")),
        F.concat(F.lit("     Ly do: "), F.col("reason")),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("     Loi: "), F.col("error"))).otherwise(
            F.concat(F.lit("     De xuat: "), F.col("new_name"))
        ),
    )
    return plan.select("folder", "old_name", "path", block.alias("block"))


def parse_overrides(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Typed names given as a JSON map of path to name, as ``path, new_name`` rows."""
    entries = F.explode(F.from_json(column, "map<string,string>"))
    return payload.select(entries.alias("path", "new_name"))
