"""String functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from casequill.functions import chars


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition, for distinct words only; equality in bulk goes through keys."""
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def remove_diacritics(text: Column) -> Column:
    """Drop accents; ``đ`` is a letter of its own and stays."""
    source, target = chars.accent_table()
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), source, target)


def strip_accents(text: Column) -> Column:
    """Drop accents and map ``đ`` to ``d``."""
    source, target = chars.accent_table()
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), source + "đĐ", target + "dD")


def squeeze_spaces(text: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, chars.SPACE + "+", " "))


def compare_key(text: Column) -> Column:
    """Whitespace- and case-insensitive comparison key."""
    return F.lower(squeeze_spaces(text))


def copy_capital(source: Column, suggestion: Column) -> Column:
    """Upper-case first letter on the suggestion when the source starts upper-case."""
    return F.when(
        F.regexp_like(source, F.lit("^" + chars.UPPER)),
        F.concat(F.upper(F.substring(suggestion, 1, 1)), F.substring(suggestion, 2, 1 << 30)),
    ).otherwise(suggestion)


def is_upper(text: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (text == F.upper(text)) & (text != F.lower(text))


#: spellings of the older tone placement and their current form (fixed values)
TONE_PAIRS = (
    ("oà", "òa"), ("oá", "óa"), ("oả", "ỏa"), ("oã", "õa"), ("oạ", "ọa"),
    ("oè", "òe"), ("oé", "óe"), ("oẻ", "ỏe"), ("oẽ", "õe"), ("oẹ", "ọe"),
)
#: the same for the vowel after u, which does not apply after q (fixed values)
TONE_PAIRS_NOT_AFTER_Q = (("uỳ", "ùy"), ("uý", "úy"), ("uỷ", "ủy"), ("uỹ", "ũy"), ("uỵ", "ụy"))


def modern_tones(word: Column) -> Column:
    """Current tone-mark placement of a Vietnamese word."""
    for old, new in TONE_PAIRS:
        word = F.replace(word, F.lit(old), F.lit(new))
    for old, new in TONE_PAIRS_NOT_AFTER_Q:
        word = F.regexp_replace(word, "(?<!q)" + old, new)
    return word


def thousands(amount: Column) -> Column:
    """Whole number with ``.`` between groups of three digits."""
    return F.translate(F.format_number(amount, 0), ",", ".")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(name: Column) -> Column:
    """Last extension with its dot; none for dot-files and for a trailing dot."""
    last = F.substring_index(name, ".", -1)
    before = F.substring(name, F.lit(1), F.length(name) - F.length(last) - 1)
    return F.when((last != "") & (F.ltrim(before, F.lit(".")) != ""), F.concat(F.lit("."), last)).otherwise("")


def file_stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(name)))


def file_folder(path: Column, root_label: str = "(Thư mục gốc)") -> Column:
    parent = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit(root_label)).otherwise(parent)


def strip_chars(text: Column, characters: str) -> Column:
    """Trim any of the characters from both ends."""
    return F.trim(text, F.lit(characters))


def literal_pattern(old: Column) -> Column:
    """Whole-word pattern for a literal; the boundary is asked for only on sides where the
    literal itself starts or ends with a word character."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(old, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(F.regexp_like(old, F.lit("^" + chars.WORD_CHAR)), F.lit(chars.WORD_START)).otherwise("")
    right = F.when(F.regexp_like(old, F.lit(chars.WORD_CHAR + r"\z")), F.lit(chars.WORD_END)).otherwise("")
    return F.concat(left, quoted, right)


def count_words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(rf"[^{chars.SPACE_SET}]+"))


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(rf"[^{chars.SPACE_SET}]"))


def trim_space(text: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    s = chars.SPACE
    return F.regexp_replace(text, rf"^{s}+|{s}+\z", "")


def evaluate_once(df, name: str, value: Column):
    """Add a costly column that a filter will read.

    A filter on a plain projection is moved below it and evaluates the expression a second
    time; it is not moved below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
