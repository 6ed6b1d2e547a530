"""Character classes and accent tables shared by the text operators.

The classes are spelled out with Unicode properties instead of ``\\w`` so that a
pattern means the same with and without Java's ``(?U)`` flag, and so that
combining marks are not word characters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

WORD_SET = r"\p{L}\p{N}_"
WORD_CHAR = rf"[{WORD_SET}]"
NOT_WORD_CHAR = rf"[^{WORD_SET}]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
LETTER_OR_MARK = r"[\p{L}\p{Nl}\p{No}\x{0300}-\x{036f}]"
DIGIT = r"\p{Nd}"
SPACE_SET = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
SPACE = rf"[{SPACE_SET}]"
UPPER = r"[\p{IsUppercase}]"

WORD_START = rf"(?<!{WORD_CHAR})"
WORD_END = rf"(?!{WORD_CHAR})"

#: letters and combining marks, with inner hyphens and apostrophes
TOKEN = rf"{LETTER_OR_MARK}+(?:[-']{LETTER_OR_MARK}+)*"

_JAVA_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-&#])")


def quote(literal: str) -> str:
    """Escape a literal for use inside a Java pattern."""
    return _JAVA_SPECIAL.sub(r"\\\1", literal)


def alternation(literals, longest_first: bool = True) -> str:
    """``a|b|c`` over quoted literals."""
    items = sorted(literals, key=len, reverse=True) if longest_first else list(literals)
    return "|".join(quote(x) for x in items)


def strip_marks(text: str) -> str:
    """Canonical decomposition without nonspacing marks (driver-side, for rule tables)."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: each precomposed letter and its base letter.

    Built from the Unicode database: every character whose decomposition without
    nonspacing marks is one other character.
    """
    source, target = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(char):
            continue
        base = strip_marks(char)
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)
