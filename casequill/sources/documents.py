"""Documents as paragraphs, page texts, encoded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequill.functions.text import is_blank
from casequill.sources.rules import BODY_LOCATION


def paragraphs(documents: DataFrame, *keep: str, location: str = BODY_LOCATION) -> DataFrame:
    """One row per line of ``documents.text``: doc_id, para_no (from 1), location, text.

    Narrow: an explode inside the scan stage. ``keep`` names columns carried along.
    """
    lines = documents.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select(
        "doc_id", *keep, (F.col("pos") + 1).alias("para_no"), F.lit(location).alias("location"), "text"
    )


def non_blank(paras: DataFrame) -> DataFrame:
    """Paragraphs that are worth checking; blank ones count as zero words elsewhere."""
    return paras.where(~is_blank(F.col("text")))


def join_paragraphs(paras: DataFrame, lines_per_part: int = 100_000) -> DataFrame:
    """Paragraphs back to text: doc_id, part_no, text.

    Parts are runs of ``lines_per_part`` consecutive paragraph numbers, so no group
    grows with the document; a document with fewer lines is one part. Joining the
    parts by a line break in part order gives the document.
    """
    part = F.floor((F.col("para_no") - 1) / lines_per_part).alias("part_no")
    return paras.groupBy("doc_id", part).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda line: line["text"]
            ),
            "\n",
        ).alias("text")
    )


def _windows_1252(content: Column) -> Column:
    """Windows-1252, or Latin-1 when a byte is not assigned in it. Both differ from Latin-1
    only in 0x80-0x9F, so the first is a character mapping of the second."""
    assigned, target, unassigned = [], [], []
    for byte in range(0x80, 0xA0):
        try:
            target.append(bytes([byte]).decode("cp1252"))
            assigned.append(chr(byte))
        except UnicodeDecodeError:
            unassigned.append(chr(byte))
    latin = F.decode(content, "ISO-8859-1")
    return F.when(F.regexp_like(latin, F.lit(f"[{''.join(unassigned)}]")), latin).otherwise(
        F.translate(latin, "".join(assigned), "".join(target))
    )


def decode_bytes(content: Column) -> Column:
    """Text of raw bytes: UTF-8 (with or without mark), UTF-16 only with a mark, else
    Windows-1252, else Latin-1."""
    mark = F.hex(F.substring(content, 1, 2))
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(
        F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")),
        F.regexp_replace(utf8, "^\\x{feff}", ""),
        _windows_1252(content),
    )


def text_files(files: DataFrame, max_bytes: int | None = None, max_chars: int | None = None) -> DataFrame:
    """``path, length, content`` rows to ``path, length, text, truncated``.

    Whole files by default. A preview reads at most ``max_bytes`` of a file, back to the last
    whole UTF-8 character, and shows at most ``max_chars`` characters; ``truncated`` tells
    when either cut the text.
    """
    content, cut = F.col("content"), F.lit(False)
    if max_bytes is not None:
        cut = F.octet_length("content") > max_bytes
        first = F.substring("content", 1, max_bytes)
        # a character begins at most three bytes before the cut; if the bytes up to there are
        # valid UTF-8, what is behind them is the part of a character
        shorter = [F.substring("content", 1, max_bytes - k) for k in range(4)]
        whole = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), x) for x in shorter], first)
        # UTF-16: whole units, and no first half of a pair at the end
        even = max_bytes - max_bytes % 2
        mark = F.hex(F.substring("content", 1, 2))
        high = F.hex(F.substring("content", F.when(mark == "FFFE", even).otherwise(even - 1), F.lit(1)))
        units = F.substring("content", F.lit(1), F.when(high.between("D8", "DB"), even - 2).otherwise(even))
        whole = F.when(mark.isin("FFFE", "FEFF"), units).otherwise(whole)
        content = F.when(cut, whole).otherwise(F.col("content"))
    decoded = files.select("path", "length", decode_bytes(content).alias("full"), cut.alias("cut"))
    if max_chars is None:
        return decoded.select("path", "length", F.col("full").alias("text"), F.col("cut").alias("truncated"))
    return decoded.select(
        "path", "length", F.substring("full", 1, max_chars).alias("text"),
        (F.col("cut") | (F.length("full") > max_chars)).alias("truncated"),
    )
