"""Text semantics as Columns: white space, lines, words, previews and deterministic ids.

Spark's trim strips spaces only and Java's ``\\s`` is ASCII unless ``(?U)`` says otherwise, so the
rules for white space are stated once, here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, with the ASCII separators 1C to 1F: as a class, and each character.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Ends of lines besides the carriage returns that `lines` turns into line feeds.
LINE_BREAK = r"[\n\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Without white space at either end; looks at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def unix_lines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(text: Column) -> Column:
    """Array of lines; a break at the very end begins no further line."""
    parts = F.split(unix_lines(text), LINE_BREAK, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def not_blank(parts: Column) -> Column:
    """Stripped parts of an array, blank ones dropped."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def preview(text: Column, size: int, tail: str = "...") -> Column:
    """The text, or its first ``size`` characters and ``tail`` if it is longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(tail))).otherwise(text)


def stable_id(*parts: Column) -> Column:
    """An id that reruns and retries agree on."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def title_case(text: Column) -> Column:
    return F.initcap(text)
