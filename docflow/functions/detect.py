"""Format predicates on text, as Columns that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import not_blank, strip

#: Patterns and names that tell formats apart.
FENCE = r"(?s)```\w*\n.*?\n```"
BRACES = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
TAGGED = r"(?s)<[^>]+>.*?</[^>]+>"
TAG, ANY_TAG = r"<[^>]+>", r"<[^>]*>"
DECLARATION = r"(?is)<\?xml.*?\?>"
PLAIN_ELEMENT = r"<[a-zA-Z_][a-zA-Z0-9_]*>[^<]*</[a-zA-Z_][a-zA-Z0-9_]*>"
SIMPLE_XML = r"(?s)<([a-zA-Z_][a-zA-Z0-9_-]*)\b[^>]*>.*?</\1>"
QUOTED_BRACES = r'\{[^{}]*"[^"]*"[^{}]*\}'
JSON_HINTS = (r'"[^"]+"\s*:', r"\[\s*\{", r"\}\s*,\s*\{")
XML_TAGS = ("database", "configuration", "connection", "host", "port", "name")
MIXED_XML_TAGS = ("configuration", "database", "connection", "pool_size", "timeout", "cache", "type", "host", "port")
HTML_TAGS = ("div", "span", "p", "h1", "h2", "h3", "form", "input", "button", "table")
HTML_ATTRIBUTES = ("class=", "id=", "onclick=")
SEPARATORS = (",", "\t", "|", ";")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_csv_like(line: Column) -> Column:
    """Some separator stands twice or more."""
    return any_of([F.length(line) - F.length(F.replace(line, F.lit(s), F.lit(""))) >= 2 for s in SEPARATORS])


def is_pure_json(text: Column) -> Column:
    """The whole text is one JSON value, a scalar too."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, ANY_TAG, "")


def is_pure_html(text: Column) -> Column:
    low = F.lower(strip(text))
    page = low.startswith("<!doctype html") | low.startswith("<html") | (low.contains("<head>") & low.contains("<body>"))
    tagged = F.length(strip(without_tags(text))) < F.length(strip(text)) * 0.2
    return F.when(page, True).when(low.contains("<?xml"), False).when(text.rlike(QUOTED_BRACES), False).otherwise(tagged & text.rlike(TAG))


def _filled_lines(text: Column) -> Column:
    return not_blank(F.split(text, "\n", -1))


def csv_share(text: Column) -> Column:
    """Share of the non-blank lines that are CSV-like."""
    filled = _filled_lines(text)
    return F.size(F.filter(filled, is_csv_like)) / F.greatest(F.size(filled), F.lit(1))


def is_pure_csv(text: Column) -> Column:
    return (F.size(_filled_lines(text)) >= 2) & (csv_share(text) >= 0.8)


def is_likely_json(text: Column) -> Column:
    return any_of([text.rlike(h) for h in JSON_HINTS]) | is_pure_json(text)


def is_xml_like(content: Column, tags: tuple[str, ...] = XML_TAGS) -> Column:
    """XML marks (declaration, namespace, closed or known bare tags) and none of HTML's."""
    low = F.lower(content)
    marks = [low.startswith("<?xml"), low.contains("xmlns:"), low.contains("/>"), *[low.contains(f"<{t}>") for t in tags]]
    html = [*[low.contains(f"<{t}>") for t in HTML_TAGS], *[low.contains(a) for a in HTML_ATTRIBUTES]]
    return any_of(marks) & ~any_of(html)


def mixed_indicators(text: Column) -> dict[str, Column]:
    """Which formats a text seems to hold parts of."""
    size = F.length(strip(text))
    braces = F.aggregate(F.regexp_extract_all(text, F.lit(BRACES), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m))
    tagged = F.regexp_extract_all(text, F.lit(TAGGED), F.lit(0))
    xml = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (DECLARATION, PLAIN_ELEMENT)]
    filled = _filled_lines(text)
    rows = F.size(F.filter(filled, is_csv_like))
    return {
        "code": text.rlike(FENCE),
        "json": (braces > 0) & (braces < size * 0.8),
        "html": F.exists(tagged, lambda m: ~is_xml_like(m)) & (F.length(strip(without_tags(text))) > F.length(text) * 0.3),
        "csv": (rows >= 3) & (rows < F.size(filled) * 0.8),
        "xml": any_of([F.exists(found, lambda m: is_xml_like(m)) for found in xml]),
    }


def is_mixed(text: Column) -> Column:
    """Two or more formats in a text that is not purely one; cheap tests come first.

    Without a fence, a brace or a tag only the CSV indicator could hold, so prose is done at once.
    """
    marked = text.contains("```") | text.contains("{") | text.contains("<")
    count = reduce(lambda a, b: a + b, [c.cast("int") for c in mixed_indicators(text).values()])
    return (
        F.when(text.isNull() | (F.length(text) < 100) | ~marked, False)
        .when(is_pure_json(text) | is_pure_html(text) | is_pure_csv(text), False)
        .otherwise(count >= 2)
    )


def is_printable(text: Column) -> Column:
    """No control, format, unassigned or line-separating character, and no space but the ASCII one."""
    return ~text.rlike(r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}")


def language(text: Column) -> Column:
    """The placeholder rule: null under ten characters, else en."""
    return F.when(F.length(strip(text)) < 10, F.lit(None).cast("string")).when(text.isNotNull(), F.lit("en"))
