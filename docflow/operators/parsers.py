"""Parsers from a whole text to sections: plain, CSV, JSON, HTML, Markdown.

A parser is a function text -> list of Section and never raises. `parse` runs the parser that a
row's MIME type names in one Arrow pass; what follows the parsers is Columns.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import line_count, not_blank, word_count
from docflow.operators.batches import map_tuples


@dataclass
class Section:
    kind: str
    content: str
    metadata: dict[str, object] = field(default_factory=dict)


Parser = Callable[[str], list[Section]]
EMPTY = "Empty document"


def words(text: str) -> int:
    return len(text.split())


def with_summary(sections: list[Section], lines: list[str]) -> list[Section]:
    """Put a summary first where there is more than one section."""
    return [Section("summary", "\n".join(lines), {"section_count": len(sections)}), *sections] if len(sections) > 1 else sections


def kinds_line(sections: list[Section]) -> str:
    return "Sections: " + ", ".join(f"{n} {kind}" for kind, n in Counter(s.kind for s in sections).items())


# Plain text

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_BULLET, _NUMBER = re.compile(r"^\s*[-*+•]\s+(.+)$"), re.compile(r"^\s*\d+[.)]\s+(.+)$")


def plain_summary(text: str, sections: list[Section]) -> list[str]:
    size = f"Words: {words(text)}, Characters: {len(text)}, Lines: {text.count(chr(10)) + 1}"
    return [f"Document contains {len(sections)} sections", size, kinds_line(sections)]


def parse_plain(text: str) -> list[Section]:
    """Paragraphs between blank lines, as plain text is observed to be read."""
    if not text.strip():
        return [Section("empty", EMPTY)]
    parts = [p.strip() for p in text.replace("\r\n", "\n").split("\n\n")]
    sections = [Section("paragraph", p, {"word_count": words(p), "char_count": len(p)}) for p in parts if p]
    return with_summary(sections, plain_summary(text, sections))


def structure_of(text: str) -> str:
    """What the structure test is meant to say: markdown_like, list_like or plain."""
    rows = [r for r in text.splitlines() if r.strip()]
    if any(_HEADING.match(r.strip()) for r in rows):
        return "markdown_like"
    listed = sum(bool(_BULLET.match(r) or _NUMBER.match(r)) for r in rows)
    return "list_like" if rows and listed > 0.3 * len(rows) else "plain"


def parse_structured(text: str) -> list[Section]:
    """Plain text by its intended structure: headers with content, or lists and content."""
    if not text.strip():
        return [Section("empty", EMPTY)]
    kind = structure_of(text)
    if kind == "plain":
        return parse_plain(text)
    sections = _headed(text) if kind == "markdown_like" else _listed(text)
    return with_summary(sections, plain_summary(text, sections))


def _headed(text: str) -> list[Section]:
    out: list[Section] = []
    header, held = None, []

    def close() -> None:
        if held:
            body = "\n".join(held)
            out.append(Section("content", body, {"header": header or "", "word_count": words(body)}))
            held.clear()

    for row in map(str.strip, text.splitlines()):
        if found := _HEADING.match(row):
            close()
            header = found[2]
            out.append(Section("header", header, {"level": len(found[1])}))
        elif row:
            held.append(row)
    close()
    return out


def _listed(text: str) -> list[Section]:
    out: list[Section] = []
    run, kind = [], None

    def close() -> None:
        if run:
            body = "\n".join(f"• {item}" for item in run)
            out.append(Section("list", body, {"list_type": kind, "item_count": len(run), "word_count": sum(map(words, run))}))
            run.clear()

    for row in text.splitlines():
        if not row.strip():
            continue
        found = next(((name, m[1]) for name, p in (("bullet", _BULLET), ("numbered", _NUMBER)) if (m := p.match(row))), None)
        if found is None or found[0] != kind:
            close()
            kind = found and found[0]
        if found:
            run.append(found[1].strip())
        else:
            out.append(Section("content", row.strip(), {"word_count": words(row)}))
    close()
    return out


# CSV


def dialect_of(text: str) -> type[csv.Dialect] | csv.Dialect:
    """Sniffed from the first 1024 characters among comma, semicolon, tab and bar; else Excel's."""
    try:
        return csv.Sniffer().sniff(text[:1024], delimiters=",;\t|")
    except csv.Error:
        return csv.excel


def parse_csv(text: str) -> list[Section]:
    """Header, a section for each data row and a summary; cells stay text."""
    try:
        rows = list(csv.reader(io.StringIO(text), dialect_of(text)))
    except csv.Error:
        return [Section("fallback", text[:500] + "..." if len(text) > 500 else text, {"parse_error": True})]
    if not rows:
        return [Section("empty", "Empty CSV file")]
    filled = [r for r in rows if any(c.strip() for c in r)]
    if not filled:
        return [Section("empty", "CSV contains no data")]
    header = [c.strip() for c in filled[0]]
    out = [Section("header", "CSV Headers: " + " | ".join(header), {"column_count": len(header)})]
    for k, row in enumerate(filled[1:]):
        cells = dict(zip(header, [*row, *[""] * len(header)], strict=False))
        shown = {name: cell.strip() for name, cell in cells.items() if cell.strip()}
        out.append(Section("data_row", " | ".join(f"{n}: {c}" for n, c in shown.items()), {"row_index": k, "column_count": len(shown)}))
    out.append(Section("summary", f"CSV Summary: {len(filled) - 1} data rows with {len(header)} columns", {"row_count": len(filled) - 1}))
    return out


# JSON


def flatten(value: object, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, leaf) in document order; empty containers have none. Deep values need no recursion."""
    stack = [(path, value)]
    while stack:
        where, item = stack.pop()
        if isinstance(item, dict):
            stack += [(f"{where}.{k}" if where else str(k), v) for k, v in reversed(item.items())]
        elif isinstance(item, list):
            stack += [(f"{where}[{k}]", item[k]) for k in range(len(item) - 1, -1, -1)]
        else:
            yield where, item


def json_stats(value: object) -> dict[str, int]:
    """total_keys, total_arrays, total_objects and max_depth; a leaf is a level."""
    out = {"total_keys": 0, "total_arrays": 0, "total_objects": 0, "max_depth": 0}
    stack = [(value, 0)]
    while stack:
        item, depth = stack.pop()
        out["max_depth"] = max(out["max_depth"], depth)
        if isinstance(item, dict):
            out["total_objects"] += 1
            out["total_keys"] += len(item)
            stack += [(v, depth + 1) for v in item.values()]
        elif isinstance(item, list):
            out["total_arrays"] += 1
            stack += [(v, depth + 1) for v in item]
    return out


def format_value(value: object) -> str:
    if isinstance(value, str):
        return f'"{value}"' if len(value) <= 100 else f'"{value[:97]}..."'
    if value is None:
        return "null"
    if isinstance(value, (dict, list)):
        return f"{type(value).__name__} ({len(value)} items)"
    return str(value)


def json_summary(value: object) -> str:
    if isinstance(value, dict):
        names = list(value)
        more = f", ... ({len(names) - 3} more)" if len(names) > 3 else ""
        return f"Object with {len(names)} keys ({', '.join(names[:3])}{more})"
    if isinstance(value, list):
        if not value:
            return "Empty array"
        found = sorted({type(v).__name__ for v in value})[:5]
        return f"Array with {len(value)} items (types: {', '.join(found)})"
    return f"Single {type(value).__name__} value"


def parse_json(text: str, group_indexes: bool = False) -> list[Section]:
    """A summary, then a section for each path. ``group_indexes`` puts the items of an array together."""
    if not text.strip():
        return [Section("empty", EMPTY)]
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as error:
        shown = text[:500] + "..." if len(text) > 500 else text
        return [Section("fallback", shown, {"invalid_json": True, "error_line": getattr(error, "lineno", 0)})]
    groups: dict[str, list[tuple[str, object]]] = {}
    for path, leaf in flatten(value):
        groups.setdefault(re.sub(r"\[\d+\]", "[*]", path) if group_indexes else path, []).append((path, leaf))
    out = [Section("summary", json_summary(value), json_stats(value))]
    for name, items in groups.items():
        shown = [f"{p}: {format_value(v)}" for p, v in items[:10]]
        if len(items) > 10:
            shown.append(f"... and {len(items) - 10} more items")
        out.append(Section("json_group", "\n".join(shown), {"group_name": name, "item_count": len(items), "sample_paths": ",".join(p for p, _ in items[:3])}))
    return out


# HTML

#: Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript meta link".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = frozenset(("p", "div", "section", "article", "blockquote"))
#: An opening element of the first column ends an open element of the second.
IMPLIED_ENDS = {
    "li": frozenset(("li",)),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "option": frozenset(("option",)),
}
ENDS_PARAGRAPH = frozenset("p div section article blockquote ul ol dl table h1 h2 h3 h4 h5 h6 pre form hr header footer nav main".split())
_SCOPES = {"li": frozenset(("ul", "ol")), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, between: str = "") -> str:
        """Stripped fragments in document order, blank ones dropped."""
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if fragment := item.strip():
                    out.append(fragment)
            else:
                stack += reversed(item.children)
        return between.join(out)


class TreeBuilder(HTMLParser):
    """A tree with implied end tags; dropped elements leave nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end("p", frozenset(CONTAINERS | {"td", "th", "li"} - {"p"}))
        for closed in IMPLIED_ENDS.get(tag, ()):
            self._end(closed, _SCOPES.get(tag, frozenset()))
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag))

    def handle_endtag(self, tag):
        self._end(tag, frozenset())

    def _end(self, tag: str, stop: frozenset[str]) -> None:
        """Close the innermost open ``tag`` that no element of ``stop`` hides."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in stop and self.open[k].tag != tag:
                return

    def handle_data(self, data):
        if self.open[-1].tag not in DROPPED:
            self.open[-1].children.append(data)


def html_tree(text: str) -> Node:
    builder = TreeBuilder()
    builder.feed(text)
    builder.close()
    return builder.root


def table_rows(table: Node) -> list[list[str]]:
    return [[c.text() for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")] for row in table.walk() if row.tag == "tr"]


def table_text(table: Node) -> str:
    """First row, a rule of 50 dashes, and the rows with content after it."""
    rows = table_rows(table)
    out = []
    if rows and any(rows[0]):
        out = [" | ".join(rows[0]), "-" * 50]
    return "\n".join(out + [" | ".join(r) for r in rows[1:] if any(r)])


def parse_html(text: str) -> list[Section]:
    """Sections by kind of element: title, headings, containers, lists, tables; else all text."""
    if not text.strip():
        return [Section("empty", EMPTY)]
    try:
        root = html_tree(text)
    except (AssertionError, ValueError, RecursionError):
        bare = re.sub(r"<[^>]+>", " ", text)[:1000].strip()
        return [Section("fallback", bare or "Failed to parse HTML content", {"parse_error": True})]
    nodes = list(root.walk())
    out: list[Section] = []
    title = next((n.text() for n in nodes if n.tag == "title"), "")
    if title:
        out.append(Section("title", title))
    for level, tag in enumerate(HEADINGS, 1):
        out += [Section("header", t, {"hierarchy_level": level}) for n in nodes if n.tag == tag and (t := n.text())]
    for n in nodes:
        if n.tag in CONTAINERS and len(t := n.text()) > 10:
            out.append(Section("content", t, {"tag": n.tag, "word_count": words(t)}))
    for n in nodes:
        if n.tag in ("ul", "ol"):
            items = [i for i in n.walk() if i.tag == "li"]
            if body := "\n".join(f"• {t}" for i in items if (t := i.text())):
                out.append(Section("list", body, {"item_count": len(items), "list_type": n.tag}))
    for n in nodes:
        if n.tag == "table" and (body := table_text(n)):
            out.append(Section("table", body, {"has_headers": any(c.tag == "th" for c in n.walk())}))
    if not out and (whole := root.text("\n")):
        out.append(Section("fallback", whole))
    return out or [Section("empty", EMPTY)]


# Markdown

_FENCE = "```"
_RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})$")
_ITEM = re.compile(r"^(?:[-*+]\s|\d+\.\s)")


def is_table_row(row: str) -> bool:
    return row.count("|") >= 2


def markdown_table(rows: list[str]) -> dict[str, object]:
    cells = [[c.strip() for c in r.split("|")[1:-1]] for r in rows]
    data = cells[2:]
    return {"table_rows": len(data), "table_columns": len(cells[0]), "headers": " | ".join(cells[0]), "table_data": "\n".join(map(" | ".join, data))}


def _markdown_section(rows: list[str], header: tuple[int, str] | None) -> Section | None:
    body = "\n".join(rows).strip()
    if not body:
        return None
    filled = [r for r in body.split("\n") if r.strip()]
    metadata: dict[str, object] = {"word_count": words(body), "char_count": len(body), "line_count": body.count("\n") + 1}
    if header:
        return Section(f"header_h{header[0]}", body, metadata | {"header_text": header[1], "header_level": header[0]})
    if len(filled) >= 2 and all(map(is_table_row, filled)):
        return Section("table", body, metadata | markdown_table(filled))
    if any(_ITEM.match(r.strip()) for r in filled):
        return Section("list", body, metadata)
    return Section("paragraph", body, metadata)


def parse_markdown(text: str) -> list[Section]:
    """A line at a time: fences, headers, table rows, rules, text.

    A header begins a section that holds its line; the header also names what follows a code
    block or a rule, until a table or the next header.
    """
    if not text.strip():
        return [Section("empty", EMPTY)]
    text = text.replace("\r\n", "\n")
    out: list[Section] = []
    held: list[str] = []
    header: tuple[int, str] | None = None
    code: list[str] | None = None

    def close() -> None:
        if section := _markdown_section(held, header):
            out.append(section)
        held.clear()

    for row in text.split("\n"):
        bare = row.strip()
        if code is not None:
            code.append(row)
            if bare.startswith(_FENCE):
                body = "\n".join(code)
                out.append(Section("code_block", body, {"language": code[0].strip()[3:].strip() or "text", "line_count": len(code), "char_count": len(body)}))
                code = None
        elif bare.startswith(_FENCE):
            close()
            code = [row]
        elif found := _HEADING.match(bare):
            close()
            header = (len(found[1]), found[2])
            held.append(row)
        elif is_table_row(row):
            if not any(map(is_table_row, held[-3:])):
                close()
                header = None
            held.append(row)
        elif _RULE.match(bare):
            close()
            out.append(Section("horizontal_rule", bare))
        else:
            held.append(row)
    if code is not None:
        held += code
    close()
    size = f"Words: {words(text)}, Characters: {len(text)}, Lines: {text.count(chr(10)) + 1}"
    levels = Counter(s.metadata["header_level"] for s in out if "header_level" in s.metadata)
    listed = ", ".join(f"{n} H{level}" for level, n in sorted(levels.items()))
    return with_summary(out, [f"Markdown document with {len(out)} sections", size, kinds_line(out), *([f"Headers: {listed}"] if listed else [])])


# Dispatch

_PARSERS: dict[str, Parser] = {}


def register_parser(mime: str, parser: Parser) -> None:
    """Add or replace the parser of a MIME type; it must be importable on executors."""
    _PARSERS[mime] = parser


for _mime, _parser in {"text/html": parse_html, "text/csv": parse_csv, "application/json": parse_json, "text/markdown": parse_markdown}.items():
    register_parser(_mime, _parser)


def parser_of(mime: str | None) -> Parser:
    """The type's parser; plain text for every other type, XML too."""
    return _PARSERS.get(mime or "", parse_plain)


def shown(metadata: dict[str, object]) -> list[tuple[str, str]]:
    return [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in metadata.items() if v is not None]


SCHEMA = "document_id string, section_idx int, section_type string, content string, metadata map<string,string>"
ARROW = pa.schema(
    [("document_id", pa.string()), ("section_idx", pa.int32()), ("section_type", pa.string()), ("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))]
)


def section_rows(documents: DataFrame, run: Callable[[str, str | None], list[Section]]) -> DataFrame:
    """Sections of (document_id, raw_text, mime_type) by ``run``; an error is a section, too."""

    def work(document_id: str, text: str | None, mime: str | None) -> list[tuple]:
        try:
            found = run(text or "", mime)
        except Exception as error:  # noqa: BLE001  one bad document must not fail the job
            found = [Section("error", f"{type(error).__name__}: {error}"[:500])]
        return [(document_id, k, s.kind, s.content, shown(s.metadata)) for k, s in enumerate(found)]

    return map_tuples(documents.select("document_id", "raw_text", "mime_type"), work, SCHEMA, ARROW)


def plain_sections(documents: DataFrame) -> DataFrame:
    """`parse_plain` of (document_id, raw_text) as Columns: no Python, no shuffle."""
    text = F.coalesce("raw_text", F.lit(""))
    parts = not_blank(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n", -1))
    shaped = documents.select("document_id", text.alias("_text"), parts.alias("_parts"))

    def section(kind: str, content: Column, *metadata: tuple[str, Column]) -> Column:
        pairs = [x for name, value in metadata for x in (F.lit(name), value.cast("string"))]
        return F.struct(F.lit(kind).alias("section_type"), content.alias("content"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))

    count, own = F.size("_parts"), F.col("_text")
    paragraphs = F.transform("_parts", lambda p: section("paragraph", p, ("word_count", word_count(p)), ("char_count", F.length(p))))
    size = F.concat(F.lit("Words: "), word_count(own), F.lit(", Characters: "), F.length(own), F.lit(", Lines: "), line_count(own))
    lines = F.concat(F.lit("Document contains "), count, F.lit(" sections\n"), size, F.lit("\nSections: "), count, F.lit(" paragraph"))
    summary = F.array(section("summary", lines, ("section_count", count)))
    found = F.when(count == 0, F.array(section("empty", F.lit(EMPTY)))).when(count > 1, F.concat(summary, paragraphs)).otherwise(paragraphs)
    rows = shaped.select("document_id", F.posexplode(found).alias("section_idx", "s"))
    return rows.select("document_id", "section_idx", "s.section_type", "s.content", "s.metadata")


def parse(documents: DataFrame) -> DataFrame:
    """Sections of documents by their MIME types, without a shuffle.

    Types with a parser go through one Python pass (HTML needs a tree, CSV a dialect, JSON the order
    of keys, which VARIANT does not keep, Markdown a state from line to line); all others are plain
    text, which is Columns. The test of the type is a filter that the scan can take.
    """
    marked = documents.select(F.col("document_id").cast("string").alias("document_id"), "raw_text", "mime_type")
    own = F.coalesce(F.col("mime_type").isin(*_PARSERS), F.lit(False))
    return section_rows(marked.filter(own), lambda text, mime: parser_of(mime)(text)).unionByName(plain_sections(marked.filter(~own)))


def summarise(sections: DataFrame) -> DataFrame:
    """Counts per document and section type, in the order of first appearance, as one row each."""
    counted = sections.filter("section_type <> 'summary'").groupBy("document_id", "section_type").agg(F.count(F.lit(1)).alias("n"), F.min("section_idx").alias("first"))
    listed = counted.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("first", "n", "section_type"))).alias("items"), F.sum("n").alias("sections"))
    line = F.array_join(F.transform("items", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["section_type"])), ", ")
    return listed.select("document_id", F.col("sections").cast("long").alias("sections"), F.concat(F.lit("Sections: "), line).alias("kinds"))
