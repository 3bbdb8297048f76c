"""Mixed-format texts: regions by format, overlaps settled, gaps filled, sections of each.

Regions are half-open intervals of characters. Finding them needs match offsets, which Spark's
regular expressions do not give, so finders run in one Arrow pass; CSV islands, overlap removal
and gap filling exist as Columns and windows, too, for region tables from anywhere.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import detect
from docflow.functions.text import is_blank, strip
from docflow.operators.parsers import Section, kinds_line, parse_csv, parse_json, parse_plain, section_rows, words, with_summary

_TAGGED, _FENCED, _BRACES = re.compile(detect.TAGGED), re.compile(r"(?s)```(\w*)\n(.*?)\n```"), re.compile(detect.BRACES)
_DECLARED = re.compile(r"(?s)<\?xml.*?\?>.*?(?=\n\s*(?:<form|\{|\"|\w+:)|\n\s*$)")
_ELEMENT = re.compile(detect.SIMPLE_XML)
_TAG = re.compile(detect.TAG)


@dataclass
class Region:
    format: str
    start: int
    end: int
    content: str
    confidence: float
    language: str = ""
    code: str = ""


def xml_like(content: str) -> bool:
    low = content.lower()
    holds = lambda tags: any(f"<{t}>" in low for t in tags)
    marks = low.startswith("<?xml") or "xmlns:" in low or "/>" in low or holds(detect.MIXED_XML_TAGS)
    return marks and not holds(detect.HTML_TAGS) and not any(a in low for a in detect.HTML_ATTRIBUTES)


def json_loads(content: str) -> bool:
    try:
        json.loads(content)
    except (ValueError, RecursionError):
        return False
    return True


def csv_like(line: str) -> bool:
    return any(line.count(s) >= 2 for s in detect.SEPARATORS)


def find_html(text: str) -> list[Region]:
    out = []
    for m in _TAGGED.finditer(text):
        if not xml_like(m[0]):
            tags = len(_TAG.findall(m[0]))
            out.append(Region("html", m.start(), m.end(), m[0], min(0.2 * tags, 1.0) if tags > 2 else 0.3))
    return out


def find_xml(text: str) -> list[Region]:
    out = [Region("xml", m.start(), m.end(), m[0], 0.95) for m in _DECLARED.finditer(text)]
    for m in _ELEMENT.finditer(text):
        if len(m[0]) > 50 and xml_like(m[0]) and not any(r.start <= m.start() < r.end for r in out):
            out.append(Region("xml", m.start(), m.end(), m[0], 0.8))
    return out


def find_code(text: str) -> list[Region]:
    return [Region("code", m.start(), m.end(), m[0], 0.9, m[1] or "text", m[2]) for m in _FENCED.finditer(text)]


def find_json(text: str) -> list[Region]:
    out = []
    for m in _BRACES.finditer(text):
        whole = json_loads(m[0])
        hints = [bool(re.search(h, m[0])) for h in detect.JSON_HINTS]
        if whole or any(hints):
            score = 1.0 if whole else min(0.8, 0.3 + 0.2 * ('"' in m[0] and ":" in m[0]) + 0.2 * ("," in m[0]))
            out.append(Region("json", m.start(), m.end(), m[0], score))
    return out


def find_csv(text: str) -> list[Region]:
    """Islands of consecutive CSV-like lines of three or more; an end counts its line feed."""
    out, run, start, place = [], [], 0, 0
    for line in [*text.split("\n"), ""]:
        if line.strip() and csv_like(line):
            if not run:
                start = place
            run.append(line)
        elif run:
            if len(run) >= 3:
                out.append(Region("csv", start, start + sum(len(x) + 1 for x in run), "\n".join(run), min(0.1 * len(run), 1.0)))
            run = []
        place += len(line) + 1
    return out


#: In the order in which ties at one start are settled.
FINDERS = (find_xml, find_html, find_code, find_json, find_csv)


def settle(regions: list[Region]) -> list[Region]:
    """No overlaps: in order of start, the first kept region that overlaps decides; a more confident newcomer takes its place."""
    kept: list[Region] = []
    for region in sorted(regions, key=lambda r: r.start):
        other = next((k for k in kept if region.start < k.end and k.start < region.end), None)
        if other is None:
            kept.append(region)
        elif region.confidence > other.confidence:
            kept[kept.index(other)] = region
    return sorted(kept, key=lambda r: r.start)


def fill_gaps(text: str, regions: list[Region]) -> list[Region]:
    """Text regions between and around the others, stripped, none where blank."""
    out, place = [], 0
    for region in [*regions, Region("end", len(text), len(text), "", 0)]:
        between = text[place : region.start].strip()
        if between:
            out.append(Region("text", place, region.start, between, 1.0))
        if region.format != "end":
            out.append(region)
        place = max(place, region.end)
    return out


def regions_of(text: str) -> list[Region]:
    return fill_gaps(text, settle([r for find in FINDERS for r in find(text)]))


def _sections(region: Region) -> list[Section]:
    if region.format in ("html", "xml"):
        return [Section(f"{region.format}_block", region.content, {"char_count": len(region.content)})]
    if region.format == "code":
        return [Section("code_block", region.code, {"language": region.language, "char_count": len(region.code)})]
    return {"json": parse_json, "csv": parse_csv, "text": parse_plain}[region.format](region.content)


def parse_mixed(text: str, mime: str | None = None) -> list[Section]:
    """Sections of every region in order, with the region's format, confidence and interval."""
    if not text.strip():
        return [Section("empty", "Empty document")]
    text = text.replace("\r\n", "\n")
    regions, out = regions_of(text), []
    for r in regions:
        where = {"region_format": r.format, "confidence": r.confidence, "region_start": r.start, "region_end": r.end}
        try:
            out += [Section(s.kind, s.content, {**s.metadata, **where}) for s in _sections(r)]
        except Exception as error:  # noqa: BLE001  a region that cannot be parsed is kept as it is
            out.append(Section("unparsed_region", r.content, {**where, "error": str(error)[:200]}))
    counts = ", ".join(f"{n} {f}" for f, n in Counter(r.format for r in regions).items())
    return with_summary(out, [f"Mixed document with {len(regions)} regions: {counts}", f"Words: {words(text)}, Characters: {len(text)}", kinds_line(out)])


def parse(documents: DataFrame) -> DataFrame:
    """Sections of (document_id, raw_text, mime_type) texts of mixed format."""
    return section_rows(documents, parse_mixed)


def format_summary(sections: DataFrame) -> DataFrame:
    """Sections per document and region format; summaries count as unknown."""
    kind = F.coalesce(F.element_at("metadata", "region_format"), F.lit("unknown"))
    return sections.groupBy("document_id", kind.alias("region_format")).agg(F.count(F.lit(1)).alias("sections"))


# As Columns


def csv_islands(documents: DataFrame, text: str = "raw_text", least: int = 3) -> DataFrame:
    """CSV regions of (document_id, text): document_id, start, end, rows, confidence, content.

    Lines keep their running offset inside the row; islands are folded there, so nothing is
    shuffled and no window is needed.
    """
    lines = F.split(F.col(text), "\n", -1)
    zero = F.struct(F.lit(0).alias("place"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("run"), F.array().cast("array<struct<start:int,run:array<string>>>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        taken = ~is_blank(line) & detect.is_csv_like(line)
        begun = F.size(acc["run"]) > 0
        closed = F.when(begun, F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["run"].alias("run")))).otherwise(acc["done"])
        return F.struct(
            (acc["place"] + F.length(line) + 1).alias("place"),
            F.when(taken & ~begun, acc["place"]).otherwise(acc["start"]).alias("start"),
            F.when(taken, F.array_append(acc["run"], line)).otherwise(F.array().cast("array<string>")).alias("run"),
            F.when(taken, acc["done"]).otherwise(closed).alias("done"),
        )

    found = F.aggregate(F.array_append(lines, F.lit("")), zero, step, lambda acc: acc["done"])
    kept = F.filter(found, lambda r: F.size(r["run"]) >= least)
    rows = documents.select("document_id", F.explode(kept).alias("r"))
    content = F.array_join("r.run", "\n")
    count = F.size("r.run")
    return rows.select(
        "document_id",
        F.col("r.start").alias("start"),
        (F.col("r.start") + F.length(content) + 1).alias("end"),
        count.alias("rows"),
        F.least(count * F.lit(0.1), F.lit(1.0)).alias("confidence"),
        content.alias("content"),
    )


REGION = "struct<start:int,rank:int,seq:int,end:int,format:string,confidence:double,content:string>"


def settle_overlaps(regions: DataFrame) -> DataFrame:
    """`settle` on a region table: document_id, format, rank, seq, start, end, confidence, content.

    The rule depends on order, so a document's regions are folded in order of (start, rank, seq)
    inside one row after a grouping by document.
    """
    kinds = {"start": "int", "rank": "int", "seq": "int", "end": "int", "format": "string", "confidence": "double", "content": "string"}
    item = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    listed = regions.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept: Column, r: Column) -> Column:
        hit = F.filter(kept, lambda k: (r["start"] < k["end"]) & (k["start"] < r["end"]))
        other = F.get(hit, F.lit(0))
        swapped = F.transform(kept, lambda k: F.when(k == other, r).otherwise(k))
        return F.when(F.size(hit) == 0, F.array_append(kept, r)).when(r["confidence"] > other["confidence"], swapped).otherwise(kept)

    folded = F.array_sort(F.aggregate("items", F.array().cast(f"array<{REGION}>"), step))
    return listed.select("document_id", F.explode(folded).alias("r")).select("document_id", "r.format", "r.start", "r.end", "r.confidence", "r.content")


def text_gaps(documents: DataFrame, regions: DataFrame) -> DataFrame:
    """Text regions between settled ``regions`` of (document_id, raw_text): document_id, start, end, content."""
    marks = regions.select("document_id", "start", "end")
    edges = marks.unionByName(documents.select("document_id", F.length("raw_text").alias("start"), F.length("raw_text").alias("end")))
    order = Window.partitionBy("document_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = edges.withColumn("place", F.coalesce(F.max("end").over(order), F.lit(0))).filter("start > place")
    cut = strip(F.substring(F.col("raw_text"), F.col("place") + 1, F.col("start") - F.col("place")))
    found = gaps.select("document_id", "start", "place").join(documents.select("document_id", "raw_text"), "document_id").withColumn("content", cut)
    return found.filter("content <> ''").select("document_id", F.col("place").alias("start"), F.col("start").alias("end"), "content")
