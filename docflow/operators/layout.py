"""Page layout: boxes, reading order, labels, model output, and Markdown as pages and blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import is_blank, strip
from docflow.operators import pdf
from docflow.operators.batches import map_tuples

#: Labels of a layout model and what they are called here.
LABELS = {
    "plain text": "body",
    "figure_caption": "caption",
    "table_caption": "caption",
    "table_footnote": "footer",
    "isolate_formula": "formula",
    "formula_caption": "caption",
}
#: The page that stands in where detection fails, and the least confidence kept.
FULL_PAGE, LEAST_CONFIDENCE = (0, 0, 1240, 1754), 0.2


def normal_label(label: Column) -> Column:
    """The label that LABELS gives; others stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.element_at(table, label), label)


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """The box inside the image."""
    inside = lambda x, most: F.greatest(F.lit(0), F.least(x, most)).cast("int")
    return F.array(inside(box[0], width), inside(box[1], height), inside(box[2], width), inside(box[3], height))


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """From a grid of 1000, or of 224 where no value is over that, to pixels, cut to whole ones."""
    grid = F.when(F.array_max(box) > 224, 1000).otherwise(224)
    scaled = [(box[k].cast("double") * side / grid).cast("int") for k, side in enumerate((width, height, width, height))]
    return F.array(*scaled)


BLOCK = "array<struct<label:string,bbox:array<double>>>"


def model_blocks(output: Column) -> Column:
    """Blocks in a model's text: a JSON list, else the widest bracketed part; label and four numbers each."""
    whole = F.from_json(output, BLOCK)
    part = F.from_json(F.regexp_extract(output, r"(?s)\[.*\]", 0), BLOCK)
    valid = lambda b: b["label"].isNotNull() & (F.size(b["bbox"]) == 4) & ~F.exists(b["bbox"], lambda x: x.isNull())
    return F.filter(F.coalesce(whole, part, F.array().cast(BLOCK)), valid)


def detected_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks over the least confidence that are not to be left out; pages without one get a full page.

    blocks: document_id, page_number, label, bbox, confidence; pages: document_id, page_number.
    """
    kept = blocks.filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.lower("label") != "abandon"))
    joined = pages.select("document_id", "page_number").join(kept.select("document_id", "page_number", "label", "bbox", "confidence"), ["document_id", "page_number"], "left")
    return joined.select(
        "document_id",
        "page_number",
        F.coalesce(normal_label(F.col("label")), F.lit("full_page")).alias("label"),
        F.coalesce("bbox", F.array(*map(F.lit, FULL_PAGE))).alias("bbox"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def reading_order(blocks: DataFrame, gap: float = 0.08) -> DataFrame:
    """``blocks`` (document_id, page_number, bbox, page_width, ...) with col and order, 0-based.

    Columns begin where the sorted x-centres leave a gap over ``gap`` of the width. A block
    belongs to the column whose stretch between midpoints of neighbouring starts holds its
    centre; in a column, blocks go from top to bottom. One shuffle by page serves all windows.
    """
    page = Window.partitionBy("document_id", "page_number")
    centre = (F.col("bbox")[0] + F.col("bbox")[2]) / 2.0
    before = F.lag("_x").over(page.orderBy("_x"))
    starts = blocks.withColumn("_x", centre).withColumn("_start", before.isNull() | (F.col("_x") - before > F.col("page_width") * gap))
    listed = starts.withColumn("_starts", F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("_start"), F.col("_x"))).over(page))))
    middles = F.transform(F.sequence(F.lit(1), F.size("_starts")), lambda k: F.when(k < F.size("_starts"), (F.get("_starts", k - 1) + F.get("_starts", k)) / 2.0))
    col = F.size(F.filter(middles, lambda m: m.isNotNull() & (F.col("_x") > m)))
    placed = listed.withColumn("col", col)
    order = F.row_number().over(page.orderBy("col", F.col("bbox")[1], F.col("bbox")[0])) - 1
    return placed.withColumn("order", order).drop("_x", "_start", "_starts")


def span_columns(spans: DataFrame, gap: float = 0.15) -> DataFrame:
    """``spans`` (document_id, page_number, x0, page_width) with col: a gap in x0 over ``gap`` of the width begins one."""
    order = Window.partitionBy("document_id", "page_number").orderBy("x0")
    new = F.coalesce((F.col("x0") - F.lag("x0").over(order) > F.col("page_width") * gap).cast("int"), F.lit(0))
    return spans.withColumn("_new", new).withColumn("col", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def strip_html(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " "))


# Markdown as pages


def markdown_pages(documents: DataFrame, text: str = "raw_text") -> DataFrame:
    """Logical pages: cut before each # and ## heading; a blank text is one empty page."""
    parts = F.split(F.concat(F.lit("\n"), strip(F.col(text))), r"\n(?=#{1,2} )", -1)
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    pages = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))
    return documents.select("document_id", F.posexplode(pages).alias("_k", "text")).select("document_id", (F.col("_k") + 1).alias("page_number"), "text")


_SUB, _TOP, _TABLE = re.compile(r"(?m)^(#{3,6})\s+(.+)$"), re.compile(r"^(#{1,2})\s+(.+)$"), re.compile(r"\|[-: ]+\|")


def blocks_of_page(text: str) -> list[tuple[str, str, str]]:
    """(label, title, text) of a page: its heading as title or heading, then parts between subheadings."""
    text = text.strip()
    if not text:
        return []
    first, _, rest = text.partition("\n")
    out = []
    if found := _TOP.match(first):
        out.append(("title" if len(found[1]) == 1 else "heading", found[2].strip(), found[2].strip()))
        text = rest.strip()
    marks = [*_SUB.finditer(text)]
    cuts = [("", 0, marks[0].start() if marks else len(text))]
    cuts += [(m[2].strip(), m.end(), (marks[k + 1].start() if k + 1 < len(marks) else len(text))) for k, m in enumerate(marks)]
    for k, (title, a, b) in enumerate(cuts):
        body, last = text[a:b].strip(), k == len(cuts) - 1
        if body or (title and last):
            out.append(("table" if last and _TABLE.search(body) else "heading" if title and not body else "body", title, body or title))
    return out or [("body", "", text)]


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of (document_id, page_number, text): block_idx, label, title, raw_text, confidence 1.0."""
    fields = [("document_id", pa.string()), ("page_number", pa.int32()), ("block_idx", pa.int32()), ("label", pa.string()), ("title", pa.string()), ("raw_text", pa.string()), ("confidence", pa.float64())]
    out = pa.schema(fields)

    def work(document_id: str, page: int, text: str | None) -> Iterator[tuple]:
        return ((document_id, page, k, *block, 1.0) for k, block in enumerate(blocks_of_page(text or "")))

    schema = "document_id string, page_number int, block_idx int, label string, title string, raw_text string, confidence double"
    return map_tuples(pages.select(F.col("document_id").cast("string"), F.col("page_number").cast("int"), "text"), work, schema, out)


# Engines from outside

#: name -> engine: bytes of a file or image to pages of blocks (label, bbox, text, confidence).
Engine = Callable[[bytes], list[list[dict]]]
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, engine: Engine) -> None:
    """Add an OCR or layout engine; it is imported and run on executors, once per worker."""
    _ENGINES[name] = engine


register_engine("pdf_text", pdf.engine)

#: Engines that a batch tries in turn unless it is told others.
DEFAULT_ENGINES = ("pdf_text",)


def chosen_engines(names: tuple[str, ...] | list[str]) -> list[tuple[str, Engine]]:
    """The registered ones of the names, in order; they travel with the task."""
    return [(name, _ENGINES[name]) for name in names if name in _ENGINES]


def engine_blocks(data: bytes, chosen: list[tuple[str, Engine]]) -> tuple[list[tuple], str]:
    """(page_number, block_idx, label, bbox, text, confidence, method) of the first engine that gives blocks, and why none did."""
    errors = []
    for name, engine in chosen:
        try:
            pages = engine(data)
        except Exception as problem:  # noqa: BLE001  the next engine gets its turn
            errors.append(f"{name}: {problem}"[:300])
            continue
        found = [(p, k, b.get("label", "body"), list(b.get("bbox", FULL_PAGE)), b.get("text", ""), float(b.get("confidence", 1.0)), name) for p, page in enumerate(pages, 1) for k, b in enumerate(page)]
        if found:
            return found, ""
        errors.append(f"{name}: no blocks")
    return [], "; ".join(errors) or "no engine is registered"


def recognise(documents: DataFrame, engines: tuple[str, ...] | list[str] = DEFAULT_ENGINES) -> DataFrame:
    """Blocks of (document_id, raw_bytes) by the first engine that gives any; never raises.

    Where all fail, a document has one full_page block with confidence 0 and the errors.
    """
    chosen = chosen_engines(engines)
    fields = [("document_id", pa.string()), ("page_number", pa.int32()), ("block_idx", pa.int32()), ("label", pa.string()), ("bbox", pa.list_(pa.int32())), ("raw_text", pa.string()), ("confidence", pa.float64()), ("method", pa.string()), ("error", pa.string())]

    def work(document_id: str, data: bytes | None) -> list[tuple]:
        found, error = engine_blocks(data or b"", chosen)
        return [(document_id, *b, None) for b in found] or [(document_id, 1, 0, "full_page", list(FULL_PAGE), "", 0.0, "none", error)]

    schema = "document_id string, page_number int, block_idx int, label string, bbox array<int>, raw_text string, confidence double, method string, error string"
    return map_tuples(documents.select("document_id", "raw_bytes"), work, schema, pa.schema(fields))


def zip_pages(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """Pages with the layouts at the same place: the n-th page of a document with its n-th layout.

    ``pages`` and ``layouts``: document_id, page_number, ...; what only one side has is left out. The
    page's own number stays, the layout's goes.
    """
    nth = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")))
    return nth(pages).join(nth(layouts).drop("page_number"), ["document_id", "_nth"]).drop("_nth")


def crops(pages: DataFrame) -> DataFrame:
    """What an engine is to read: each page's ``blocks`` as rows, their boxes inside the page.

    ``pages``: document_id, page_number, width, height, blocks array<struct<label, bbox, confidence>>.
    Boxes without an area give no row; a page without blocks is read whole.
    """
    whole = F.array(F.struct(F.lit("full_page").alias("label"), F.array(F.lit(0), F.lit(0), F.col("width"), F.col("height")).cast("array<int>").alias("bbox"), F.lit(0.0).alias("confidence")))
    blocks = F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(whole)
    rows = pages.select("document_id", "page_number", "width", "height", F.posexplode(blocks).alias("block_idx", "b"))
    placed = rows.select("document_id", "page_number", "block_idx", F.col("b.label").alias("label"), clamp_box(F.col("b.bbox"), F.col("width"), F.col("height")).alias("bbox"), F.col("b.confidence").alias("confidence"))
    return placed.filter((F.col("bbox")[2] > F.col("bbox")[0]) & (F.col("bbox")[3] > F.col("bbox")[1]))


def search_blocks(blocks: DataFrame, query: str) -> DataFrame:
    """Blocks whose text or title holds the query, in any case."""
    held = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return blocks.filter(held(F.col("raw_text")) | held(F.col("title")))


def has_text(blocks: DataFrame, least: int = 150) -> DataFrame:
    """Whether each document's blocks hold over ``least`` stripped characters."""
    size = F.sum(F.when(~is_blank(F.coalesce("raw_text", F.lit(""))), F.length(strip(F.col("raw_text")))).otherwise(0))
    return blocks.groupBy("document_id").agg((size > least).alias("has_text"))
