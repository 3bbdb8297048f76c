"""Chunkers over document rows; native array expressions, so chunking needs no shuffle.

A document row carries ``segments array<struct<text string, metadata map<string,string>>>`` in
reading order. A chunker turns each segment into pieces inside the row, and the place of a piece
in the document's array is its chunk_index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import is_blank, lines, not_blank, stable_id, strip, unix_lines

#: Fixed value: what begins a section, at the start of a line.
HEADER = (
    r"(?:#{1,6}\s+\S.*"
    r"|\d+[.)]\s+[A-Z]\S*.*"
    r"|(?:Chapter|Section|Part|Appendix)\s+\S.*"
    r"|[A-Z][A-Z ]{3,60}$)$"
)
#: Lines end at LF only ((?d)), and white space is Unicode's ((?U)).
HEADER_LINE = rf"(?mdU)^{HEADER}"
#: Stands before a header; texts that hold it are escaped with the second character.
_MARK, _ESCAPE = "\u0001", "\u0002"

PIECE = "array<struct<text:string,metadata:map<string,string>>>"
_METHODS: dict[str, Callable[[Column], Column]] = {}


def register_method(name: str, pieces: Callable[[Column], Column]) -> None:
    """Add a chunk method: a function from one segment (text, metadata) to an array of pieces."""
    _METHODS[name] = pieces


def methods() -> list[str]:
    return sorted(_METHODS)


def _with(segment: Column, texts: Column, *more: Column) -> Column:
    extra = F.create_map(*more) if more else None
    metadata = F.map_concat(segment["metadata"], extra) if more else segment["metadata"]
    return F.transform(texts, lambda t: F.struct(t.alias("text"), metadata.alias("metadata")))


def sentences(text: Column) -> Column:
    """Sentences of each line: broken after . ! or ? before white space or the line's end."""
    per_line = F.transform(lines(strip(unix_lines(text))), lambda x: F.split(strip(x), r"(?U)(?<=[.!?])(?:\s+|$)", -1))
    return not_blank(F.flatten(per_line))


def paragraphs(text: Column) -> Column:
    """Runs of text between blank lines; a line of spaces is not blank."""
    return not_blank(F.split(unix_lines(text), r"\n{2,}", -1))


def header_parts(text: Column) -> Column:
    """The text cut before each section header; one part if there is none."""
    plain = unix_lines(text)
    marked = plain.contains(_MARK) | plain.contains(_ESCAPE)
    safe = F.replace(F.replace(plain, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}b")), F.lit(_MARK), F.lit(f"{_ESCAPE}a"))
    cut = lambda t: F.split(F.regexp_replace(t, HEADER_LINE, f"{_MARK}$0"), _MARK, -1)
    back = lambda p: F.replace(F.replace(p, F.lit(f"{_ESCAPE}a"), F.lit(_MARK)), F.lit(f"{_ESCAPE}b"), F.lit(_ESCAPE))
    return F.when(marked, F.transform(cut(safe), back)).otherwise(cut(plain))


def _line_pieces(segment: Column) -> Column:
    return _with(segment, sentences(segment["text"]))


def _paragraph_pieces(segment: Column) -> Column:
    return _with(segment, paragraphs(segment["text"]))


def _section_pieces(segment: Column) -> Column:
    parts = header_parts(segment["text"])
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(
            strip(p).alias("text"),
            F.map_concat(segment["metadata"], F.create_map(F.lit("section_detected"), (i > 0).cast("string"), F.lit("section_number"), i.cast("string"))).alias("metadata"),
        ),
    )
    plain = _with(segment, paragraphs(segment["text"]), F.lit("section_detected"), F.lit("false"))
    return F.when(F.size(parts) > 1, F.filter(numbered, lambda p: p["text"] != "")).otherwise(plain)


register_method("line", _line_pieces)
register_method("paragraph", _paragraph_pieces)
register_method("section", _section_pieces)


def segments_of_text(text: Column) -> Column:
    """One segment of a raw text, none if it is null or blank."""
    one = F.array(F.struct(text.alias("text"), F.create_map().cast("map<string,string>").alias("metadata")))
    return F.when(text.isNull() | is_blank(text), F.array().cast(PIECE)).otherwise(one)


def segments_of_sections(sections: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(document_id, section_idx, section_type, content, metadata) -> (document_id, segments).

    Summaries and blank sections are left out. Documents whose sections leave nothing fall back
    to ``raw`` (document_id, raw_text) if it is given.
    """
    kept = sections.filter((F.col("section_type") != "summary") & ~is_blank(F.col("content")))
    metadata = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("section_type"), F.col("section_type")))
    item = F.struct("section_idx", strip(F.col("content")).alias("text"), metadata.alias("metadata"))
    grouped = _ordered(kept, item)
    if raw is None:
        return grouped
    joined = raw.join(grouped, "document_id", "left")
    return joined.select("document_id", F.coalesce("segments", segments_of_text(F.col("raw_text"))).alias("segments"))


def _ordered(kept: DataFrame, item: Column) -> DataFrame:
    compare = lambda a, b: F.when(a["section_idx"] < b["section_idx"], -1).when(a["section_idx"] > b["section_idx"], 1).otherwise(0)
    listed = kept.groupBy("document_id").agg(F.collect_list(item).alias("items"))
    ordered = F.array_sort("items", compare)
    return listed.select("document_id", F.transform(ordered, lambda x: F.struct(x["text"], x["metadata"])).alias("segments"))


def segments_of_blocks(blocks: DataFrame) -> DataFrame:
    """(document_id, page_number, block_idx, block_id, label, title, corrected_text, raw_text, confidence) -> segments.

    A block's text is its corrected text, else its raw text; blank blocks are left out.
    """
    text = strip(F.coalesce(F.when(F.col("corrected_text") != "", F.col("corrected_text")), F.col("raw_text"), F.lit("")))
    meta = F.create_map(*[x for c in ("page_number", "block_id", "label", "title", "confidence") for x in (F.lit(c), F.col(c).cast("string"))])
    item = F.struct(F.struct("page_number", "block_idx").alias("section_idx"), text.alias("text"), meta.alias("metadata"))
    return _ordered(blocks.filter(text != ""), item)


def full_text(segments: Column) -> Column:
    """Segments of a text joined by blank lines into one, with the metadata of the first."""
    whole = F.array_join(F.transform(segments, lambda s: s["text"]), "\n\n")
    one = F.array(F.struct(whole.alias("text"), segments[0]["metadata"].alias("metadata")))
    return F.when(F.size(segments) > 0, one).otherwise(F.array().cast(PIECE))


def chunk(documents: DataFrame, method: str = "paragraph", join_segments: bool = True) -> DataFrame:
    """(document_id, segments) -> one row per chunk.

    document_id, chunk_index (0-based in the document), chunk_id, method, text, metadata,
    similarity_score. With ``join_segments`` a document's segments are joined before they are
    cut, as for text documents; pages and blocks are cut one by one. Documents without segments
    give no chunk; an unknown method is an error.
    """
    if method not in _METHODS:
        raise ValueError(f"unknown chunk method {method!r}; there are {methods()}")
    segments = full_text(F.col("segments")) if join_segments else F.col("segments")
    pieces = F.flatten(F.transform(segments, _METHODS[method]))
    rows = documents.select("document_id", F.posexplode(pieces).alias("chunk_index", "piece"))
    return rows.select(
        "document_id",
        "chunk_index",
        stable_id(F.col("document_id"), F.lit(method), F.col("chunk_index")).alias("chunk_id"),
        F.lit(method).alias("method"),
        F.col("piece.text").alias("text"),
        F.col("piece.metadata").alias("metadata"),
        F.lit(0.0).alias("similarity_score"),
    )


def segments(raw: DataFrame, sections: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(document_id, segments, paged) of documents (document_id, raw_text): from blocks where a
    document has any, else from its sections, else from its raw text.

    ``paged`` says that the segments are blocks, which are cut one by one.
    """
    found = raw.select("document_id", segments_of_text(F.col("raw_text")).alias("_raw"))
    for name, rows in (("_sections", None if sections is None else segments_of_sections(sections)), ("_blocks", None if blocks is None else segments_of_blocks(blocks))):
        found = found.withColumn(name, F.lit(None).cast(PIECE)) if rows is None else found.join(rows.withColumnRenamed("segments", name), "document_id", "left")
    return found.select("document_id", F.coalesce("_blocks", "_sections", "_raw").alias("segments"), F.col("_blocks").isNotNull().alias("paged"))


def chunk_documents(raw: DataFrame, method: str = "paragraph", sections: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """`chunk` of whatever a document has: blocks one by one, sections or raw text as one."""
    found = segments(raw, sections, blocks)
    return chunk(found.filter("paged"), method, join_segments=False).unionByName(chunk(found.filter("NOT paged"), method))


def page_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk a page: its blocks' texts from top to bottom, then left to right.

    blocks: document_id, page_number, bbox array<int> (x0, y0, x1, y1), text.
    """
    item = F.struct(F.col("bbox")[1].alias("y0"), F.col("bbox")[0].alias("x0"), F.col("text").alias("text"))
    listed = blocks.filter(~is_blank(F.coalesce("text", F.lit("")))).groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("document_id", "page_number", F.array_join(F.transform("items", lambda x: x["text"]), "\n\n").alias("text"))


def groups_payload(groups: DataFrame) -> DataFrame:
    """(document_id, payload): a document's topic groups as one JSON text, in order of the topic.

    ``groups``: document_id, topic_id, topic_label, topic_words, merged_text, chunks, coherence_score.
    """
    item = F.struct("topic_id", "topic_label", "topic_words", F.col("merged_text").alias("text"), F.col("chunks").alias("source_chunks"), "coherence_score")
    listed = groups.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("topic_id", F.to_json(item).alias("j")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["j"]), ",")
    return listed.select("document_id", F.concat(F.lit('{"groups":['), body, F.lit('],"total_groups":'), F.size("items"), F.lit("}")).alias("payload"))


def payload(chunks: DataFrame) -> DataFrame:
    """(document_id, payload): the document's chunks as one JSON text, in order."""
    item = F.struct("chunk_index", "chunk_id", "method", "text", "metadata")
    listed = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.to_json(item).alias("j")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["j"]), ",")
    return listed.select("document_id", F.concat(F.lit('{"chunks":['), body, F.lit("],"), F.lit('"total_chunks":'), F.size("items"), F.lit("}")).alias("payload"))
