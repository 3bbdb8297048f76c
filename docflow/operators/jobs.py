"""Batch processing: documents through routing and parsing to results, a summary and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import stable_id
from docflow.operators import layout, mixed, office, parsers
from docflow.operators.batches import map_tuples
from docflow.sources.ingest import SUPPORTED, ingest


class NoText(ValueError):
    """No engine could read a file."""


def _sections(route: str, mime: str | None, text: str | None, content: bytes | None, engines: list) -> list[parsers.Section]:
    """Sections of one document by its route; regions of office files and blocks of pages count as sections."""
    if route == "text_handler":
        return parsers.parser_of(mime)(text or "")
    if route == "mixed_handler":
        return mixed.parse_mixed(text or "")
    kind = SUPPORTED.get(mime or "", "")
    if reader := office.READERS.get(kind):
        return [
            parsers.Section(r.kind, r.text, {"page_number": b.page, "label": b.label, "title": b.title, "confidence": r.confidence} | b.metadata | r.metadata)
            for b in reader(content or b"")
            for r in b.regions
        ]
    if not kind:
        raise NoText(f"Unsupported binary format: {mime}")
    found, error = layout.engine_blocks(content or b"", engines)
    if not found:
        raise NoText(f"No engine could read the file ({error})")
    return [parsers.Section(label, body, {"page_number": page, "block_idx": k, "confidence": confidence, "method": name}) for page, k, label, _, body, confidence, name in found]


def process(inputs: DataFrame, engines: tuple[str, ...] | list[str] = layout.DEFAULT_ENGINES) -> tuple[DataFrame, DataFrame]:
    """(document rows, section rows) of inputs (source_name, raw_bytes, raw_text).

    One Arrow pass parses every row by its own route, so formats are detected once and nothing is
    shuffled. PDFs and images go to the ``engines`` in turn. Failed rows keep their error and
    have no sections but one that tells it.
    """
    documents, chosen = ingest(inputs), layout.chosen_engines(engines)

    def work(document_id: str, *row) -> list[tuple]:
        try:
            found = _sections(*row, chosen)
        except NoText as error:
            found = [parsers.Section("error", str(error)[:500])]
        except Exception as error:  # noqa: BLE001  one bad document must not fail the job
            found = [parsers.Section("error", f"{type(error).__name__}: {error}"[:500])]
        return [(document_id, k, s.kind, s.content, parsers.shown(s.metadata)) for k, s in enumerate(found)]

    sound = documents.filter(F.col("error").isNull()).filter("routing_target <> 'unknown_handler'").select("document_id", "routing_target", "mime_type", "raw_text", "raw_bytes")
    return documents, map_tuples(sound, work, parsers.SCHEMA, parsers.ARROW)


def results(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per document: status, error, format, route, number of sections."""
    counted = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"), F.max(F.when(F.col("section_type") == "error", F.col("content"))).alias("problem"))
    joined = documents.join(counted, "document_id", "left")
    no_route = F.when(F.col("routing_target") == "unknown_handler", F.lit("Unsupported format"))
    error = F.coalesce("error", "problem", no_route)
    return joined.select(
        F.col("source_name").alias("file_name"),
        F.when(error.isNull(), F.col("document_id")).otherwise("N/A").alias("document_id"),
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        "detected_format",
        "mime_type",
        "routing_target",
        F.when(error.isNull(), F.coalesce("sections", F.lit(0))).otherwise(0).alias("sections"),
        "language",
        "extraction_method",
        error.alias("error_message"),
    )


def summary(found: DataFrame) -> DataFrame:
    """One row for a job: totals, processed, failed, success rate and progress in percent."""
    good = F.count(F.when(F.col("status") == "success", 1))
    total = F.count(F.lit(1))
    return found.agg(
        total.alias("total_files"),
        good.alias("processed_files"),
        (total - good).alias("failed_files"),
        F.round(100.0 * good / F.greatest(total, F.lit(1)), 2).alias("success_rate"),
        F.when(total > 0, 100.0).otherwise(0.0).alias("progress"),
        F.when(total > 0, "completed").otherwise("pending").alias("status"),
    )


def job_id(found: DataFrame) -> Column:
    return stable_id(F.lit("job"), F.col("file_name"))


def batch(inputs: DataFrame, output: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of a batch; with ``output`` they are also written as JSON there."""
    documents, sections = process(inputs)
    found = results(documents, sections)
    if output:
        found.write.mode("overwrite").json(f"{output}/results")
        found = found.sparkSession.read.schema(found.schema).json(f"{output}/results")
        summary(found).coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    return found, summary(found)


def table_view(found: DataFrame) -> DataFrame:
    """The results as a table shows them: ids by their first eight characters."""
    return found.select("file_name", F.substring("document_id", 1, 8).alias("document"), "status", "detected_format", "sections", "error_message")


def search_sections(sections: DataFrame, query: str, most: int = 10, least: int = 5) -> DataFrame:
    """Each document's first ``most`` sections whose content holds the query in any case, in order.

    Documents of ``least`` sections or fewer are not searched but shown whole.
    """
    every = Window.partitionBy("document_id")
    held = F.contains(F.lower("content"), F.lit(query.lower()))
    counted = sections.withColumn("_few", F.count(F.lit(1)).over(every) <= least).filter(F.col("_few") | held)
    return counted.withColumn("_n", F.row_number().over(every.orderBy("section_idx"))).filter(F.col("_few") | (F.col("_n") <= most)).drop("_few", "_n")


def document_json(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_id, json): each document with its sections as one JSON text."""
    item = F.struct("section_idx", "section_type", "content", "metadata")
    listed = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", F.to_json(item).alias("j")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["j"]), ",")
    head = F.to_json(F.struct("document_id", "source_name", "detected_format", "mime_type", "encoding", "language", "extraction_method", "routing_target", "file_size"))
    joined = documents.join(listed.select("document_id", body.alias("body")), "document_id", "left")
    return joined.select("document_id", F.concat(F.lit('{"document":'), head, F.lit(',"sections":['), F.coalesce("body", F.lit("")), F.lit("]}")).alias("json"))


def block_counts(blocks: DataFrame) -> DataFrame:
    """(document_id, pages, blocks, regions) of blocks (document_id, page_number, block_idx, ...), a row for each region."""
    return blocks.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages"), F.count_distinct("page_number", "block_idx").alias("blocks"), F.count(F.lit(1)).alias("regions"))


def text_export(sections: DataFrame) -> DataFrame:
    """(document_id, text): sections under lines that name their type, between blank lines."""
    part = F.concat(F.lit("=== "), F.upper("section_type"), F.lit(" SECTION ===\n"), F.col("content"))
    listed = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", part.alias("p")))).alias("items"))
    return listed.select("document_id", F.array_join(F.transform("items", lambda x: x["p"]), "\n\n").alias("text"))


def page_export(blocks: DataFrame) -> DataFrame:
    """(document_id, text): pages and their blocks, each under its label and title."""
    line = F.concat(F.lit("["), F.upper("label"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("raw_text", F.lit("")))
    pages = blocks.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("p")))).alias("items"))
    page = F.concat(F.lit("=== PAGE "), F.col("page_number").cast("string"), F.lit(" ===\n"), F.array_join(F.transform("items", lambda x: x["p"]), "\n"))
    listed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", page.alias("p")))).alias("items"))
    return listed.select("document_id", F.array_join(F.transform("items", lambda x: x["p"]), "\n\n").alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One text file set, partitioned by nothing: lines of all documents' exports."""
    texts.select("text").write.mode("overwrite").text(path)
