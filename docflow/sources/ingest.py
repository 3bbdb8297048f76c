"""Ingestion: files and raw texts to document rows with format, validation and route.

All of it is Columns on the scan's rows. Errors are a column: one bad row never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import detect
from docflow.functions.text import is_blank, stable_id

#: Extension -> (format, MIME type).
EXTENSIONS = {
    ".csv": ("structured", "text/csv"),
    ".json": ("structured", "application/json"),
    ".html": ("structured", "text/html"),
    ".htm": ("structured", "text/html"),
    ".xml": ("structured", "application/xml"),
    ".md": ("structured", "text/markdown"),
    ".markdown": ("structured", "text/markdown"),
    ".txt": ("text", "text/plain"),
    ".pdf": ("document", "application/pdf"),
    ".docx": ("document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".xlsx": ("document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ".xls": ("document", "application/vnd.ms-excel"),
    ".jpg": ("image", "image/jpeg"),
    ".jpeg": ("image", "image/jpeg"),
    ".png": ("image", "image/png"),
    ".gif": ("image", "image/gif"),
    ".bmp": ("image", "image/bmp"),
    ".tiff": ("image", "image/tiff"),
}
#: MIME types that the binary handler takes, and their kinds.
SUPPORTED = {
    "application/pdf": "pdf",
    "image/jpeg": "image",
    "image/png": "image",
    "image/tiff": "image",
    "image/bmp": "image",
    "image/gif": "image",
    EXTENSIONS[".docx"][1]: "docx",
    EXTENSIONS[".xlsx"][1]: "xlsx",
    EXTENSIONS[".xls"][1]: "xlsx",
}
#: Extensions that public MIME tables know beyond these, where they decide a format.
GUESSED = {
    ".webp": ("image", "image/webp"),
    ".svg": ("image", "image/svg+xml"),
    ".tif": ("image", "image/tiff"),
    ".jpe": ("image", "image/jpeg"),
    ".doc": ("document", "application/msword"),
    ".log": ("text", "text/plain"),
    ".py": ("text", "text/x-python"),
    ".c": ("text", "text/plain"),
    ".css": ("text", "text/css"),
    ".tsv": ("text", "text/tab-separated-values"),
}
DIRECT = "direct_text_input"


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(source_name, raw_bytes, raw_text null) of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("source_name"), F.col("content").alias("raw_bytes"), F.lit(None).cast("string").alias("raw_text"))


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Uploaded files as rows."""
    return spark.createDataFrame([(n, bytearray(b), None) for n, b in files], "source_name string, raw_bytes binary, raw_text string")


def from_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Raw texts as input rows; ids are kept if there are any."""
    keep = [c for c in ("document_id",) if c in texts.columns]
    return texts.select(*keep, F.lit(DIRECT).alias("source_name"), F.lit(None).cast("binary").alias("raw_bytes"), F.col(column).alias("raw_text"))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))


def encoding(content: Column) -> Column:
    """utf-8 where the bytes are valid (or empty), the BOM's encoding, else cp1252."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(content.isNull(), F.lit(None).cast("string"))
        .when(head.startswith("EFBBBF"), "utf-8-sig")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head.startswith("FEFF"), "utf-16-be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("cp1252")
    )


#: What cp1252 has at 80 to 9F, where Latin-1 has controls; its five gaps are replaced.
_LATIN, _CP1252 = "".join(map(chr, range(0x80, 0xA0))), bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def decoded(content: Column, name: Column) -> Column:
    """Text of the bytes; what the encoding cannot hold is replaced, nothing raises."""
    return (
        F.when(name == "utf-8", content.cast("string"))
        .when(name == "utf-8-sig", F.substring(content, 4, 2147483647).cast("string"))
        .when(name == "utf-16-le", F.decode(F.substring(content, 3, 2147483647), "UTF-16LE"))
        .when(name == "utf-16-be", F.decode(F.substring(content, 3, 2147483647), "UTF-16BE"))
        .when(name == "cp1252", F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _CP1252))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def magic_suffix(content: Column) -> Column:
    """.pdf, .png, .jpg or .bin by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), ".pdf")
        .when(head == "89504E470D0A1A0A", ".png")
        .when(head.startswith("FFD8") | head.startswith("FFE0") | head.startswith("FFE1"), ".jpg")
        .otherwise(".bin")
    )


def _lookup(key: Column, part: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in (EXTENSIONS | GUESSED).items() for x in (k, v[part])])
    return F.element_at(table, key)


def formats(name: Column, content: Column, text: Column) -> Column:
    """struct(detected_format, mime_type, encoding) by the order: raw text, mixed bytes, extension, printable text."""
    coding = encoding(content)
    inside = F.when(coding != "cp1252", decoded(content, coding))
    key = extension(name)

    def result(kind: Column | str, mime: Column | str | None, code: Column | str | None) -> Column:
        literal = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(literal(kind).alias("detected_format"), literal(mime).alias("mime_type"), literal(code).alias("encoding"))

    subject = F.coalesce(text, inside)
    return (
        F.when(subject.isNotNull() & detect.is_mixed(subject), result("mixed", "text/mixed", F.when(text.isNotNull(), "utf-8").otherwise(coding)))
        .when(text.isNotNull(), result("text", "text/plain", "utf-8"))
        .when(content.isNull(), result("unknown", None, None))
        .when(_lookup(key, 0).isNotNull(), result(_lookup(key, 0), _lookup(key, 1), coding))
        .when(inside.isNotNull() & ~is_blank(inside) & detect.is_printable(inside), result("text", "text/plain", coding))
        .otherwise(result("unknown", None, coding))
    )


def route(kind: Column) -> Column:
    return (
        F.when(kind.isin("text", "structured"), "text_handler")
        .when(kind.isin("image", "document"), "binary_handler")
        .when(kind == "unknown", "unknown_handler")
        .otherwise("mixed_handler")
    )


def binary_kind(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUPPORTED.items() for x in pair])
    return F.element_at(table, mime)


def validation_error(kind: Column, content: Column, text: Column) -> Column:
    """Null if the row is sound. A text of a mixed format counts as text, as the intent is."""
    nothing = content.isNull() & (text.isNull() | (text == ""))
    return F.when(kind.isin("text", "mixed") & nothing, "Empty text input").when(~kind.isin("text", "mixed") & content.isNull(), "Binary input missing bytes")


def ingest(inputs: DataFrame) -> DataFrame:
    """(source_name, raw_bytes, raw_text) -> document rows.

    document_id (given, else from name and content), source_name, raw_text (decoded for text
    routes), raw_bytes (kept for binary routes), detected_format, mime_type, encoding, language,
    extraction_method, routing_target, file_size, ingested_at (seconds; the only value that
    reruns change), error. Narrow maps only: no shuffle, and Catalyst prunes what later steps do
    not read.
    """
    given = inputs if "document_id" in inputs.columns else inputs.withColumn("document_id", stable_id(F.col("source_name"), F.coalesce(F.md5("raw_bytes"), F.md5(F.col("raw_text").cast("binary")), F.lit(""))))
    name, content, text = F.col("source_name"), F.col("raw_bytes"), F.col("raw_text")
    # Behind an explode of one element the format is found once a row; projections and filters
    # on it would otherwise be merged into copies of the whole expression.
    found = given.select("*", F.explode(F.array(formats(name, content, text))).alias("_f")).select("*", "_f.*").drop("_f")
    kind = F.col("detected_format")
    whole = F.coalesce(text, F.when(kind.isin("text", "structured", "mixed"), decoded(content, F.col("encoding"))))
    language = F.when(kind == "mixed", F.lit("en")).when(kind.isin("text", "structured"), detect.language(whole))
    method = F.when(kind == "mixed", F.lit("multi_format_analysis")).when(kind.isin("text", "structured"), F.when(text.isNotNull(), "raw_text").otherwise("byte_decode"))
    return found.select(
        "document_id",
        "source_name",
        whole.alias("raw_text"),
        F.when(kind.isin("image", "document", "unknown"), content).alias("raw_bytes"),
        kind.alias("detected_format"),
        "mime_type",
        "encoding",
        language.alias("language"),
        method.alias("extraction_method"),
        route(kind).alias("routing_target"),
        F.length(content).cast("long").alias("file_size"),
        (F.unix_micros(F.current_timestamp()) / F.lit(1e6)).alias("ingested_at"),
        validation_error(kind, content, text).alias("error"),
    )
