"""Queries whose whole output SQL can state: parsers, regions, files, layout, payloads, jobs.

Inputs are texts and files made of the tables' rows by expressions that both engines read, so a
query and its SQL start from the same text.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import detect
from docflow.operators import chunking, context, entities, jobs, layout, mixed, office, packing, parsers
from docflow.operators.batches import map_tuples
from docflow.plans.registry import CONVERSATIONS, conversations, documents, query, strip_sql, table, whole
from docflow.sources import ingest


def made(spark: SparkSession, sf: str, name: str, key: str, text: str, mime: str = "text/plain", keep: str = "true") -> DataFrame:
    """Documents of a table's rows, their text by an expression."""
    rows = table(spark, sf, name).filter(keep)
    return rows.select(F.col(key).cast("string").alias("document_id"), F.expr(text).alias("raw_text"), F.lit(mime).alias("mime_type"))


def sections_sql(name: str, key: str, parts: list[tuple[str, str, str]], summary: str | None = None, keep: str = "true") -> str:
    """Rows (document_id, section_idx, section_type, content) from (condition, type, content) in order.

    Sections whose condition fails are left out; with ``summary`` that section comes first.
    """
    listed = ", ".join(f"CASE WHEN {condition} THEN {{'t': {kind}, 'c': {content}}} END" for condition, kind, content in parts)
    first = f"list_concat([{{'t': 'summary', 'c': {summary}}}], p)" if summary else "p"
    return f"""
WITH l AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS p FROM {name} WHERE {keep}),
s AS (SELECT CAST({key} AS VARCHAR) AS document_id, {first} AS p FROM l)
SELECT document_id, generate_subscripts(p, 1) - 1 AS section_idx, unnest(list_transform(p, lambda x: x.t)) AS section_type, unnest(list_transform(p, lambda x: x.c)) AS content FROM s"""


def shown(sections: DataFrame) -> DataFrame:
    return whole(sections, "document_id", "section_idx", "section_type", "content")


# JSON

_JSON = """'{"id": ' || event_id || ', "user": {"n": ' || user_id || ', "kind": "' || event_type || '"}, "tags": ["a", ' || CASE WHEN event_id % 2 = 1 THEN '[["' || event_type || '"], []]' ELSE 'null' END || ', true], "empty": {}, "v": ' || event_id % 7 || '.5}'"""
_ODD = "event_id % 2 = 1"


@query(
    sections_sql(
        "events",
        "event_id",
        [
            ("true", "'json_group'", "'id: ' || event_id"),
            ("true", "'json_group'", "'user.n: ' || user_id"),
            ("true", "'json_group'", """'user.kind: "' || event_type || '"'"""),
            ("true", "'json_group'", """'tags[0]: "a"'"""),
            (_ODD, "'json_group'", """'tags[1][0][0]: "' || event_type || '"'"""),
            (f"NOT {_ODD}", "'json_group'", "'tags[1]: null'"),
            ("true", "'json_group'", "'tags[2]: True'"),
            ("true", "'json_group'", "'v: ' || event_id % 7 || '.5'"),
        ],
        summary="'Object with 5 keys (id, user, tags, ... (2 more))'",
    )
)
def json_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Nested objects and arrays of events: summary and a section for each path."""
    return shown(parsers.parse(made(spark, sf, "events", "event_id", _JSON, "application/json")))


@query(rf"SELECT CAST(event_id AS VARCHAR) AS document_id, 7::BIGINT AS total_keys, CASE WHEN {_ODD} THEN 4 ELSE 1 END::BIGINT AS total_arrays, 3::BIGINT AS total_objects, CASE WHEN {_ODD} THEN 4 ELSE 2 END::BIGINT AS max_depth FROM events")
def json_nested_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = parsers.parse(made(spark, sf, "events", "event_id", _JSON, "application/json")).filter("section_type = 'summary'")
    return found.select("document_id", *[F.element_at("metadata", c).cast("bigint").alias(c) for c in ("total_keys", "total_arrays", "total_objects", "max_depth")])


_ITEMS = "'[' || " + " || ', ' || ".join(f"""'{{"q": ' || (c_custkey + {k}) || '}}'""" for k in range(12)) + " || ']'"


@query(
    r"""
WITH c AS (SELECT c_custkey, array_to_string(list_transform(range(0, 10), lambda k: '[' || k || '].q: ' || (c_custkey + k)), chr(10)) || chr(10) || '... and 2 more items' AS body FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS document_id, '[*].q' AS group_name, 12::BIGINT AS item_count, '[0].q,[1].q,[2].q' AS sample_paths, body AS content FROM c
"""
)
def json_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """The items of an array in one group, the first ten shown."""
    docs = made(spark, sf, "customer", "c_custkey", _ITEMS, "application/json")
    found = parsers.section_rows(docs, lambda text, mime: parsers.parse_json(text, True)).filter("section_type = 'json_group'")
    m = lambda name: F.element_at("metadata", name)
    return found.select("document_id", m("group_name").alias("group_name"), m("item_count").cast("bigint").alias("item_count"), m("sample_paths").alias("sample_paths"), "content")


# CSV

_SEP = "CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"
_CSV = f"""'id' || {_SEP} || 'name' || {_SEP} || 'segment' || chr(10) || c_custkey || {_SEP} || '"' || c_name || {_SEP} || 'x"' || {_SEP} || c_mktsegment || chr(10) || {_SEP} || ' ' || {_SEP} || chr(10) || (c_custkey + 1) || {_SEP} || 'b' || {_SEP} || c_nationkey || {_SEP} || 'beyond' || chr(10) || (c_custkey + 2) || {_SEP} || chr(10)"""


@query(
    sections_sql(
        "customer",
        "c_custkey",
        [
            ("true", "'header'", "'CSV Headers: id | name | segment'"),
            ("true", "'data_row'", f"'id: ' || c_custkey || ' | name: ' || c_name || {_SEP} || 'x | segment: ' || c_mktsegment"),
            ("true", "'data_row'", "'id: ' || (c_custkey + 1) || ' | name: b | segment: ' || c_nationkey"),
            ("true", "'data_row'", "'id: ' || (c_custkey + 2)"),
            ("true", "'summary'", "'CSV Summary: 3 data rows with 3 columns'"),
        ],
    )
)
def csv_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Four separators, quotes, a blank row, a row too long and one too short."""
    return shown(parsers.parse(made(spark, sf, "customer", "c_custkey", _CSV, "text/csv")))


# HTML

_HTML = """'<!DOCTYPE html><html><head><title> Customer ' || c_custkey || '</title><style>p {}</style></head><body><h2>Second</h2><h1>' || c_name || '</h1><p>Segment of the customer: <b>' || c_mktsegment || '</b> &amp; more<p>short</p>'
 || '<div>A nested <p>paragraph of ' || c_name || '</p></div><ul><li>one' || c_nationkey || '<li>two<ul><li>inner</li></ul></ul><script>if (a < b) "</p>";</script>'
 || '<table><tr><th>key<th>nation</tr><tr><td>' || c_custkey || '<td>' || c_nationkey || '</table></body></html>'"""


@query(
    sections_sql(
        "customer",
        "c_custkey",
        [
            ("true", "'title'", "'Customer ' || c_custkey"),
            ("true", "'header'", "c_name"),
            ("true", "'header'", "'Second'"),
            ("true", "'content'", "'Segment of the customer:' || c_mktsegment || '& more'"),
            ("true", "'content'", "'A nestedparagraph of ' || c_name"),
            ("true", "'content'", "'paragraph of ' || c_name"),
            ("true", "'list'", "'• one' || c_nationkey || chr(10) || '• twoinner' || chr(10) || '• inner'"),
            ("true", "'list'", "'• inner'"),
            ("true", "'table'", "'key | nation' || chr(10) || repeat('-', 50) || chr(10) || c_custkey || ' | ' || c_nationkey"),
        ],
    )
)
def html_built(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with implied end tags, nested containers and lists, scripts, entities and tables."""
    return shown(parsers.parse(made(spark, sf, "customer", "c_custkey", _HTML, "text/html")))


# Markdown

_MD_HEAD = "'# ' || c_name || chr(10) || 'Intro of ' || c_mktsegment"
_MD_CODE = "'```sql' || chr(10) || '# no header ' || c_custkey || chr(10) || '```'"
_MD_AFTER = "'text after code'"
_MD_TABLE = "'| key | nation |' || chr(10) || '|---|---|' || chr(10) || '| ' || c_custkey || ' | ' || c_nationkey || ' |'"
_MD_LIST = "'## List' || chr(10) || '- one' || chr(10) || '- two'"
_MD = f"{_MD_HEAD} || chr(10) || {_MD_CODE} || chr(10) || {_MD_AFTER} || chr(10) || {_MD_TABLE} || chr(10) || {_MD_LIST} || chr(10) || '---' || chr(13) || chr(10) || '### Last' || chr(10) || 'end'"
_MD_UNIX = f"replace({_MD}, chr(13) || chr(10), chr(10))"


def _words_sql(text: str) -> str:
    return rf"len(list_filter(string_split_regex({text}, '\s+'), lambda x: x <> ''))"


@query(
    sections_sql(
        "customer",
        "c_custkey",
        [
            ("true", "'header_h1'", _MD_HEAD),
            ("true", "'code_block'", _MD_CODE),
            ("true", "'header_h1'", _MD_AFTER),
            ("true", "'table'", _MD_TABLE),
            ("true", "'header_h2'", _MD_LIST),
            ("true", "'horizontal_rule'", "'---'"),
            ("true", "'header_h3'", "'### Last' || chr(10) || 'end'"),
        ],
        summary=f"""'Markdown document with 7 sections' || chr(10) || 'Words: ' || {_words_sql(_MD_UNIX)} || ', Characters: ' || length({_MD_UNIX}) || ', Lines: ' || len(string_split({_MD_UNIX}, chr(10))) || chr(10) || 'Sections: 2 header_h1, 1 code_block, 1 table, 1 header_h2, 1 horizontal_rule, 1 header_h3' || chr(10) || 'Headers: 2 H1, 1 H2, 1 H3'""",
    )
)
def markdown_built(spark: SparkSession, sf: str) -> DataFrame:
    """Headers, a fence with a # in it, a table, a list, a rule and CRLF, with the summary."""
    return shown(parsers.parse(made(spark, sf, "customer", "c_custkey", _MD, "text/markdown")))


@query(r"SELECT CAST(c_custkey AS VARCHAR) AS document_id, 1::BIGINT AS table_rows, 2::BIGINT AS table_columns, 'key | nation' AS headers, c_custkey || ' | ' || c_nationkey AS table_data FROM customer")
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = parsers.parse(made(spark, sf, "customer", "c_custkey", _MD, "text/markdown")).filter("section_type = 'table'")
    m = lambda name: F.element_at("metadata", name)
    return found.select("document_id", m("table_rows").cast("bigint").alias("table_rows"), m("table_columns").cast("bigint").alias("table_columns"), m("headers").alias("headers"), m("table_data").alias("table_data"))


# Plain structure

_LISTED = "'First ' || c_name || chr(10) || '- a ' || c_nationkey || chr(10) || '* b' || chr(10) || chr(10) || '1. c' || chr(10) || '2) d ' || c_mktsegment || chr(10) || 'last line'"
_HEADED = "'lead ' || c_name || chr(10) || '# Head' || chr(10) || chr(10) || 'body' || chr(10) || '## ' || c_mktsegment || chr(10) || 'x' || chr(10) || 'y'"
_PLAIN_SHAPES = f"CASE c_custkey % 2 WHEN 0 THEN {_LISTED} ELSE {_HEADED} END"
_EVEN = "c_custkey % 2 = 0"


@query(
    sections_sql(
        "customer",
        "c_custkey",
        [
            (_EVEN, "'content'", "'First ' || c_name"),
            (_EVEN, "'list'", "'• a ' || c_nationkey || chr(10) || '• b'"),
            (_EVEN, "'list'", "'• c' || chr(10) || '• d ' || c_mktsegment"),
            (_EVEN, "'content'", "'last line'"),
            (f"NOT ({_EVEN})", "'content'", "'lead ' || c_name"),
            (f"NOT ({_EVEN})", "'header'", "'Head'"),
            (f"NOT ({_EVEN})", "'content'", "'body'"),
            (f"NOT ({_EVEN})", "'header'", "c_mktsegment"),
            (f"NOT ({_EVEN})", "'content'", "'x' || chr(10) || 'y'"),
        ],
    ).replace("generate_subscripts(p, 1) - 1", "generate_subscripts(p, 1)")
)
def structured_text(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text by its intended structure: lists of two kinds, headers with content."""
    docs = made(spark, sf, "customer", "c_custkey", _PLAIN_SHAPES)
    return shown(parsers.section_rows(docs, lambda text, mime: parsers.parse_structured(text)).filter("section_type <> 'summary'"))


@query(
    rf"""
WITH t AS (SELECT c_custkey, {_PLAIN_SHAPES} AS t FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS document_id, 'Document contains ' || CASE WHEN {_EVEN} THEN 4 ELSE 5 END || ' sections' || chr(10) || 'Words: ' || {_words_sql("t")} || ', Characters: ' || length(t) || ', Lines: 7' || chr(10)
  || CASE WHEN {_EVEN} THEN 'Sections: 2 content, 2 list' ELSE 'Sections: 3 content, 2 header' END AS content FROM t
"""
)
def structured_summaries(spark: SparkSession, sf: str) -> DataFrame:
    docs = made(spark, sf, "customer", "c_custkey", _PLAIN_SHAPES)
    return parsers.section_rows(docs, lambda text, mime: parsers.parse_structured(text)).filter("section_type = 'summary'").select("document_id", "content")


# Detection, encodings, metadata

#: Parts of a text, each of which is one format's mark, present by a bit of the row's number.
_MARKS = {
    "code": "'```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10)",
    "json": """'and {"k": ' || event_id || '} too' || chr(10)""",
    "html": "'some <i>word</i> here' || chr(10)",
    "csv": "'a,b,c' || chr(10) || '1,2,3' || chr(10) || '4;5;6' || chr(10)",
    "xml": "'see <host>db</host> there' || chr(10)",
}
_BIT = {name: f"(event_id // {1 << k}) % 2 = 1" for k, name in enumerate(_MARKS)}
_MIXED_TEXT = "repeat('plain words of prose that stand around it all' || chr(10), 8) || " + " || ".join(f"CASE WHEN CAST(floor(event_id / {1 << k}) AS BIGINT) % 2 = 1 THEN {part} ELSE '' END" for k, part in enumerate(_MARKS.values()))


@query(
    f"""
SELECT event_id, {", ".join(f"{_BIT[n]} AS {n}" for n in _MARKS)}, {" + ".join(f"({_BIT[n]})::INT" for n in _MARKS)} >= 2 AS mixed FROM events
"""
)
def mixed_formats(spark: SparkSession, sf: str) -> DataFrame:
    """All sets of five formats' marks in prose: each indicator and the verdict."""
    texts = table(spark, sf, "events").select("event_id", F.expr(_MIXED_TEXT).alias("t"))
    found = detect.mixed_indicators(F.col("t"))
    return texts.select("event_id", *[found[n].alias(n) for n in _MARKS], detect.is_mixed(F.col("t")).alias("mixed"))


_XML_TEXTS = ("<?xml version=''1.0''?><a/>", "<host>x</host>", "<HOST>x</HOST><br/>", "<host id=''1''>x</host>", "<a xmlns:b=''u''>x</a>", "<div>x</div><host>y</host>", "<timeout>5</timeout>", "plain")
_XML_CASE = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_XML_TEXTS)) + " END"


@query("SELECT event_id, event_id % 8 IN (0, 1, 2, 4) AS xml, event_id % 8 IN (0, 1, 2, 4, 6) AS mixed_xml, event_id % 3 <> 2 AS likely_json FROM events")
def likeness(spark: SparkSession, sf: str) -> DataFrame:
    """XML by either list of tags, and JSON by its marks."""
    hints = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"a": ' WHEN 1 THEN '[ {1' ELSE '{a, b}' END""").alias("j")
    texts = table(spark, sf, "events").select("event_id", F.expr(_XML_CASE.replace("''", '"')).alias("t"), hints)
    t = F.col("t")
    return texts.select("event_id", detect.is_xml_like(t).alias("xml"), detect.is_xml_like(t, detect.MIXED_XML_TAGS).alias("mixed_xml"), detect.is_likely_json(F.col("j")).alias("likely_json"))


@query(
    rf"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' ELSE CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'cp1252' ELSE 'utf-8' END END AS encoding,
  text AS raw_text, CASE WHEN length({strip_sql("text")}) < 10 THEN NULL ELSE 'en' END AS language, 'byte_decode' AS extraction_method, 'text_handler' AS routing_target, NULL::VARCHAR AS error FROM documents
"""
)
def encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files in five encodings, decoded whole."""
    text, k = F.col("text"), F.col("doc_id") % 5
    content = (
        F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(k == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(k == 4, F.encode(text, "ISO-8859-1"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("a.txt").alias("source_name"), content.alias("raw_bytes"), F.lit(None).cast("string").alias("raw_text"))
    return ingest.ingest(files).select("document_id", "encoding", "raw_text", "language", "extraction_method", "routing_target", "error")


@query(
    r"""
SELECT CAST(event_id AS VARCHAR) AS document_id, CASE event_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'unknown' WHEN 3 THEN 'document' ELSE 'image' END AS detected_format, CASE event_id % 5 WHEN 1 THEN 'Empty text input' WHEN 2 THEN 'Binary input missing bytes' END AS error,
  CASE event_id % 5 WHEN 3 THEN 'xlsx' WHEN 4 THEN 'image' END AS kind, CASE WHEN event_id % 5 >= 3 THEN length(event_type)::BIGINT END AS file_size, CASE event_id % 5 WHEN 0 THEN 'raw_text' WHEN 1 THEN 'raw_text' END AS extraction_method FROM events
"""
)
def validation(spark: SparkSession, sf: str) -> DataFrame:
    """Texts, empty texts, nothing at all, and files by extension: errors and kinds of binary files."""
    k = F.col("event_id") % 5
    name = F.when(k == 3, "a.XLS").when(k == 4, "b.tiff").otherwise("x")
    inputs = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("document_id"), name.alias("source_name"), F.when(k >= 3, F.col("event_type").cast("binary")).alias("raw_bytes"), F.when(k == 0, F.col("event_type")).when(k == 1, "").alias("raw_text"))
    return ingest.ingest(inputs).select("document_id", "detected_format", "error", ingest.binary_kind(F.col("mime_type")).alias("kind"), "file_size", "extraction_method")


# Mixed texts

_MIX_JSON = """'{"key": ' || c_custkey || ', "name": "' || c_name || '"}'"""
_MIX_XML = "'<connection><host>db' || c_nationkey || '</host><port>54' || c_nationkey || '</port><timeout>30</timeout></connection>'"
_MIX_HTML = "'<div class=\"a\"><b>' || c_mktsegment || '</b></div>'"
_MIX_CODE = "'print(' || c_custkey || ')'"
_MIX_CSV = "'id,name,nation' || chr(10) || c_custkey || ',' || c_name || ',' || c_nationkey || chr(10) || '2,b,3'"
_MIX = f"'Intro of the text.' || chr(10) || {_MIX_JSON} || chr(10) || {_MIX_HTML} || chr(10) || 'Between.' || chr(10) || {_MIX_XML} || chr(10) || '```py' || chr(10) || {_MIX_CODE} || chr(10) || '```' || chr(10) || {_MIX_CSV} || chr(10) || 'The end.'"


@query(
    sections_sql(
        "customer",
        "c_custkey",
        [
            ("true", "'paragraph'", "'Intro of the text.'"),
            ("true", "'summary'", "'Object with 2 keys (key, name)'"),
            ("true", "'json_group'", "'key: ' || c_custkey"),
            ("true", "'json_group'", """'name: "' || c_name || '"'"""),
            ("true", "'html_block'", "'<div class=\"a\"><b>' || c_mktsegment || '</b>'"),
            ("true", "'paragraph'", "'</div>' || chr(10) || 'Between.'"),
            ("true", "'xml_block'", _MIX_XML),
            ("true", "'code_block'", _MIX_CODE),
            ("true", "'header'", "'CSV Headers: id | name | nation'"),
            ("true", "'data_row'", "'id: ' || c_custkey || ' | name: ' || c_name || ' | nation: ' || c_nationkey"),
            ("true", "'data_row'", "'id: 2 | name: b | nation: 3'"),
            ("true", "'summary'", "'CSV Summary: 2 data rows with 3 columns'"),
            ("true", "'paragraph'", "'The end.'"),
        ],
        summary=f"""'Mixed document with 8 regions: 3 text, 1 json, 1 html, 1 xml, 1 code, 1 csv' || chr(10) || 'Words: ' || {_words_sql(_MIX)} || ', Characters: ' || length({_MIX}) || chr(10) || 'Sections: 3 paragraph, 2 summary, 2 json_group, 1 html_block, 1 xml_block, 1 code_block, 1 header, 2 data_row'""",
    )
)
def mixed_built(spark: SparkSession, sf: str) -> DataFrame:
    """Prose with JSON, XML, HTML, code and CSV: all sections and the summary."""
    return shown(mixed.parse(made(spark, sf, "customer", "c_custkey", _MIX)))


@query(
    rf"""
WITH o AS (SELECT c_custkey, length({_MIX_JSON}) AS j, length(c_mktsegment) AS m, length({_MIX_XML}) AS x, length({_MIX_CODE}) AS p, length({_MIX_CSV}) AS v FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS document_id, unnest(['json', 'html', 'xml', 'code', 'csv']) AS region_format, unnest([19, 20 + j, 58 + j + m, 59 + j + m + x, 70 + j + m + x + p])::BIGINT AS region_start,
  unnest([19 + j, 42 + j + m, 58 + j + m + x, 69 + j + m + x + p, 71 + j + m + x + p + v])::BIGINT AS region_end, unnest([1.0, 0.6, 0.8, 0.9, 0.3])::DOUBLE AS confidence FROM o
"""
)
def mixed_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the regions of the mixed texts lie, and how sure they are."""
    found = mixed.parse(made(spark, sf, "customer", "c_custkey", _MIX))
    m = lambda name: F.element_at("metadata", name)
    regions = found.select("document_id", m("region_format").alias("region_format"), m("region_start").cast("bigint").alias("region_start"), m("region_end").cast("bigint").alias("region_end"), F.round(m("confidence").cast("double"), 6).alias("confidence"))
    return regions.filter("region_format <> 'text'").distinct()


@query("SELECT CAST(c_custkey AS VARCHAR) AS document_id, unnest(['unknown', 'text', 'json', 'xml', 'html', 'code', 'csv']) AS region_format, unnest([1, 3, 3, 1, 1, 1, 4])::BIGINT AS sections FROM customer")
def mixed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return mixed.format_summary(mixed.parse(made(spark, sf, "customer", "c_custkey", _MIX)))


# Order-dependent folds, as recursion in SQL


@query(
    r"""
WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 37) % 400, event_id) AS i,
    {'s': (event_id * 37) % 400, 'e': (event_id * 37) % 400 + 1 + (event_id * 13) % 30, 'f': event_type, 'c': (event_id * 7) % 10 / 10.0::DOUBLE, 'n': event_id} AS x FROM events),
f AS (
  SELECT user_id, 1::BIGINT AS i, [x] AS kept FROM r WHERE i = 1
  UNION ALL
  SELECT f.user_id, f.i + 1, CASE WHEN len(hit) = 0 THEN list_append(kept, x) WHEN x.c > hit[1].c THEN list_transform(kept, lambda k: CASE WHEN k.n = hit[1].n THEN x ELSE k END) ELSE kept END
  FROM (SELECT f.user_id, f.i, kept, x, list_filter(kept, lambda k: x.s < k.e AND k.s < x.e) AS hit FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1) f),
last AS (SELECT user_id, max_by(kept, i) AS kept FROM f GROUP BY 1),
u AS (SELECT user_id, unnest(kept) AS k FROM last)
SELECT user_id AS document_id, k.f AS format, k.s::BIGINT AS start, k.e::BIGINT AS "end", k.c AS confidence FROM u
"""
)
def settle_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Users' overlapping intervals settled in order, all that stay."""
    from docflow.plans.catalog import regions

    return whole(mixed.settle_overlaps(regions(spark, sf)).drop("content"))


@query(
    rf"""
WITH RECURSIVE s AS (SELECT doc_id, flatten(list_transform(string_split({strip_sql("text")}, chr(10)),
    lambda l: string_split(regexp_replace({strip_sql("l")}, '([.!?])(\s+|$)', '\1' || chr(1), 'g'), chr(1)))) AS parts FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: {strip_sql("p")}), lambda p: p <> '') AS parts FROM s),
p AS (SELECT doc_id, len(parts) AS n, list_transform(parts, lambda x: list_filter(string_split_regex(x, '\s+'), lambda t: t <> '')) AS pieces FROM f WHERE len(parts) > 1),
r AS (
  SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS now, NULL::VARCHAR AS closed FROM p
  UNION ALL
  SELECT doc_id, i + 1, list_concat(CASE WHEN is_full THEN now[greatest(1, len(now) - 31) :] ELSE now END, own), CASE WHEN is_full THEN array_to_string(now, ' ') END
  FROM (SELECT r.doc_id, r.i, now, pieces[r.i + 1] AS own, len(now) > 0 AND len(now) + len(pieces[r.i + 1]) > 256 AS is_full FROM r JOIN p ON p.doc_id = r.doc_id AND r.i < p.n)),
c AS (SELECT doc_id, i, closed AS text FROM r WHERE closed IS NOT NULL UNION ALL SELECT r.doc_id, r.i + 1, array_to_string(now, ' ') FROM r JOIN p ON p.doc_id = r.doc_id AND r.i = p.n WHERE len(now) > 0),
o AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)),
w AS (SELECT doc_id, t, unnest(generate_series(0, greatest(0, len(t) - 33), 224)) AS place FROM o WHERE len(t) > 0)
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, 'sentence' AS strategy, text FROM c
UNION ALL SELECT doc_id, place // 224, 'sliding_window', array_to_string(t[place + 1 : place + 256], ' ') FROM w
"""
)
def packed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences packed to 256 words with 32 of overlap; windows where there is but one sentence."""
    return whole(packing.packed_chunks(documents(spark, sf), most=256, overlap=32))


# Chunks, payloads, topics


@query(
    rf"""
WITH f AS (SELECT document_id, string_split(regexp_replace(raw_text, '(?m)^(#{{1,6}}\s+\S.*|\d+[.)]\s+[A-Z]\S*.*|(Chapter|Section|Part|Appendix)\s+\S.*|[A-Z][A-Z ]{{3,60}}$)$', chr(1) || '\0', 'g'), chr(1)) AS parts FROM {CONVERSATIONS}),
u AS (SELECT document_id, generate_subscripts(parts, 1) - 1 AS section_number, unnest(parts) AS text FROM f)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section_number) - 1 AS chunk_index, section_number::BIGINT AS section_number, section_number > 0 AS section_detected,
  sha256(document_id || '|section|' || (row_number() OVER (PARTITION BY document_id ORDER BY section_number) - 1)) AS chunk_id FROM u WHERE {strip_sql("text")} <> ''
"""
)
def section_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, marks and ids of section chunks, by the dispatcher over raw texts."""
    found = chunking.chunk_documents(conversations(spark, sf), "section")
    m = lambda name: F.element_at("metadata", name)
    return whole(found.select("document_id", "chunk_index", m("section_number").cast("bigint").alias("section_number"), m("section_detected").cast("boolean").alias("section_detected"), "chunk_id"))


@query(
    rf"""
WITH b AS (SELECT conv_id, turn, {strip_sql("text")} AS text, role FROM conversations WHERE {strip_sql("text")} <> '')
SELECT conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, text, (turn // 3)::VARCHAR AS page_number, role AS label, 'b' || turn AS block_id FROM b WHERE conv_id % 2 = 0
UNION ALL SELECT conv_id, 0, string_agg(text, ' / ' ORDER BY turn), NULL, NULL, NULL FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id
"""
)
def dispatched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Even conversations have blocks, cut one by one; odd ones raw text alone."""
    t = table(spark, sf, "conversations")
    even = F.col("conv_id") % 2 == 0
    blocks = t.filter(even).select(F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 3).alias("page_number"), F.col("turn").alias("block_idx"), F.concat(F.lit("b"), "turn").alias("block_id"), F.col("role").alias("label"), F.lit("").alias("title"), F.lit("").alias("corrected_text"), F.col("text").alias("raw_text"), F.lit(1.0).alias("confidence"))
    listed = t.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    raw = listed.select("document_id", F.array_join(F.transform("x", lambda x: x["text"]), " / ").alias("raw_text"))
    found = chunking.chunk_documents(raw, "paragraph", blocks=blocks)
    m = lambda name: F.element_at("metadata", name)
    return whole(found.select("document_id", "chunk_index", "text", m("page_number").alias("page_number"), m("label").alias("label"), m("block_id").alias("block_id")))


_CHUNKS_OF_TURNS = """SELECT conv_id AS document_id, turn AS chunk_index, 'context' AS method, text, role AS topic_id, sha256(conv_id || '|context|' || turn) AS chunk_id FROM conversations"""


@query(
    rf"""
WITH c AS ({_CHUNKS_OF_TURNS})
SELECT a.document_id, a.chunk_index, a.chunk_id, count(b.chunk_id) AS related, coalesce(string_agg(b.chunk_id, ',' ORDER BY b.chunk_index), '') AS related_chunk_ids
FROM c a LEFT JOIN c b ON a.document_id = b.document_id AND a.topic_id = b.topic_id AND a.chunk_id <> b.chunk_id GROUP BY 1, 2, 3
"""
)
def related_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the other turns of the same role in a conversation, in order."""
    t = table(spark, sf, "conversations")
    found = context.related(t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.lit("context").alias("method"), F.col("role").alias("topic_id")))
    return whole(found.select("document_id", "chunk_index", "chunk_id", F.size("related_chunk_ids").alias("related"), F.array_join("related_chunk_ids", ",").alias("related_chunk_ids")))


@query(
    r"""
SELECT conv_id AS document_id, '{"chunks":[' || string_agg('{"chunk_index":' || turn || ',"chunk_id":"c' || turn || '","method":"paragraph","text":' || to_json(text) || ',"metadata":{"role":"' || role || '"}}', ',' ORDER BY turn) || '],"total_chunks":' || count(*) || '}' AS payload
FROM conversations GROUP BY conv_id
"""
)
def chunk_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The whole payload text of each conversation's chunks."""
    t = table(spark, sf, "conversations")
    return chunking.payload(t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.concat(F.lit("c"), "turn").alias("chunk_id"), F.lit("paragraph").alias("method"), "text", F.create_map(F.lit("role"), "role").alias("metadata")))


@query(
    r"""
WITH g AS (SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS merged, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT conv_id AS document_id, '{"groups":[' || string_agg('{"topic_id":"' || role || '","topic_label":"' || upper(role) || '","topic_words":["' || role || '"],"text":' || to_json(merged) || ',"source_chunks":' || n || ',"coherence_score":0.5}', ',' ORDER BY role) || '],"total_groups":' || count(*) || '}' AS payload
FROM g GROUP BY conv_id
"""
)
def group_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The whole payload text of each conversation's topic groups."""
    t = table(spark, sf, "conversations")
    chunks = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("topic_id"), "text", F.lit(1.0).alias("similarity_score"), F.upper("role").alias("topic_label"), F.array("role").alias("topic_words"), F.lit(0.5).alias("coherence_score"))
    return chunking.groups_payload(context.context_groups(chunks))


@query(
    rf"""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, {strip_sql("text")} AS text FROM conversations),
c AS (SELECT * FROM t WHERE k < 3)
SELECT CAST(conv_id AS VARCHAR) AS document_id, k AS chunk_index, 'paragraph' AS method, text, k AS topic_id, 'Group ' || (k + 1) AS topic_label, 0.0::DOUBLE AS similarity_score, 1.0::DOUBLE AS coherence_score FROM c
"""
)
def context_small(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of up to three paragraphs: each is a group of its own."""
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    docs = t.select("document_id", F.transform(F.slice("x", 1, 3), lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", "")).alias("paragraphs"))
    return whole(context.context_chunks(docs).drop("topic_words"))


# Office files, PDFs, batches

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, body in parts.items():
            file.writestr(name, body)
    return out.getvalue()


def _docx(name: str, nations: list[str]) -> bytes:
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    table_xml = "<w:tbl>" + row("nation", "region") + "".join(row(n, name) for n in nations) + "</w:tbl>"
    body = p(name, "Heading1") + p(f"Region with {len(nations)} nations") + "".join(p(n, "ListBullet") for n in nations) + table_xml + p("Tail", "Heading2") + p("end")
    return _archive({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def _xlsx(name: str, nations: list[str]) -> bytes:
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = f'<row r="1">{cell("A1", "nation")}{cell("B1", "size")}</row>' + "".join(f'<row r="{k}">{cell(f"A{k}", n)}<c r="B{k}"><f>LEN(A{k})</f></c></row>' for k, n in enumerate(nations, 2))
    links = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2))
    return _archive({
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="{name}" r:id="r1"/><sheet name="Blank" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>",
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet {_S}><sheetData></sheetData></worksheet>",
    })


def office_files(spark: SparkSession, sf: str) -> DataFrame:
    """A DOCX and an XLSX file for each region, with its nations in order."""
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    listed = joined.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    names = listed.select("r_name", F.transform("n", lambda x: x["n_name"]).alias("nations"))
    schema = "document_id string, source_name string, kind string, raw_bytes binary"
    arrow = pa.schema([("document_id", pa.string()), ("source_name", pa.string()), ("kind", pa.string()), ("raw_bytes", pa.binary())])
    return map_tuples(names, lambda name, nations: [(f"{name}.{kind}", f"{name}.{kind}", kind, make(name, nations)) for kind, make in (("docx", _docx), ("xlsx", _xlsx))], schema, arrow)


@query(
    r"""
WITH r AS (SELECT r_name, count(*) AS n, string_agg('• ' || n_name, chr(10) ORDER BY n_nationkey) AS bullets, string_agg(n_name || ' | ' || r_name, chr(10) ORDER BY n_nationkey) AS cells,
  list(n_name ORDER BY n_nationkey) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1),
x AS (SELECT *, list_transform(range(1, n + 1), lambda k: names[k] || ' | =LEN(A' || (k + 1) || ')') AS lines, list_transform(range(1, n + 1), lambda k: 'B' || (k + 1) || ': =LEN(A' || (k + 1) || ')') AS formulas FROM r),
d AS (SELECT r_name || '.docx' AS document_id, unnest([1, 1, 1, 1, 1]) AS page_number, unnest(['document', 'document', 'document', 'document', 'document']) AS label, unnest(['heading', 'content', 'heading', 'content', 'table']) AS kind,
  unnest([r_name, 'Region with ' || n || ' nations' || chr(10) || bullets, 'Tail', 'end', 'nation | region' || chr(10) || repeat('-', 50) || chr(10) || cells]) AS raw_text, unnest([1.0, 0.8, 1.0, 0.8, 0.9])::DOUBLE AS confidence FROM r),
s AS (SELECT r_name || '.xlsx' AS document_id, unnest([1, 1, 2]) AS page_number, unnest(['worksheet', 'worksheet', 'worksheet']) AS label, unnest(['table', 'formulas', 'empty']) AS kind,
  unnest(['nation | size' || chr(10) || repeat('-', 50) || chr(10) || array_to_string(lines[1:10], chr(10)) || CASE WHEN n > 10 THEN chr(10) || '... (' || (n - 10) || ' more rows)' ELSE '' END, array_to_string(formulas, chr(10)), 'Empty worksheet: Blank']) AS raw_text, unnest([0.9, 0.7, 1.0])::DOUBLE AS confidence FROM x)
SELECT document_id, page_number::BIGINT AS page_number, label, kind, raw_text, confidence FROM d UNION ALL SELECT document_id, page_number::BIGINT, label, kind, raw_text, confidence FROM s
"""
)
def office_built(spark: SparkSession, sf: str) -> DataFrame:
    """All regions of the office files: headings, runs, lists, tables, formulas, an empty sheet."""
    found = office.office_regions(office_files(spark, sf))
    return whole(found.select("document_id", "page_number", "label", "kind", "raw_text", "confidence"))


@query(
    r"""
WITH r AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)
SELECT r_name || '.docx' AS document_id, 1::BIGINT AS table_count, n + 4 AS paragraph_count, true AS has_headings, true AS has_lists, NULL::BIGINT AS total_cells, NULL::BIGINT AS total_formulas, NULL::BIGINT AS total_sheets FROM r
UNION ALL SELECT r_name || '.xlsx', NULL, NULL, NULL, NULL, 2 * n + 2, n, 2 FROM r
"""
)
def office_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the files: tables, paragraphs, flags, cells, formulas, sheets."""
    found = office.office_regions(office_files(spark, sf))
    m = lambda name, kind: F.first(F.element_at("metadata", name)).cast(kind).alias(name)
    return found.groupBy("document_id").agg(m("table_count", "bigint"), m("paragraph_count", "bigint"), m("has_headings", "boolean"), m("has_lists", "boolean"), m("total_cells", "bigint"), m("total_formulas", "bigint"), m("total_sheets", "bigint"))


def pdf_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as PDFs of two pages; every third has no text, every fifth is a bare PNG head."""
    page = F.concat(F.lit("BT ("), "c_name", F.lit(" of the segment "), "c_mktsegment", F.lit(") Tj 0 -12 Td (balance \\("), "c_nationkey", F.lit("\\)) Tj ET"))
    first = F.when(F.col("c_custkey") % 3 == 0, F.lit("q Q")).otherwise(page)
    second = F.when(F.col("c_custkey") % 3 == 0, F.lit("q Q")).otherwise(F.lit("BT [(sec) 20 (ond) -300 (page)] TJ ET"))
    stream = lambda number, text: F.concat(F.lit(f"{number} 0 obj<</Length "), F.length(text), F.lit(">>stream\n"), text, F.lit("\nendstream endobj\n"))
    head = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 5 0 R>>endobj\n4 0 obj<</Type/Page/Parent 2 0 R/Contents 6 0 R>>endobj\n"
    pdf_text = F.concat(F.lit(head), stream(5, first), stream(6, second), F.lit("trailer<</Root 1 0 R>>"))
    image = F.col("c_custkey") % 5 == 0
    name = F.concat(F.lit("c"), "c_custkey", F.when(image, ".png").otherwise(".pdf"))
    content = F.when(image, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(pdf_text.cast("binary"))
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), name.alias("source_name"), content.alias("raw_bytes"), F.lit(None).cast("string").alias("raw_text"))


@query(
    r"""
SELECT CAST(c_custkey AS VARCHAR) AS document_id, unnest([0, 1])::BIGINT AS section_idx, 'full_page' AS section_type, unnest([c_name || ' of the segment ' || c_mktsegment || chr(10) || 'balance (' || c_nationkey || ')', 'second page']) AS content FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 0, 'error', 'No engine could read the file (pdf_text: ' || CASE WHEN c_custkey % 5 = 0 THEN 'no PDF header' ELSE 'no text layer' END || ')' FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0
"""
)
def binary_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of PDFs with a text layer; PDFs without one and images fail where no engine is registered for them."""
    return shown(jobs.process(pdf_files(spark, sf))[1])


@query(
    r"""
SELECT 'c' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '.png' ELSE '.pdf' END AS file_name, CASE WHEN bad THEN 'N/A' ELSE CAST(c_custkey AS VARCHAR) END AS document_id, CASE WHEN bad THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN 'image' ELSE 'document' END AS detected_format, CASE WHEN c_custkey % 5 = 0 THEN 'image/png' ELSE 'application/pdf' END AS mime_type, 'binary_handler' AS routing_target, CASE WHEN bad THEN 0 ELSE 2 END::BIGINT AS sections
FROM (SELECT *, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS bad FROM customer)
"""
)
def job_results(spark: SparkSession, sf: str) -> DataFrame:
    """One result a file: status, format, route, number of sections."""
    found = jobs.results(*jobs.process(pdf_files(spark, sf)))
    return whole(found.select("file_name", "document_id", "status", "detected_format", "mime_type", "routing_target", "sections"))


@query(
    r"""
WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) <= 5 AS few, contains(lower(text), 'the ') AS hit FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t WHERE few OR hit)
SELECT conv_id AS document_id, turn AS section_idx FROM n WHERE few OR n <= 10
"""
)
def section_search(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that hold a word; conversations of up to five turns are shown whole."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_idx"), F.col("text").alias("content"))
    return jobs.search_sections(t, "The ").select("document_id", "section_idx")


@query(
    r"""
SELECT conv_id AS document_id, '{"document":{"document_id":' || conv_id || ',"source_name":"c' || conv_id || '.md","detected_format":"structured","mime_type":"text/markdown","encoding":"utf-8","language":"en","extraction_method":"raw_text","routing_target":"text_handler","file_size":' || sum(length(text))::BIGINT || '},"sections":['
  || string_agg('{"section_idx":' || turn || ',"section_type":"' || role || '","content":' || to_json(text) || ',"metadata":{"n":"' || turn || '"}}', ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY conv_id
"""
)
def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a document with its sections in one JSON text."""
    t = table(spark, sf, "conversations")
    docs = t.groupBy(F.col("conv_id").alias("document_id")).agg(F.sum(F.length("text")).cast("long").alias("file_size"))
    fixed = {"detected_format": "structured", "mime_type": "text/markdown", "encoding": "utf-8", "language": "en", "extraction_method": "raw_text", "routing_target": "text_handler"}
    docs = docs.select("document_id", F.concat(F.lit("c"), "document_id", F.lit(".md")).alias("source_name"), *[F.lit(v).alias(k) for k, v in fixed.items()], "file_size")
    rows = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_idx"), F.col("role").alias("section_type"), F.col("text").alias("content"), F.create_map(F.lit("n"), F.col("turn").cast("string")).alias("metadata"))
    return jobs.document_json(docs, rows)


# Layout, whole


@query(
    r"""
WITH b AS (SELECT l_orderkey AS document_id, l_linenumber AS line, (l_partkey % 3) * 300 + l_suppkey % 20 AS x0, l_partkey % 997 AS y0 FROM lineitem),
g AS (SELECT *, (x0 + x0 + 200) / 2.0 AS c FROM b),
s AS (SELECT *, coalesce(c - lag(c) OVER (PARTITION BY document_id ORDER BY c) > 80, true) AS begins FROM g),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY document_id ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS col FROM s)
SELECT document_id, col::BIGINT AS col, row_number() OVER (PARTITION BY document_id ORDER BY col, y0, x0) - 1 AS place, x0::BIGINT AS x0, y0::BIGINT AS y0 FROM n
"""
)
def reading_places(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every block in the reading order of its page."""
    from docflow.plans.catalog import boxes

    placed = layout.reading_order(boxes(spark, sf))
    return whole(placed.select("document_id", "col", F.col("order").alias("place"), F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0")))


_WIDEST = "CASE WHEN greatest(a, b, c) > 224 THEN 1000 ELSE 224 END"


@query(
    rf"""
WITH b AS (SELECT event_id, event_id % 1001 AS a, (event_id * 7) % 1001 AS b, event_id % 200 AS c FROM events)
SELECT event_id, trunc(a * 1240.0 / {_WIDEST})::BIGINT || ',' || trunc(b * 1754.0 / {_WIDEST})::BIGINT || ',' || trunc(c * 1240.0 / {_WIDEST})::BIGINT || ',' || trunc(c * 1754.0 / {_WIDEST})::BIGINT AS scaled,
  least(greatest(0, a - 500), 300) || ',' || least(greatest(0, b - 500), 200) || ',' || least(c, 300) || ',' || least(c + 100, 200) AS clamped FROM b
"""
)
def boxes_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All four sides of scaled and of clamped boxes."""
    a, b, c = F.col("event_id") % 1001, (F.col("event_id") * 7) % 1001, F.col("event_id") % 200
    text = lambda box: F.array_join(F.transform(box, lambda x: x.cast("string")), ",")
    scaled, clamped = layout.scale_box(F.array(a, b, c, c), F.lit(1240), F.lit(1754)), layout.clamp_box(F.array(a - 500, b - 500, c, c + 100), F.lit(300), F.lit(200))
    return table(spark, sf, "events").select("event_id", text(scaled).alias("scaled"), text(clamped).alias("clamped"))


@query(
    r"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'title:1,2,3,' || event_id || ';body:0,0,1,1' WHEN 1 THEN event_type || ':1,2,3,4' WHEN 2 THEN '' ELSE 'x:1,2,3,4' END AS blocks FROM events
"""
)
def model_output(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks in a model's text: a list, a list in prose with a broken block, prose, a label that is no text."""
    text = F.expr(
        """CASE event_id % 4 WHEN 0 THEN '[{"label":"title","bbox":[1,2,3,' || event_id || ']},{"label":"body","bbox":[0,0,1,1]}]' WHEN 1 THEN 'Here: [{"label":"' || event_type || '","bbox":[1,2,3,4]},{"label":"y","bbox":[1,2]}] done'
        WHEN 2 THEN 'nothing' ELSE '[{"label":"x","bbox":[1,2,3,4]},{"bbox":[1,2,3,4]}]' END"""
    )
    one = lambda b: F.concat(b["label"], F.lit(":"), F.array_join(F.transform(b["bbox"], lambda x: x.cast("bigint").cast("string")), ","))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(layout.model_blocks(text), one), ";").alias("blocks"))


@query(
    r"""
WITH p AS (SELECT DISTINCT user_id AS document_id FROM events),
k AS (SELECT user_id AS document_id, CASE event_type WHEN 'click' THEN 'body' WHEN 'view' THEN 'caption' ELSE event_type END AS label, event_id AS x0, value / 1000 AS confidence FROM events WHERE value / 1000 >= 0.2 AND event_type <> 'error')
SELECT p.document_id, coalesce(label, 'full_page') AS label, coalesce(x0, 0)::BIGINT AS x0, coalesce(round(confidence, 6), 0.0)::DOUBLE AS confidence FROM p LEFT JOIN k USING (document_id)
"""
)
def detected_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks sure enough and not left out, with their labels; users without any get a full page."""
    e = table(spark, sf, "events")
    label = F.when(F.col("event_type") == "click", "plain text").when(F.col("event_type") == "view", "figure_caption").when(F.col("event_type") == "error", "abandon").otherwise(F.col("event_type"))
    x = F.col("event_id").cast("int")
    blocks = e.select(F.col("user_id").alias("document_id"), F.lit(1).alias("page_number"), label.alias("label"), F.array(x, x, x, x).alias("bbox"), (F.col("value") / 1000).alias("confidence"))
    found = layout.detected_blocks(blocks, blocks.select("document_id", "page_number").distinct())
    return found.select("document_id", "label", F.col("bbox")[0].cast("bigint").alias("x0"), F.round("confidence", 6).alias("confidence"))


@query(
    r"""
WITH s AS (SELECT l_orderkey AS document_id, l_linenumber AS line, l_partkey AS x0 FROM lineitem),
n AS (SELECT *, coalesce((x0 - lag(x0) OVER (PARTITION BY document_id ORDER BY x0) > 150)::INT, 0) AS begins FROM s)
SELECT document_id, x0, sum(begins) OVER (PARTITION BY document_id ORDER BY x0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS col FROM n
"""
)
def span_places(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of spans by gaps in their left edges."""
    spans = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_partkey").alias("x0"), F.lit(1000).alias("page_width"))
    return layout.span_columns(spans).select("document_id", "x0", F.col("col").cast("bigint").alias("col"))


@query(
    r"""
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0),
l AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1)
SELECT p.o_custkey AS document_id, p.o_orderkey AS page_number, l.o_orderpriority AS layout FROM p JOIN l ON p.o_custkey = l.o_custkey AND p.n = l.n
"""
)
def zipped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Even orders as pages and odd ones as layouts of a customer, joined by place."""
    o = table(spark, sf, "orders")
    side = lambda rest, *more: o.filter(F.col("o_orderkey") % 2 == rest).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_number"), *more)
    return layout.zip_pages(side(0), side(1, F.col("o_orderpriority").alias("layout"))).select("document_id", "page_number", "layout")


@query(
    r"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 - 100 AS x0, l_suppkey % 300 AS y0 FROM lineitem),
c AS (SELECT l_orderkey AS document_id, greatest(0, least(x0, 600)) AS x0, greatest(0, least(y0, 250)) AS y0, greatest(0, least(x0 + 150, 600)) AS x1, greatest(0, least(y0 + 10, 250)) AS y1 FROM b)
SELECT document_id, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1 FROM c WHERE x1 > x0 AND y1 > y0
"""
)
def page_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a page cut to it; those without an area go."""
    x, y = F.col("l_partkey") % 900 - 100, F.col("l_suppkey") % 300
    block = F.struct(F.lit("body").alias("label"), F.array(x, y, x + 150, y + 10).cast("array<int>").alias("bbox"), F.lit(0.9).alias("confidence"))
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_list(block).alias("blocks"))
    found = layout.crops(pages.select("document_id", F.lit(1).alias("page_number"), F.lit(600).alias("width"), F.lit(250).alias("height"), "blocks"))
    return found.select("document_id", *[F.col("bbox")[k].cast("bigint").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


_PAGES = "'# ' || c_name || chr(10) || 'lead' || chr(10) || '### Sub ' || c_nationkey || chr(10) || 'more' || chr(10) || '#### Bare' || chr(10) || '### T' || chr(10) || '| a |' || chr(10) || '|---|' || chr(10) || '| 1 |' || chr(10) || '## Two'"


@query(
    r"""
SELECT CAST(c_custkey AS VARCHAR) AS document_id, unnest([1, 1, 1, 1, 2])::BIGINT AS page_number, unnest([0, 1, 2, 3, 0])::BIGINT AS block_idx, unnest(['title', 'body', 'body', 'table', 'heading']) AS label,
  unnest([c_name, '', 'Sub ' || c_nationkey, 'T', 'Two']) AS title, unnest([c_name, 'lead', 'more', '| a |' || chr(10) || '|---|' || chr(10) || '| 1 |', 'Two']) AS raw_text FROM customer
"""
)
def blocks_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Titles, headings, parts between subheadings (bare ones go) and a table at the end."""
    pages = layout.markdown_pages(made(spark, sf, "customer", "c_custkey", _PAGES))
    return whole(layout.page_blocks(pages).drop("confidence"))


# Entities

_ENTITY_TEXT = "'Dr. Ann Lee met Widget' || chr(65 + CAST(c_custkey % 26 AS INT)) || ' Corp in New York on 2024-03-0' || (1 + c_custkey % 9) || '.'"


@query(
    r"""
WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS chunk_id, 'Widget' || chr(65 + CAST(c_custkey % 26 AS INT)) || ' Corp' AS org, '2024-03-0' || (1 + c_custkey % 9) AS day FROM customer)
SELECT chunk_id, unnest(['PERSON', 'ORG', 'LOCATION', 'DATE']) AS type, unnest(['Dr. Ann Lee', org, 'New York', day]) AS text, unnest([0, 16, 32, 44])::BIGINT AS start, unnest([11, 28, 40, 54])::BIGINT AS "end",
  unnest([sha256(chunk_id || '|PERSON|0'), sha256(chunk_id || '|ORG|16'), sha256(chunk_id || '|LOCATION|32'), sha256(chunk_id || '|DATE|44')]) AS id FROM e
"""
)
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Titled persons, organisations, places and dates with their spans."""
    chunks = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.expr(_ENTITY_TEXT).alias("text"))
    return whole(entities.extract(chunks))


@query(
    r"""
WITH t AS (SELECT DISTINCT chr(65 + CAST(c_custkey % 26 AS INT)) AS a, chr(65 + CAST(c_nationkey % 26 AS INT)) AS b FROM customer)
SELECT a || b AS acronym, a || 'lpha ' || b || 'eta' AS expansion FROM t
"""
)
def acronym_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Acronyms and the names with their initials."""
    t = table(spark, sf, "customer").selectExpr("chr(65 + CAST(c_custkey % 26 AS INT)) AS a", "chr(65 + CAST(c_nationkey % 26 AS INT)) AS b")
    texts = t.selectExpr("a || b AS text").unionByName(t.selectExpr("a || 'lpha ' || b || 'eta' AS text"))
    return entities.acronyms(texts)


@query("SELECT (SELECT count(*) FROM customer) AS total_chunks, (SELECT count(*) FROM nation) AS total_entities, (SELECT count(*) FROM supplier) AS total_relations")
def extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extraction_totals(*[table(spark, sf, t) for t in ("customer", "nation", "supplier")])


@query(
    r"""
SELECT 0 AS part, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="t" for="all" attr.name="type" attr.type="string"/><key id="x" for="node" attr.name="text" attr.type="string"/><graph edgedefault="directed">' AS value
UNION ALL SELECT 1, '<node id="n' || n_nationkey || '"><data key="t">LOCATION</data><data key="x">' || n_name || ' &lt;&amp;&gt;</data></node>' FROM nation
UNION ALL SELECT 2, '<edge source="n' || s_nationkey || '" target="n' || s_suppkey % 5 || '"><data key="t">PART_OF</data></edge>' FROM supplier
UNION ALL SELECT 3, '</graph></graphml>'
"""
)
def graph_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as nodes and suppliers as edges of a GraphML text."""
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("canonical_id"), F.concat("n_name", F.lit(" <&>")).alias("canonical_text"), F.lit("LOCATION").alias("type"))
    edges = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("head"), F.concat(F.lit("n"), F.col("s_suppkey") % 5).alias("tail"), F.lit("PART_OF").alias("type"))
    return entities.graphml(nodes, edges)


@query(
    r"""
WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer)
SELECT c AS chunk_id, unnest([sha256(c || '|PERSON|0'), sha256(c || '|ORG|16'), sha256(c || '|LOCATION|32')]) AS head, unnest([sha256(c || '|ORG|16'), sha256(c || '|LOCATION|32'), sha256(c || '|DATE|44')]) AS tail,
  unnest(['MENTIONS', 'LOCATED_IN', 'PUBLISHED_ON']) AS type FROM e
"""
)
def mention_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of neighbouring mentions by their types and the words between."""
    chunks = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.expr(_ENTITY_TEXT).alias("text"))
    return entities.relate(entities.extract(chunks), chunks)


@query(
    r"""
WITH r AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)
SELECT r_name || '.docx' AS document_id, 1::BIGINT AS pages, 1::BIGINT AS blocks, 5::BIGINT AS regions FROM r UNION ALL SELECT r_name || '.xlsx', 2, 2, 3 FROM r
"""
)
def block_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.block_counts(office.office_regions(office_files(spark, sf)))


@query(
    rf"""
WITH t AS (SELECT conv_id, list({strip_sql("text")} ORDER BY turn) AS x FROM conversations GROUP BY 1),
p AS (SELECT conv_id, list_concat(x, ['# Heading' || chr(10) || 'body of it', 'two words', 'Part one is a header', 'short one.']) AS x FROM t),
k AS (SELECT conv_id, x, list_filter(x, lambda p: NOT regexp_matches(p, '^(#{{1,6}}\s+\S.*|\d+[.)]\s+[A-Z]\S*.*|(Chapter|Section|Part|Appendix)\s+\S.*|[A-Z][A-Z ]{{3,60}})(\n|$)')
  AND (len(string_split_regex(p, '\s+')) > 3 OR regexp_matches(p, '[.!?]'))) AS kept FROM p),
c AS (SELECT conv_id, CASE WHEN len(kept) < 4 THEN 'paragraph' ELSE 'context' END AS method, CASE WHEN len(kept) < 4 THEN x ELSE kept END AS texts FROM k)
SELECT CAST(conv_id AS VARCHAR) AS document_id, generate_subscripts(texts, 1) - 1 AS chunk_index, method, unnest(texts) AS text FROM c
"""
)
def topic_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs that carry content: no headers, none of a few words; all of them where fewer than four are left."""
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    more = F.array(*map(F.lit, ("# Heading\nbody of it", "two words", "Part one is a header", "short one.")))
    docs = t.select("document_id", F.concat(F.transform("x", lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", "")), more).alias("paragraphs"))
    return whole(context.context_chunks(docs).select("document_id", "chunk_index", "method", "text"))


@query(
    r"""
WITH g AS (SELECT conv_id, role, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS merged, avg(length(text) % 10 / 10.0) AS s FROM conversations GROUP BY 1, 2)
SELECT conv_id AS document_id, role AS topic_id, row_number() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS place, n AS chunks, merged AS merged_text, round(s::DOUBLE, 4) AS similarity_score, 'context_merged' AS method FROM g
"""
)
def ordered_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Topic groups in order of their topic, with mean similarity and merged text."""
    t = table(spark, sf, "conversations")
    score = (F.length("text") % 10 / F.lit(10.0)).alias("similarity_score")
    chunks = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("topic_id"), "text", score, F.col("role").alias("topic_label"), F.array("role").alias("topic_words"), F.lit(1.0).alias("coherence_score"))
    return whole(context.in_order(context.context_groups(chunks)).select("document_id", "topic_id", "place", "chunks", "merged_text", "similarity_score", "method"))
