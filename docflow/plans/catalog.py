"""The registered queries of the library, on whole tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import detect
from docflow.functions.text import line_count, word_count
from docflow.operators import chunking, context, correct, entities, jobs, layout, mixed, packing, parsers
from docflow.plans.registry import CONVERSATIONS, ORACLES, QUERIES, conversations, documents, query, strip_sql, table, whole  # noqa: F401
from docflow.sources import ingest
from docflow.streaming import ingest_stream

# Chunking


@query(
    rf"""
WITH s AS (
  SELECT doc_id, flatten(list_transform(string_split({strip_sql("text")}, chr(10)),
    lambda l: string_split(regexp_replace({strip_sql("l")}, '([.!?])(\s+|$)', '\1' || chr(1), 'g'), chr(1)))) AS parts
  FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: {strip_sql("p")}), lambda p: p <> '') AS parts FROM s)
SELECT doc_id AS document_id, generate_subscripts(parts, 1) - 1 AS chunk_index, unnest(parts) AS text FROM f
"""
)
def chunk_line(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("document_id", chunking.segments_of_text(F.col("raw_text")).alias("segments"))
    return whole(chunking.chunk(docs, "line"), "document_id", "chunk_index", "text")


@query(
    rf"""
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n{{2,}}'), lambda p: {strip_sql("p")}), lambda p: p <> '') AS parts FROM documents)
SELECT doc_id AS document_id, generate_subscripts(parts, 1) - 1 AS chunk_index, unnest(parts) AS text FROM f
"""
)
def chunk_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("document_id", chunking.segments_of_text(F.replace("raw_text", F.lit("\n"), F.lit("\n\n"))).alias("segments"))
    return whole(chunking.chunk(docs, "paragraph"), "document_id", "chunk_index", "text")


@query(
    rf"""
WITH f AS (SELECT document_id, list_filter(list_transform(string_split(regexp_replace(raw_text, '(?m)^(#{{1,6}}\s+\S.*|\d+[.)]\s+[A-Z]\S*.*|(Chapter|Section|Part|Appendix)\s+\S.*|[A-Z][A-Z ]{{3,60}}$)$', chr(1) || '\0', 'g'), chr(1)), lambda p: {strip_sql("p")}), lambda p: p <> '') AS parts FROM {CONVERSATIONS})
SELECT document_id, generate_subscripts(parts, 1) - 1 AS chunk_index, unnest(parts) AS text FROM f
"""
)
def chunk_section(spark: SparkSession, sf: str) -> DataFrame:
    docs = conversations(spark, sf).select("document_id", chunking.segments_of_text(F.col("raw_text")).alias("segments"))
    return whole(chunking.chunk(docs, "section"), "document_id", "chunk_index", "text")


@query(
    rf"""
SELECT conv_id AS document_id, string_agg({strip_sql("text")}, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE {strip_sql("text")} <> '' GROUP BY conv_id
"""
)
def segments_join(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_idx"), F.col("role").alias("section_type"), F.col("text").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"))
    joined = chunking.segments_of_sections(turns)
    return joined.select("document_id", chunking.full_text(F.col("segments"))[0]["text"].alias("text"))


@query(
    r"""
SELECT document_id, floor((id) / 1)::BIGINT AS page_number, string_agg(text, chr(10) || chr(10) ORDER BY y0, x0, text) AS text FROM (
  SELECT conv_id AS document_id, turn // 2 AS id, (turn * 37) % 11 AS y0, length(text) % 7 AS x0, text FROM conversations WHERE trim(text) <> '')
GROUP BY document_id, id
"""
)
def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    box = F.array((F.length("text") % 7).cast("int"), ((F.col("turn") * 37) % 11).cast("int"))
    blocks = t.select(F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 2).alias("page_number"), box.alias("bbox"), "text")
    return chunking.page_chunks(blocks)


@query(
    r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, len(w) - 17), 112)) AS place FROM t WHERE len(w) > 0)
SELECT doc_id AS document_id, place // 112 AS chunk_index, array_to_string(w[place + 1 : place + 128], ' ') AS text FROM s
"""
)
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("document_id", F.posexplode(packing.windows(F.col("raw_text"), 128, 16)).alias("chunk_index", "text"))
    return whole(rows)


@query(
    r"""
SELECT conv_id AS document_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM conversations WHERE trim(text) <> '' GROUP BY conv_id
"""
)
def chunk_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Payload JSON of conversations, read back."""
    t = table(spark, sf, "conversations").filter(F.trim("text") != "")
    chunks = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.lit("x").alias("chunk_id"), F.lit("paragraph").alias("method"), "text", F.create_map().cast("map<string,string>").alias("metadata"))
    read = F.from_json("payload", "chunks array<struct<text:string>>, total_chunks bigint")
    sizes = F.aggregate(F.transform(F.col("p.chunks"), lambda c: F.length(c["text"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return chunking.payload(chunks).select("document_id", read.alias("p")).select("document_id", F.col("p.total_chunks").alias("chunks"), sizes.alias("characters"))


# Plain text and statistics


@query(
    r"""
SELECT doc_id AS document_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word_count, length(text) AS char_count, len(string_split(text, chr(10))) AS line_count FROM documents
"""
)
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("raw_text")
    return whole(documents(spark, sf).select("document_id", word_count(t).alias("word_count"), F.length(t).alias("char_count"), line_count(t).alias("line_count")))


@query(
    rf"""
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: {strip_sql("p")}), lambda p: p <> '') AS parts FROM documents),
r AS (SELECT doc_id::VARCHAR AS document_id, generate_subscripts(parts, 1) - 1 AS k, unnest(parts) AS content, len(parts) AS n FROM f)
SELECT document_id, k + CASE WHEN n > 1 THEN 1 ELSE 0 END AS section_idx, content, len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> ''))::BIGINT AS words FROM r
"""
)
def parse_plain(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(F.col("document_id").cast("string"), F.replace("raw_text", F.lit("\n"), F.lit("\n\n")).alias("raw_text"), "mime_type")
    found = parsers.parse(docs).filter("section_type = 'paragraph'")
    return whole(found.select("document_id", "section_idx", "content", F.element_at("metadata", "word_count").cast("bigint").alias("words")))


@query(
    r"""
WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2)
SELECT conv_id AS document_id, sum(n)::BIGINT AS sections, 'Sections: ' || string_agg(n || ' ' || role, ', ' ORDER BY first) AS kinds FROM c GROUP BY 1
"""
)
def section_summary(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_idx"), F.col("role").alias("section_type"))
    return parsers.summarise(turns)


# Detection and routing

_NAMES = [".txt", ".csv", ".json", ".html", ".md", ".pdf", ".docx", ".xlsx", ".png", ".unknown", ""]
_ROUTES = r"""
WITH n AS (SELECT doc_id, (['.txt', '.csv', '.json', '.html', '.md', '.pdf', '.docx', '.xlsx', '.png', '.unknown', ''])[(doc_id % 11 + 1)::INT] AS ext FROM documents),
f AS (SELECT doc_id, ext, CASE WHEN ext = '.txt' THEN 'text' WHEN ext IN ('.csv', '.json', '.html', '.md') THEN 'structured' WHEN ext IN ('.pdf', '.docx', '.xlsx') THEN 'document' WHEN ext = '.png' THEN 'image'
  WHEN regexp_matches(d.text, '[[:cntrl:]]') OR trim(d.text) = '' THEN 'unknown' ELSE 'text' END AS detected_format FROM n JOIN documents d USING (doc_id))
"""


def named_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files whose names take extensions in turn."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("file"), F.col("doc_id"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 11).cast("int")))
    return d.select(F.col("doc_id").cast("string").alias("document_id"), name.alias("source_name"), F.col("text").cast("binary").alias("raw_bytes"), F.lit(None).cast("string").alias("raw_text"))


@query(
    _ROUTES
    + r"""SELECT doc_id::VARCHAR AS document_id, detected_format, CASE WHEN detected_format IN ('text', 'structured') THEN 'text_handler' WHEN detected_format = 'unknown' THEN 'unknown_handler' ELSE 'binary_handler' END AS routing_target FROM f"""
)
def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest(named_files(spark, sf)).select("document_id", "detected_format", "routing_target")


@query(
    r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS rows FROM documents),
c AS (SELECT doc_id, len(rows)::BIGINT AS filled, len(list_filter(rows, lambda r: length(r) - length(replace(r, ',', '')) >= 2 OR length(r) - length(replace(r, chr(9), '')) >= 2 OR length(r) - length(replace(r, '|', '')) >= 2 OR length(r) - length(replace(r, ';', '')) >= 2))::BIGINT AS csv_rows FROM l)
SELECT doc_id AS document_id, filled, csv_rows, filled >= 2 AND csv_rows >= 0.8 * filled AS pure_csv FROM c
"""
)
def csv_like_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("raw_text")
    filled = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "")
    return whole(documents(spark, sf).select("document_id", F.size(filled).alias("filled"), F.size(F.filter(filled, detect.is_csv_like)).alias("csv_rows"), detect.is_pure_csv(t).alias("pure_csv")))


_PURE = r"""CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN '{"page": ' || CAST(page_id AS STRING) || '}' WHEN 2 THEN '<p><b><i></i></b></p><br><hr><em class=x></em>' || CAST(page_id AS STRING)
  WHEN 3 THEN 'plain words ' || CAST(page_id AS STRING) || ' <b>x</b> and more plain words' WHEN 4 THEN '<?xml version="1.0"?><a><b/><c/><d/></a>' ELSE '[1, "' || url || '"' END"""


@query(
    rf"""
WITH t AS (SELECT page_id, {_PURE} AS t FROM pages)
SELECT page_id, page_id % 6 IN (0, 2) AS pure_html, page_id % 6 = 1 AS pure_json, lower(substr(t, 1, 9)) = '<!doctype' AS doctype FROM t
"""
)
def pure_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, JSON objects, bare tags, prose with a tag, XML and broken JSON, in turn."""
    t = F.col("t")
    texts = table(spark, sf, "pages").select("page_id", F.expr(_PURE).alias("t"))
    return texts.select("page_id", detect.is_pure_html(t).alias("pure_html"), detect.is_pure_json(t).alias("pure_json"), F.lower(F.substring(t, 1, 9)).eqNullSafe("<!doctype").alias("doctype"))


@query(
    r"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' ELSE '.bin' END AS suffix FROM events
"""
)
def magic_suffix(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.array(F.lit("255044462D312E37"), F.lit("89504E470D0A1A0A"), F.lit("FFD8FFE000104A46"), F.lit("504B030414000600"))
    content = F.unhex(F.get(heads, (F.col("event_id") % 4).cast("int")))
    return table(spark, sf, "events").select("event_id", ingest.magic_suffix(content).alias("suffix"))


@query(
    _ROUTES
    + r""", r AS (SELECT CASE WHEN detected_format = 'unknown' OR ext IN ('.docx', '.xlsx', '.pdf', '.png') THEN 'failed' ELSE 'success' END AS status FROM f)
SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'success') AS processed_files, count(*) FILTER (WHERE status <> 'success') AS failed_files, round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 2)::DOUBLE AS success_rate, 100.0::DOUBLE AS progress, 'completed' AS status FROM r"""
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Texts under the names of office files, PDFs and images are broken files; the rest succeed or have no route."""
    return jobs.batch(named_files(spark, sf))[1]


# JSON and CSV


@query(
    r"""
SELECT event_id::VARCHAR AS document_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
"""
)
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """One group per path of each event's properties."""
    docs = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("document_id"), F.col("props").alias("raw_text"), F.lit("application/json").alias("mime_type"))
    found = parsers.parse(docs).filter("section_type = 'json_group'")
    path = F.element_at("metadata", "group_name")
    return found.select("document_id", path.alias("path"), F.substring(F.col("content"), F.length(path) + 3, F.length("content")).alias("value"))


@query(
    r"""
SELECT event_id::VARCHAR AS document_id, len(json_keys(props))::BIGINT AS total_keys, 0::BIGINT AS total_arrays, 1::BIGINT AS total_objects, CASE WHEN len(json_keys(props)) > 0 THEN 1 ELSE 0 END::BIGINT AS max_depth FROM events
"""
)
def json_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("document_id"), F.col("props").alias("raw_text"), F.lit("application/json").alias("mime_type"))
    found = parsers.parse(docs).filter("section_type = 'summary'")
    return found.select("document_id", *[F.element_at("metadata", c).cast("bigint").alias(c) for c in ("total_keys", "total_arrays", "total_objects", "max_depth")])


@query(
    r"""
WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS row_index, 'line: ' || l_linenumber || ' | flag: ' || l_returnflag || ' | status: ' || l_linestatus || ' | part: ' || l_partkey AS content FROM lineitem)
SELECT l_orderkey::VARCHAR AS document_id, row_index, content FROM r
"""
)
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV texts of their lines, parsed."""
    line = F.concat_ws(",", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")
    listed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t")))).alias("rows"))
    text = F.concat(F.lit("line,flag,status,part\n"), F.array_join(F.transform("rows", lambda x: x["t"]), "\n"))
    docs = listed.select(F.col("l_orderkey").cast("string").alias("document_id"), text.alias("raw_text"), F.lit("text/csv").alias("mime_type"))
    found = parsers.parse(docs).filter("section_type = 'data_row'")
    return found.select("document_id", F.element_at("metadata", "row_index").cast("bigint").alias("row_index"), "content")


# HTML and Markdown


@query(
    r"""
SELECT page_id::VARCHAR AS document_id, count(*) FILTER (WHERE k = 'title') AS titles, count(*) FILTER (WHERE k = 'li') AS items FROM (
  SELECT page_id, 'title' AS k FROM pages WHERE regexp_matches(html, '<title>[^<]*\S[^<]*</title>')
  UNION ALL SELECT page_id, 'li' FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li[ >]')) FROM pages)
  UNION ALL SELECT page_id, 'none' FROM pages) GROUP BY 1
"""
)
def html_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("raw_text"), F.lit("text/html").alias("mime_type"))
    found = parsers.parse(docs)
    items = F.coalesce(F.sum(F.when(F.col("section_type") == "list", F.element_at("metadata", "item_count").cast("bigint"))), F.lit(0))
    return found.groupBy("document_id").agg(F.count(F.when(F.col("section_type") == "title", 1)).alias("titles"), items.alias("items"))


@query()
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("raw_text"), F.lit("text/html").alias("mime_type"))
    return parsers.parse(docs).select("document_id", "section_idx", "section_type", "content")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_stripped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", layout.strip_html(F.col("html")).alias("text"))


@query(
    r"""
SELECT conv_id::VARCHAR AS document_id, role AS header, count(*) AS sections FROM conversations GROUP BY 1, 2
"""
)
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    docs = conversations(spark, sf).withColumn("document_id", F.col("document_id").cast("string"))
    found = parsers.parse(docs).filter("section_type = 'header_h2'")
    return found.groupBy("document_id", F.element_at("metadata", "header_text").alias("header")).agg(F.count(F.lit(1)).alias("sections"))


@query(
    rf"""
WITH p AS (SELECT document_id, list_filter(list_transform(string_split(regexp_replace(chr(10) || {strip_sql("raw_text")}, '\n(#{{1,2}} )', chr(1) || '\1', 'g'), chr(1)), lambda x: {strip_sql("x")}), lambda x: x <> '') AS parts FROM {CONVERSATIONS})
SELECT document_id, generate_subscripts(parts, 1) AS page_number, unnest(parts) AS text FROM p
"""
)
def markdown_pages(spark: SparkSession, sf: str) -> DataFrame:
    return whole(layout.markdown_pages(conversations(spark, sf)))


@query(
    rf"""
SELECT conv_id::VARCHAR AS document_id, count(*) AS blocks, count(DISTINCT role) AS titles FROM conversations GROUP BY 1
"""
)
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = layout.page_blocks(layout.markdown_pages(conversations(spark, sf)))
    heads = blocks.filter("label = 'heading'")
    return heads.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("title").alias("titles"))


# Regions


@query(
    r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  trim(line) <> '' AND (length(line) - length(replace(line, ',', '')) >= 2 OR length(line) - length(replace(line, chr(9), '')) >= 2 OR length(line) - length(replace(line, '|', '')) >= 2 OR length(line) - length(replace(line, ';', '')) >= 2) AS c FROM l),
g AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS island FROM o WHERE c)
SELECT doc_id AS document_id, min(place)::BIGINT AS start, sum(length(line) + 1)::BIGINT + min(place)::BIGINT AS "end", count(*) AS rows, string_agg(line, chr(10) ORDER BY ln) AS content
FROM g GROUP BY doc_id, island HAVING count(*) >= 3
"""
)
def csv_islands(spark: SparkSession, sf: str) -> DataFrame:
    return whole(mixed.csv_islands(documents(spark, sf)), "document_id", "start", "end", "rows", "content")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of users' events: starts over 400, lengths to 30, confidences in tenths."""
    e = table(spark, sf, "events")
    start = (F.col("event_id") * 37) % 400
    end = start + 1 + (F.col("event_id") * 13) % 30
    return e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("format"), F.lit(0).alias("rank"), F.col("event_id").cast("int").alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), ((F.col("event_id") * 7) % 10 / 10.0).alias("confidence"), F.lit("").alias("content"))


@query(
    r"""
WITH r AS (SELECT user_id, (event_id * 37) % 400 AS s, (event_id * 37) % 400 + 1 + (event_id * 13) % 30 AS e FROM events),
m AS (SELECT user_id, s, e FROM r UNION ALL SELECT DISTINCT user_id, 430, 430 FROM r),
g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM m)
SELECT user_id AS document_id, place AS start, s AS "end", s - place AS size FROM g WHERE s > place
"""
)
def text_gaps(spark: SparkSession, sf: str) -> DataFrame:
    marks = regions(spark, sf).select("document_id", "start", "end")
    docs = marks.select("document_id").distinct().withColumn("raw_text", F.expr("repeat('x', 430)"))
    return whole(mixed.text_gaps(docs, marks).select("document_id", "start", "end", F.length("content").alias("size")))


# Layout


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as blocks on pages of 1000: three columns, heights by part."""
    li = table(spark, sf, "lineitem")
    x = (F.col("l_partkey") % 3) * 300 + F.col("l_suppkey") % 20
    y = F.col("l_partkey") % 997
    box = F.array(x, y, x + 200, y + 10).cast("array<int>")
    return li.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("line"), box.alias("bbox"), F.lit(1000).alias("page_width"))


@query(
    r"""
WITH b AS (SELECT l_orderkey AS document_id, l_linenumber AS line, (l_partkey % 3) * 300 + l_suppkey % 20 AS x0, l_partkey % 997 AS y0 FROM lineitem),
g AS (SELECT *, (x0 + x0 + 200) / 2.0 AS c FROM b),
s AS (SELECT *, coalesce(c - lag(c) OVER (PARTITION BY document_id ORDER BY c) > 80, true) AS begins FROM g),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY document_id ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS col FROM s)
SELECT document_id, line, col::BIGINT AS col, count(*) OVER (PARTITION BY document_id, col) AS in_column FROM n
"""
)
def reading_columns(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    placed = layout.reading_order(boxes(spark, sf))
    count = F.count(F.lit(1)).over(Window.partitionBy("document_id", "page_number", "col"))
    return whole(placed.select("document_id", "line", "col", count.alias("in_column")))


@query(
    r"""
WITH b AS (SELECT event_id, event_id % 1001 AS a, (event_id * 7) % 1001 AS b, event_id % 200 AS c FROM events)
SELECT event_id, trunc(a * 1240.0 / CASE WHEN greatest(a, b, c) > 224 THEN 1000 ELSE 224 END)::BIGINT AS x0, trunc(b * 1754.0 / CASE WHEN greatest(a, b, c) > 224 THEN 1000 ELSE 224 END)::BIGINT AS y0, least(greatest(0, a - 500), 300)::BIGINT AS cx, least(greatest(0, b - 500), 200)::BIGINT AS cy FROM b
"""
)
def boxes_scaled(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    a, b, c = F.col("event_id") % 1001, (F.col("event_id") * 7) % 1001, F.col("event_id") % 200
    scaled = layout.scale_box(F.array(a, b, c, c), F.lit(1240), F.lit(1754))
    clamped = layout.clamp_box(F.array(a - 500, b - 500, c, c), F.lit(300), F.lit(200))
    return whole(e.select("event_id", scaled[0].alias("x0"), scaled[1].alias("y0"), clamped[0].alias("cx"), clamped[1].alias("cy")))


@query(
    r"""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS blocks FROM events
"""
)
def model_blocks(spark: SparkSession, sf: str) -> DataFrame:
    good, other = '{"label":"title","bbox":[1,2,3,4]}', '{"label":"body","bbox":[1,2]}'
    outputs = F.array(F.lit(f"[{good},{good}]"), F.lit(f"Here: [{good},{other}] done"), F.lit("nothing"))
    text = F.get(outputs, (F.col("event_id") % 3).cast("int"))
    return whole(table(spark, sf, "events").select("event_id", F.size(layout.model_blocks(text)).alias("blocks")))


# Topics


@query(
    r"""
WITH l AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim, round(avg(x), 6) + 0.0 AS m FROM l GROUP BY 1, 2
"""
)
def topic_centroids(spark: SparkSession, sf: str) -> DataFrame:
    found = context.centroids(table(spark, sf, "embeddings"), "label")
    rows = found.select(F.col("label"), F.posexplode("centroid").alias("dim", "m"))
    return rows.select("label", F.col("dim").cast("bigint").alias("dim"), (F.round("m", 6) + F.lit(0.0)).alias("m"))


_SIMILARITY = r"""
WITH l AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, list(m ORDER BY dim) AS centroid FROM (SELECT label, dim, avg(x) AS m FROM l GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, e.label, round(list_dot_product(embedding::DOUBLE[], centroid), 3) + 0.0 AS similarity_score FROM embeddings e JOIN c ON e.label = c.label)
"""


@query(_SIMILARITY + "SELECT vec_id, label, similarity_score FROM s")
def topic_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return context.topic_similarity(table(spark, sf, "embeddings"), "label", digits=3).select("vec_id", "label", "similarity_score")


@query(
    _SIMILARITY
    + r"""SELECT label, CASE WHEN similarity_score >= 0.55 THEN 'strong' WHEN similarity_score >= 0.30 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN similarity_score * 100 >= 70 THEN 'high' WHEN similarity_score * 100 >= 40 THEN 'medium' ELSE 'low' END AS badge, count(*) AS chunks FROM s GROUP BY 1, 2, 3"""
)
def similarity_buckets(spark: SparkSession, sf: str) -> DataFrame:
    s = context.topic_similarity(table(spark, sf, "embeddings"), "label", digits=3)
    score = F.col("similarity_score")
    return s.groupBy("label", context.strength(score).alias("strength"), context.badge(score).alias("badge")).agg(F.count(F.lit(1)).alias("chunks"))


@query(
    r"""
SELECT conv_id AS document_id, role AS topic, count(*) AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS merged_text FROM conversations GROUP BY 1, 2
"""
)
def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    chunks = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("topic_id"), "text", F.lit(1.0).alias("similarity_score"), F.col("role").alias("topic_label"), F.array().cast("array<string>").alias("topic_words"), F.lit(1.0).alias("coherence_score"))
    return whole(context.context_groups(chunks).select("document_id", F.col("topic_id").alias("topic"), "chunks", "merged_text"))


_STOP = ", ".join(f"'{w}'" for w in sorted(context.STOP_WORDS))


@query(
    rf"""
WITH l AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOP})) AS w FROM documents),
u AS (SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM l),
c AS (SELECT lang, term, count(*) AS tf FROM u GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 500),
n AS (SELECT count(DISTINCT lang) AS n FROM documents),
x AS (SELECT lang, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM c JOIN d USING (term), n),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w DESC, term) AS place, sqrt(sum(w * w) OVER (PARTITION BY lang)) AS norm FROM x)
SELECT lang, term, round((w / norm)::DOUBLE, 6) AS weight, place FROM r WHERE place <= 6
"""
)
def topic_keywords(spark: SparkSession, sf: str) -> DataFrame:
    found = context.term_weights(table(spark, sf, "documents"), "lang", "text")
    return whole(found.select("lang", "term", F.round("weight", 6).alias("weight"), "place"))


@query()
def context_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic chunks of all documents, their lines as paragraphs."""
    docs = documents(spark, sf).select(F.col("document_id").cast("string"), chunking.paragraphs(F.replace("raw_text", F.lit("\n"), F.lit("\n\n"))).alias("paragraphs"))
    return context.context_chunks(docs).select("document_id", "chunk_index", "topic_id", "topic_label", "similarity_score", "coherence_score")


# Search and export


@query(r"SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the ') OR contains(lower(role), 'the ')")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("raw_text"), F.col("role").alias("title"))
    return layout.search_blocks(blocks, "The ").select("conv_id", "turn")


@query(
    r"""
SELECT conv_id AS document_id, string_agg('=== ' || upper(role) || ' SECTION ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1
"""
)
def text_export(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_idx"), F.col("role").alias("section_type"), F.col("text").alias("content"))
    return jobs.text_export(turns)


@query(
    r"""
SELECT conv_id AS document_id, string_agg('=== PAGE ' || (turn + 1) || ' ===' || chr(10) || '[' || upper(role) || '] ' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1
"""
)
def page_export(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page_number"), F.lit(0).alias("block_idx"), F.col("role").alias("label"), F.lit("").alias("title"), F.col("text").alias("raw_text"))
    return jobs.page_export(turns)


# Correction and entities


@query(
    r"""
WITH t AS (SELECT doc_id, replace(replace(text, 'o', '0'), 'I', '1') AS noisy FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(noisy, '(^|[^\p{L}\p{N}_])0([A-Za-z])', '\1O\2', 'g'), '([A-Za-z])0([^\p{L}\p{N}_]|$)', '\1o\2', 'g'), '(^|[^\p{L}\p{N}_])1([A-Za-z])', '\1I\2', 'g'), '([A-Za-z])1([^\p{L}\p{N}_]|$)', '\1l\2', 'g') AS fixed FROM t
"""
)
def ocr_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on every whole text, made noisy."""
    noisy = F.replace(F.replace("text", F.lit("o"), F.lit("0")), F.lit("I"), F.lit("1"))
    return table(spark, sf, "documents").select("doc_id", correct.ocr_rules(noisy).alias("fixed"))


@query(
    r"""
WITH d AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY 1),
u AS (SELECT DISTINCT word FROM (SELECT word[2:] AS word FROM d) WHERE word <> '' AND word NOT IN (SELECT word FROM d)),
m AS (SELECT u.word, d.word AS correction, d.frequency, levenshtein(u.word, d.word) AS distance FROM u, d WHERE abs(length(u.word) - length(d.word)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, frequency DESC, correction) AS n FROM m WHERE distance <= 2)
SELECT word, correction, distance FROM r WHERE n = 1
"""
)
def dictionary_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark without their first letter, corrected by its own dictionary."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    dictionary = words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    cut = dictionary.select(F.substring("word", 2, 100).alias("word"))
    return whole(correct.dictionary_corrections(cut, dictionary))


@query(
    r"""
SELECT c_mktsegment || ':' || substr(lower(c_name), 1, 3) AS block, count(*) AS entities FROM customer GROUP BY 1
"""
)
def entity_blocks(spark: SparkSession, sf: str) -> DataFrame:
    key = entities.block_key(F.col("c_mktsegment"), F.col("c_name"))
    return table(spark, sf, "customer").groupBy(key.alias("block")).agg(F.count(F.lit(1)).alias("entities"))


@query(
    r"""
SELECT DISTINCT s.n_name AS head, c.n_name AS tail, 'MENTIONS' AS type
FROM supplier JOIN nation s ON s_nationkey = s.n_nationkey JOIN customer ON c_custkey % 10 = s_suppkey % 10 JOIN nation c ON c_nationkey = c.n_nationkey WHERE s.n_name <> c.n_name
"""
)
def relation_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of suppliers and customers that share a last digit, rewritten to their nations."""
    s, c, n = (table(spark, sf, t) for t in ("supplier", "customer", "nation"))
    heads = s.select((F.col("s_suppkey") % 10).alias("k"), F.concat(F.lit("n"), "s_nationkey").alias("head")).distinct()
    tails = c.select((F.col("c_custkey") % 10).alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("tail")).distinct()
    relations = heads.join(tails, "k").select("head", "tail", F.lit("MENTIONS").alias("type"))
    canonical = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("canonical_id"))
    return entities.rewrite_relations(relations, canonical)


#: Part names, in plural, in capitals, with a comma.
_PRODUCT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN upper(p_name) ELSE replace(p_name, ' ', ', ') END"


@query(
    rf"""
WITH RECURSIVE t AS (SELECT {_PRODUCT} AS text, count(*) AS frequency, list_sort(list_distinct(regexp_extract_all(lower({_PRODUCT}), '\w+'))) AS w FROM part GROUP BY 1, 3),
p AS (SELECT l.text AS a, r.text AS b, list_filter(l.w, lambda x: list_contains(r.w, x)) AS bo, list_filter(l.w, lambda x: NOT list_contains(r.w, x)) AS lo, list_filter(r.w, lambda x: NOT list_contains(l.w, x)) AS ro
  FROM t l JOIN t r ON substr(lower(l.text), 1, 3) = substr(lower(r.text), 1, 3) AND l.text < r.text),
s AS (SELECT a, b, array_to_string(bo, ' ') AS x0, array_to_string(list_concat(bo, lo), ' ') AS x1, array_to_string(list_concat(bo, ro), ' ') AS x2 FROM p),
q AS (SELECT a, b, x1 AS x, x2 AS y FROM s UNION SELECT a, b, x0, x1 FROM s WHERE x0 <> '' UNION SELECT a, b, x0, x2 FROM s WHERE x0 <> ''),
d AS (SELECT a, b, x, y, 0::BIGINT AS i, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) AS cells FROM q
  UNION ALL
  SELECT a, b, x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 ELSE greatest(cells[k], cells[k - 1] + CASE WHEN y[k - 1] = x[i + 1] THEN 1 ELSE 0 END) END))) FROM d WHERE i < length(x)),
l AS (SELECT a, b FROM d WHERE i = length(x) GROUP BY a, b HAVING max(200.0 * cells[length(y) + 1] / (length(x) + length(y))) >= CASE WHEN length(a) <= 6 OR length(b) <= 6 THEN 92 ELSE 88 END),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
g AS (SELECT text, text AS root FROM t UNION SELECT e.a, g.root FROM g JOIN e ON g.text = e.b),
m AS (SELECT g.text, g.root, row_number() OVER (PARTITION BY g.text ORDER BY r.frequency DESC, length(g.root) DESC, g.root) AS n FROM g JOIN t r ON r.text = g.root)
SELECT 'PRODUCT' AS type, m.text, t.frequency, m.root AS canonical_text, sha256('PRODUCT|' || m.root) AS canonical_id FROM m JOIN t ON m.text = t.text WHERE n = 1
"""
)
def entities_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in four spellings as products, merged."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.expr(_PRODUCT).alias("text"), F.lit("PRODUCT").alias("type"))
    return entities.canonical_entities(parts)


# Events in sessions


@query(
    r"""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, before ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, count(*) AS events FROM s GROUP BY user_id, n
"""
)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming session operator on the table as a batch."""
    return ingest_stream.sessions(table(spark, sf, "events")).select("user_id", "events")
