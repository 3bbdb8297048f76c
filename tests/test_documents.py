"""Ingestion, office files, layout, chunking, topics, correction, entities, jobs, streaming."""

import io
import json
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.functions import detect
from docflow.functions import text as text_fns
from docflow.operators import chunking, components, context, correct, entities, jobs, layout, office, packing, pdf
from docflow.plans import catalog
from docflow.sources import ingest
from docflow.streaming import ingest_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    def p(text, style=None):
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"

    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("Top", "Heading1") + p("First words") + p("item", "ListBullet") + f"<w:tbl>{row('h', 'i')}{row('', '')}{row('1', '2')}</w:tbl>" + p("Sub", "Heading2") + p("Last")
    styles = '<w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style>'
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"})


def xlsx(rows=14):
    sheet = "".join(f'<row r="{k}"><c r="B{k}" t="inlineStr"><is><t>n{k}</t></is></c><c r="C{k}"><v>{k}</v></c></row>' for k in range(2, rows + 2))
    one = f'<worksheet {S}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>{sheet}<row r="30"><c r="C30"><f>SUM(C2:C15)</f><v>9</v></c></row></sheetData></worksheet>'
    return archive(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Data" sheetId="1" r:id="r1"/><sheet name="None" sheetId="2" r:id="r2"/></sheets><definedNames><definedName name="x">Data!$A$1</definedName></definedNames></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>",
            "xl/worksheets/sheet1.xml": one,
            "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData></worksheet>',
        }
    )


MIXED = "Here are some words to begin the text with.\n\n```python\nprint('hello world')\n```\n\n{\"key\": [1, 2, 3], \"other\": \"value\"}\n\nAnd words to end the text with, too."


@pytest.fixture(scope="module")
def files(spark):
    return ingest.from_bytes(
        spark,
        [
            ("a.txt", b"plain words"), ("b.csv", b"x,y,z\n1,2,3\n"), ("c.json", b'{"a": 1}'), ("d.md", b"# T\n\ntext"), ("e.docx", docx()), ("f.xlsx", xlsx()),
            ("g.docx", b"broken"), ("noext", b"a printable line"), ("lines", b"two\nlines"), ("h.webp", b"RIFF"), ("i.html", MIXED.encode()), ("latin.txt", b"caf\xe9"), ("bom.txt", b"\xef\xbb\xbfhi"),
        ],
    )


def test_formats_routes_and_encodings(files):
    found = {r.source_name: r for r in ingest.ingest(files).collect()}
    assert {n: (r.detected_format, r.routing_target) for n, r in found.items()} == {
        "a.txt": ("text", "text_handler"), "b.csv": ("structured", "text_handler"), "c.json": ("structured", "text_handler"), "d.md": ("structured", "text_handler"),
        "e.docx": ("document", "binary_handler"), "f.xlsx": ("document", "binary_handler"), "g.docx": ("document", "binary_handler"), "noext": ("text", "text_handler"),
        "lines": ("unknown", "unknown_handler"), "h.webp": ("image", "binary_handler"), "i.html": ("mixed", "mixed_handler"), "latin.txt": ("text", "text_handler"), "bom.txt": ("text", "text_handler"),
    }
    assert found["latin.txt"].encoding == "cp1252" and found["latin.txt"].raw_text == "café" and found["bom.txt"].raw_text == "hi"
    assert found["a.txt"].file_size == 11 and all(r.error is None for r in found.values())


def test_cp1252_and_other_encodings_whole(spark):
    text = "café naïve “quoted” – 5 € Œuvre"
    rows = [("a.txt", text.encode("cp1252")), ("b.txt", text.encode()), ("c.txt", b"\xff\xfe" + text.encode("utf-16-le")), ("d.txt", b"\xfe\xff" + text.encode("utf-16-be")), ("e.txt", b"\xef\xbb\xbf" + text.encode())]
    assert {r.raw_text for r in ingest.ingest(ingest.from_bytes(spark, rows)).collect()} == {text}
    gap = ingest.ingest(ingest.from_bytes(spark, [("f.txt", b"\x81\xe9")])).first()
    assert gap.raw_text == "\ufffdé" and gap.language is None and gap.extraction_method == "byte_decode"


def test_xml_indicators(spark):
    """A declaration counts by itself, whatever HTML stands elsewhere; known tags are bare."""
    prose = " words of plain prose that go on" * 5
    texts = ['<?xml version="1.0"?> and <b class="x">bold</b>' + prose, '<item class="x">bold</item>' + prose, "<host>db</host> and <i>one</i>" + prose, '<host id="1">db</host>' + prose]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(*[c.alias(n) for n, c in detect.mixed_indicators(F.col("t")).items()], detect.is_mixed(F.col("t")).alias("mixed")).collect()
    assert [(r.xml, r.html, r.mixed) for r in found] == [(True, True, True), (False, True, False), (True, True, True), (False, True, False)]


def small_pdf(*pages, compress=True):
    """A PDF of the pages' operators, with a map from codes to characters for font F2."""
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <20AC> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    parts = [b"1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj", b"2 0 obj<</Type/Pages/Kids[%s]/Resources<</Font<</F1 3 0 R/F2 4 0 R>>/XObject<</X 6 0 R>>>>>>endobj" % kids.encode()]
    parts += [b"3 0 obj<</Type/Font/Subtype/Type1>>endobj", b"4 0 obj<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>endobj", b"5 0 obj<</Length %d>>stream\n%s\nendstream endobj" % (len(cmap), cmap)]
    form = b"BT (in a form) Tj ET"
    parts.append(b"6 0 obj<</Subtype/Form/Length %d>>stream\n%s\nendstream endobj" % (len(form), form))
    for k, page in enumerate(pages):
        data = zlib.compress(page) if compress else page
        parts.append(b"%d 0 obj<</Type/Page/Parent 2 0 R/Contents %d 0 R>>endobj" % (10 + 2 * k, 11 + 2 * k))
        parts.append(b"%d 0 obj<</Length %d%s>>stream\n%s\nendstream endobj" % (11 + 2 * k, len(data), b"/Filter/FlateDecode" if compress else b"", data))
    return b"%PDF-1.5\n" + b"\n".join(parts) + b"\ntrailer<</Root 1 0 R>>"


def test_text_of_pdf_pages():
    first = rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\) w\366rld) Tj 0 -14 Td [(sec) -300 (ond) 20 (line)] TJ T* <48 6> Tj /F2 9 Tf <00010002> Tj ET q /X Do Q BI /W 1 ID (\x00) EI"
    data = small_pdf(first, b"BT (two) Tj ET")
    assert pdf.read_pages(data) == [("Hello (PDF) wörld\nsec ondline\nH`€a\nin a form", 0.9), ("two", 0.9)]
    assert pdf.read_pages(small_pdf(b"BT (plain) Tj ET", compress=False)) == [("plain", 0.9)]
    broken = data.replace(b"/Filter/FlateDecode", b"/Filter/LZWDecode  ", 1)
    assert [c for _, c in pdf.read_pages(broken)] == [0.0, 0.9] and pdf.read_pages(broken)[0][0].startswith("[Error extracting page 1: no filter")
    assert not pdf.is_text_pdf(data) and pdf.is_text_pdf(small_pdf(b"BT (%s) Tj ET" % (b"word " * 40))) and not pdf.is_text_pdf(b"no")
    for bad in (b"", b"no pdf", b"%PDF-1.4 /Encrypt 9 0 R"):
        with pytest.raises(pdf.PdfError):
            pdf.read_pages(bad)
    with pytest.raises(pdf.PdfError):
        pdf.engine(small_pdf(b"q Q"))


def test_objects_in_streams_and_predictors():
    packed = zlib.compress(b"".join(bytes([2]) + bytes(b - a & 255 for a, b in zip(x, y)) for x, y in [(b"\0\0\0", b"1 0"), (b"1 0", b" <<"), (b" <<", b">> ")]))
    assert pdf._predicted(zlib.decompress(packed), 3) == b"1 0 <<>> "
    inner = b"7 0 8 35 <</Type/Catalog/Pages 8 0 R        >><</Kids[9 0 R]/Type/Pages>>"
    first = inner.index(b"<<")
    body = zlib.compress(b"7 0 8 %d " % (inner.index(b"<</Kids") - first) + inner[first:])
    head = len(b"7 0 8 %d " % (inner.index(b"<</Kids") - first))
    page = b"9 0 obj<</Type/Page/Contents 10 0 R>>endobj 10 0 obj<</Filter/ASCIIHexDecode/Length 11 0 R>>stream\n%s>\nendstream endobj 11 0 obj 29 endobj" % b"BT (x) Tj ET".hex().encode()
    assert pdf.read_pages(b"%%PDF-1.5\n3 0 obj<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj %s" % (head, len(body), body, page)) == [("x", 0.9)]


def test_pdfs_and_images_in_a_batch(spark):
    """A text layer gives pages; without one, or without an engine for images, a file has failed and says so."""
    png = b"\x89PNG\r\n\x1a\n" + bytes(20)
    rows = [("a.pdf", small_pdf(b"BT (page one) Tj ET", b"BT (page two) Tj ET")), ("b.pdf", b"junk"), ("c.png", png), ("d.pdf", small_pdf(b"q Q"))]
    found, summary = jobs.batch(ingest.from_bytes(spark, rows))
    by = {r.file_name: r for r in found.collect()}
    assert {n: r.status for n, r in by.items()} == {"a.pdf": "success", "b.pdf": "failed", "c.png": "failed", "d.pdf": "failed"}
    assert by["a.pdf"].sections == 2 and "no text layer" in by["d.pdf"].error_message and "no PDF header" in by["c.png"].error_message
    layout.register_engine("stub", lambda data: [[{"label": "title", "text": f"{len(data)} bytes", "confidence": 0.5}]])
    _, sections = jobs.process(ingest.from_bytes(spark, rows), ("pdf_text", "stub"))
    seen = {(r.section_type, r.content) for r in sections.collect()}
    assert seen == {("full_page", "page one"), ("full_page", "page two"), ("title", "4 bytes"), ("title", f"{len(png)} bytes"), ("title", f"{len(rows[3][1])} bytes")}


def test_pages_and_layouts_are_zipped_by_place(spark):
    pages = spark.createDataFrame([("d", 1, "p1"), ("d", 5, "p5"), ("d", 7, "p7"), ("e", 1, "q")], "document_id string, page_number int, image string")
    layouts = spark.createDataFrame([("d", 1, "l1"), ("d", 2, "l2"), ("f", 1, "x")], "document_id string, page_number int, layout string")
    assert sorted(tuple(r) for r in layout.zip_pages(pages, layouts).select("document_id", "page_number", "image", "layout").collect()) == [("d", 1, "p1", "l1"), ("d", 5, "p5", "l2")]
    block = "array<struct<label:string,bbox:array<int>,confidence:double>>"
    rows = [("d", 1, 100, 50, [("title", [-5, 2, 300, 20], 0.5), ("body", [200, 0, 210, 9], 0.5)]), ("d", 2, 100, 50, [])]
    found = layout.crops(spark.createDataFrame(rows, f"document_id string, page_number int, width int, height int, blocks {block}")).orderBy("page_number").collect()
    assert [(r.page_number, r.label, r.bbox) for r in found] == [(1, "title", [0, 2, 100, 20]), (2, "full_page", [0, 0, 100, 50])]


def test_marks_in_a_text_begin_no_section(spark):
    text = "one \x01 two \x02a \x02\n# Head\nbody \x01x"
    assert chunks(spark, "section", text) == [(0, 0, "one \x01 two \x02a \x02"), (0, 1, "# Head\nbody \x01x")]
    assert chunks(spark, "section", "no \x01 head") == [(0, 0, "no \x01 head")]


def test_texts_and_validation(spark):
    rows = [("direct_text_input", None, MIXED), ("direct_text_input", None, "words"), ("direct_text_input", None, ""), ("x.pdf", None, None)]
    found = ingest.ingest(spark.createDataFrame(rows, "source_name string, raw_bytes binary, raw_text string")).collect()
    assert [(r.detected_format, r.error) for r in found] == [("mixed", None), ("text", None), ("text", "Empty text input"), ("unknown", "Binary input missing bytes")]


@pytest.mark.parametrize("name,expected", [("a.TXT", ".txt"), (".bashrc", ""), ("x/y.tar.gz", ".gz"), ("none", ""), ("a.b/c", "")])
def test_extension(spark, name, expected):
    assert spark.range(1).select(ingest.extension(F.lit(name)).alias("e")).first().e == expected


def test_predicates(spark):
    rows = [("1", True, False), ('{"a": [1]}', True, False), ("a,b,c\nd,e,f", False, True), ("<html><p>x</p></html>", False, False), ("words", False, False)]
    found = spark.createDataFrame([(r[0],) for r in rows], "t string").select(detect.is_pure_json(F.col("t")).alias("j"), detect.is_pure_csv(F.col("t")).alias("c")).collect()
    assert [(r.j, r.c) for r in found] == [r[1:] for r in rows]
    one = spark.range(1).select(detect.is_pure_html(F.lit("<html><p>x</p></html>")).alias("h"), detect.is_printable(F.lit("a b")).alias("p"), detect.is_printable(F.lit("a\nb")).alias("q"), detect.language(F.lit("too short")).alias("l"), ingest.magic_suffix(F.lit(b"%PDF-1.7")).alias("m")).first()
    assert tuple(one) == (True, True, False, None, ".pdf")


def test_strip_lines_and_words_like_python(spark):
    texts = [" a\x1f　b \x85", "", "\n", "a\r\nb\rc\n", "x y", "\x1cq\x0b", "é  😀 z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(text_fns.strip(F.col("t")).alias("s"), text_fns.word_count(F.col("t")).alias("w"), text_fns.lines(F.col("t")).alias("l")).collect()
    assert [r.s for r in found] == [t.strip() for t in texts] and [r.w for r in found] == [len(t.split()) for t in texts]
    assert [r.l for r in found] == [t.replace("\r\n", "\n").replace("\r", "\n").splitlines() for t in texts]


def test_read_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "sub" / "b.csv").write_text("a,b\n1,2")
    assert {r.source_name for r in ingest.read_files(spark, str(tmp_path)).collect()} == {"a.md", "b.csv"}


def test_office_regions(spark):
    parts = [(r.kind, r.text) for b in office.docx_blocks(docx()) for r in b.regions]
    assert parts == [("heading", "Top"), ("content", "First words\n• item"), ("heading", "Sub"), ("content", "Last"), ("table", "h | i\n" + "-" * 50 + "\n1 | 2")]
    assert office.structured_text(office.read_docx(docx())) == "# Top\nFirst words\n• item\n[TABLE]\n## Sub\nLast"
    data, empty = office.xlsx_blocks(xlsx())
    assert [r.kind for r in data.regions] == ["table", "formulas"] and [r.kind for r in empty.regions] == ["empty"]
    assert data.regions[0].text.endswith("... (5 more rows)") and data.regions[1].text == "C30: =SUM(C2:C15)"
    assert data.metadata["total_sheets"] == 2 and data.metadata["named_ranges"] == 1 and office.column_name(703) == "AAA"
    rows = office.office_regions(spark.createDataFrame([("x", "xlsx", bytearray(xlsx())), ("y", "docx", bytearray(b"no"))], "document_id string, kind string, raw_bytes binary")).collect()
    assert sum(r.document_id == "x" for r in rows) == 3 and next(r for r in rows if r.document_id == "y").error.startswith("BadZipFile")


def test_batch_results_and_exports(spark, files, tmp_path):
    found, summary = jobs.batch(files, str(tmp_path / "job"))
    by = {r.file_name: r.status for r in found.collect()}
    assert [n for n, s in by.items() if s == "failed"] == [n for n in by if n in ("g.docx", "lines", "h.webp")]
    one = summary.first()
    assert (one.total_files, one.processed_files, one.failed_files) == (13, 10, 3)
    assert (tmp_path / "job" / "summary").exists()
    documents, sections = jobs.process(files)
    text = {r.document_id: r.text for r in jobs.text_export(sections).collect()}
    assert any(t.startswith("=== HEADER SECTION ===\nCSV Headers: x | y | z") for t in text.values())
    for r in jobs.document_json(documents, sections).collect():
        assert "sections" in json.loads(r.json)
    few = sections.groupBy("document_id").count().filter("count <= 5").agg({"count": "sum"}).first()[0]
    assert jobs.search_sections(sections, "PLAIN").count() == few and jobs.search_sections(sections, "PLAIN", least=0).count() == 1 and jobs.table_view(found).columns[1] == "document"
    jobs.write_texts(jobs.text_export(sections), str(tmp_path / "texts"))


def segments(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "document_id long, t string").select("document_id", chunking.segments_of_text(F.col("t")).alias("segments"))


def chunks(spark, method, *texts):
    return [(r.document_id, r.chunk_index, r.text) for r in chunking.chunk(segments(spark, *texts), method).orderBy("document_id", "chunk_index").collect()]


def test_chunk_methods(spark):
    assert chunks(spark, "line", "One. Two!  Three\nFour? ", " ") == [(0, 0, "One."), (0, 1, "Two!"), (0, 2, "Three"), (0, 3, "Four?")]
    assert chunks(spark, "paragraph", "a\n\n\nb\n \nc") == [(0, 0, "a"), (0, 1, "b\n \nc")]
    text = "before\n## One\nx\n2. Two things\ny\nINTRODUCTION\nz"
    assert chunks(spark, "section", text, "a\n\nb") == [(0, 0, "before"), (0, 1, "## One\nx"), (0, 2, "2. Two things\ny"), (0, 3, "INTRODUCTION\nz"), (1, 0, "a"), (1, 1, "b")]
    found = chunking.chunk(segments(spark, text), "section").collect()
    assert [r.metadata["section_number"] for r in found] == ["0", "1", "2", "3"] and found[0].metadata["section_detected"] == "false"
    assert len({r.chunk_id for r in found}) == 4
    with pytest.raises(ValueError):
        chunking.chunk(segments(spark, "x"), "nothing")
    chunking.register_method("whole", lambda s: F.array(F.struct(s["text"].alias("text"), s["metadata"].alias("metadata"))))
    assert chunks(spark, "whole", "a b") == [(0, 0, "a b")]


def test_chunks_keep_every_character_but_space(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    for method in ("line", "paragraph", "section"):
        made = chunking.chunk(docs.select("document_id", chunking.segments_of_text(F.col("text")).alias("segments")), method)
        back = made.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"), F.max("chunk_index").alias("last"), F.count("*").alias("n"))
        bare = lambda c: F.regexp_replace(c, r"\s", "")
        joined = docs.join(back, "document_id").filter((bare(F.col("text")) != bare(F.array_join(F.transform("c", lambda x: x["text"]), ""))) | (F.col("last") != F.col("n") - 1))
        assert joined.count() == 0


def test_segments_payload_and_pages(spark):
    sections = spark.createDataFrame([("d", 1, "paragraph", "two", {}), ("d", 0, "paragraph", " one ", {}), ("d", 2, "summary", "no", {}), ("e", 0, "summary", "no", {})], "document_id string, section_idx int, section_type string, content string, metadata map<string,string>")
    raw = spark.createDataFrame([("d", "r"), ("e", "raw")], "document_id string, raw_text string")
    found = {r.document_id: [s.text for s in r.segments] for r in chunking.segments_of_sections(sections, raw).collect()}
    assert found == {"d": ["one", "two"], "e": ["raw"]}
    blocks = spark.createDataFrame([("d", 1, 0, "b0", "body", "", "", "raw", 0.9), ("d", 1, 1, "b1", "body", "", "fixed", "raw", 0.9), ("d", 2, 0, "b2", "body", "", None, " ", 0.9)], "document_id string, page_number int, block_idx int, block_id string, label string, title string, corrected_text string, raw_text string, confidence double")
    assert [s.text for s in chunking.segments_of_blocks(blocks).first().segments] == ["raw", "fixed"]
    made = chunking.chunk(segments(spark, 'say "x"\n\nb'), "paragraph")
    assert [c["text"] for c in json.loads(chunking.payload(made).first().payload)["chunks"]] == ['say "x"', "b"]


def greedy(pieces, most, overlap):
    done, now = [], []
    for piece in pieces:
        own = piece.split()
        if now and len(now) + len(own) > most:
            done.append(" ".join(now))
            now = now[-overlap:] if overlap else []
        now = now + own
    return done + [" ".join(now)] if now else done


@pytest.mark.parametrize("most,overlap", [(10, 0), (10, 3), (4, 3)])
def test_packing_and_windows(spark, most, overlap):
    import random

    rng = random.Random(most)
    cases = [[" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c array<string>")
    assert {r.k: r.p for r in df.select("k", packing.pack(F.col("c"), most, overlap).alias("p")).collect()} == {k: greedy(c, most, overlap) for k, c in enumerate(cases)}
    for r in df.select(F.array_join("c", " ").alias("t"), packing.windows(F.array_join("c", " "), most, overlap).alias("w")).collect():
        own = r.t.split()
        assert all(len(w.split()) <= most for w in r.w) and (not own or (r.w[0].split() == own[:most] and r.w[-1].split()[-1] == own[-1]))
    tiers = packing.packed_chunks(spark.createDataFrame([(0, "a\n\nb"), (1, "A b. C d."), (2, "x y z")], "document_id int, raw_text string"), most=2, overlap=1)
    assert {r.document_id: r.strategy for r in tiers.collect()} == {0: "paragraph", 1: "sentence", 2: "sliding_window"}


def test_layout_order_and_boxes(spark):
    rows = [("d", 1, [600, 50, 900, 60], 1000, "r1"), ("d", 1, [10, 500, 310, 510], 1000, "l2"), ("d", 1, [12, 40, 308, 60], 1000, "l1"), ("d", 1, [605, 10, 905, 20], 1000, "r0")]
    df = spark.createDataFrame(rows, "document_id string, page_number int, bbox array<int>, page_width int, name string")
    assert [r.name for r in layout.reading_order(df).orderBy("order").collect()] == ["l1", "l2", "r0", "r1"]
    spans = spark.createDataFrame([("d", 1, x, 1000) for x in (10, 12, 400, 405, 900)], "document_id string, page_number int, x0 int, page_width int")
    assert [r.col for r in layout.span_columns(spans).orderBy("x0").collect()] == [0, 0, 1, 1, 2]
    one = spark.range(1).select(F.concat_ws("|", layout.normal_label(F.lit("plain text")), layout.normal_label(F.lit("Sub Title"))).alias("a"), layout.clamp_box(F.array(*map(F.lit, (-5, 3, 999, 20))), F.lit(100), F.lit(10)).alias("b"), layout.scale_box(F.array(*map(F.lit, (0, 112, 224, 224))), F.lit(100), F.lit(200)).alias("c")).first()
    assert one.a == "body|Sub Title" and one.b == [0, 3, 100, 10] and one.c == [0, 100, 100, 200]
    blocks = spark.createDataFrame([("d", 1, "abandon", [1, 2, 3, 4], 0.9), ("d", 2, "title", [1, 2, 3, 4], 0.1), ("d", 3, "plain text", [1, 2, 3, 4], 0.5)], "document_id string, page_number int, label string, bbox array<int>, confidence double")
    pages = spark.createDataFrame([("d", k) for k in (1, 2, 3)], "document_id string, page_number int")
    assert [(r.page_number, r.label, r.confidence) for r in layout.detected_blocks(blocks, pages).orderBy("page_number").collect()] == [(1, "full_page", 0.0), (2, "full_page", 0.0), (3, "body", 0.5)]


def test_markdown_pages_and_blocks(spark):
    text = "intro\n# One\n\nbody\n### Sub\nmore\n## Two\n| a |\n|---|\n| 1 |"
    docs = spark.createDataFrame([("d", text), ("e", " ")], "document_id string, raw_text string")
    pages = layout.markdown_pages(docs)
    assert {(r.document_id, r.page_number): r.text[:5] for r in pages.collect()} == {("d", 1): "intro", ("d", 2): "# One", ("d", 3): "## Tw", ("e", 1): ""}
    found = [(r.page_number, r.label, r.title) for r in layout.page_blocks(pages).orderBy("page_number", "block_idx").collect()]
    assert found == [(1, "body", ""), (2, "title", "One"), (2, "body", ""), (2, "body", "Sub"), (3, "heading", "Two"), (3, "table", "")]


def test_engines_fall_back(spark):
    layout.register_engine("bad", lambda data: 1 / 0)
    layout.register_engine("good", lambda data: [[{"text": data.decode(), "label": "title"}]])
    docs = spark.createDataFrame([("d", bytearray(b"hi"))], "document_id string, raw_bytes binary")
    one = layout.recognise(docs, ["bad", "good"]).first()
    assert (one.raw_text, one.label, one.method) == ("hi", "title", "good")
    none = layout.recognise(docs, ["bad", "unknown"]).first()
    assert none.confidence == 0.0 and none.error.startswith("bad")


def test_topics_are_found_and_grouped(spark):
    a = ["The cat and the dog play with cats and dogs all day.", "Dogs chase cats while other dogs sleep near cats.", "A cat likes milk and a dog likes bones, says the dog."]
    b = ["Stock markets fell as banks sold stock and bonds.", "Banks lend money; the stock of a bank rose today.", "Bonds and stock prices move with bank rates, say banks."]
    rows = [("x", a + b), ("y", ["Only one paragraph here."])]
    found = context.context_chunks(spark.createDataFrame(rows, "document_id string, paragraphs array<string>"))
    own = [r for r in found.orderBy("chunk_index").collect() if r.document_id == "x"]
    assert len({r.topic_id for r in own[:3]}) == len({r.topic_id for r in own[3:]}) == 1 and len({r.topic_id for r in own}) == 2
    groups = context.context_groups(found).collect()
    assert sorted((g.document_id, g.chunks) for g in groups) == [("x", 3), ("x", 3), ("y", 1)]
    assert all(len(r.related_chunk_ids) == (2 if r.document_id == "x" else 0) for r in context.related(found).collect())
    points = np.vstack([np.random.default_rng(1).normal(0, 0.05, (20, 3)) + c for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    labels, score = context.choose_topics(points)
    assert len(np.unique(labels)) == 3 and score > 0.9 and score == round(context.silhouette(points, labels), 4)


def test_corrections(spark):
    df = spark.createDataFrame([("0pen hell0 1BM fee1", 0.5), ("0pen", 0.9)], "t string, c double")
    assert [r.x for r in df.select(correct.ocr_rules(F.col("t"), F.col("c")).alias("x")).collect()] == ["Open hello IBM feel", "0pen"]
    dictionary = spark.createDataFrame([("hello", 10), ("help", 50), ("world", 5), ("word", 7)], "word string, frequency long")
    words = spark.createDataFrame([("helo",), ("wrold",), ("hello",), ("zzzzzz",), ("Jon",)], "word string")
    keep = spark.createDataFrame([("Jon",)], "word string")
    assert {r.word: (r.correction, r.distance) for r in correct.dictionary_corrections(words, dictionary, keep).collect()} == {"helo": ("help", 1), "wrold": ("word", 2)}


def brute_ocr_rules(text):
    for pattern, by in ((r"\b0(?=[A-Za-z])", "O"), (r"(?<=[A-Za-z])0\b", "o"), (r"\b1(?=[A-Za-z])", "I"), (r"(?<=[A-Za-z])1\b", "l")):
        text = re.sub(pattern, by, text)
    return text


def test_ocr_rules_on_every_whole_text(spark, sf, tmp_path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    extra = {-1: None, -2: "", -3: "x" * 300 + " of Io", -4: "éo éoa oé Iñ ñI ²oa ao² e\u0301oa a_o _oa", -5: "👍oa\n" + "Über Oslo " * 50}
    spark.createDataFrame(list((docs | extra).items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.fixed for r in catalog.ocr_rules(spark, str(tmp_path)).collect()}
    assert found == {i: None if t is None else brute_ocr_rules(t.replace("o", "0").replace("I", "1")) for i, t in (docs | extra).items()}
    assert any(len(t) > 200 for t in docs.values()) and any(not t.isascii() for t in docs.values())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_corrections_of_words_of_any_length(spark):
    rng = random.Random(5)
    known = {"".join(rng.choices("abc", k=n)): rng.randint(1, 9) for n in (1, 2, 3, 22, 23, 24, 25, 26, 27, 28, 40, 90) for _ in range(4)}
    unknown = {"x", "b", "ab", "z" * 30}
    for word in known:
        for most in (1, 2, 3):
            made = list(word)
            for _ in range(most):
                at = rng.randrange(len(made) + 1)
                made[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
            unknown.add("".join(made))
    unknown -= set(known) | {""}
    expected = {}
    for word in unknown:
        near = [(edits(word, k), -f, k) for k, f in known.items()]
        if min(near)[0] <= 2:
            expected[word] = (min(near)[2], min(near)[0])
    words = spark.createDataFrame([(w,) for w in unknown], "word string")
    found = correct.dictionary_corrections(words, spark.createDataFrame(list(known.items()), "word string, frequency long"))
    assert {r.word: (r.correction, r.distance) for r in found.collect()} == expected
    assert {len(w) > 24 for w in expected} == {True, False} and "x" in expected


def least_reached(edges):
    """node -> least node that edges reach, by hand."""
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("at_once", [components.AT_ONCE, 100, 0])
def test_components_in_one_pass_and_in_rounds(spark, at_once):
    rng = random.Random(3)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1150)] + [(2000 + k, 5000) for k in range(90)]
    edges += [(7, 7), (None, 3), (4, None), (1001, 1000), (1000, 1001)]
    rng.shuffle(edges)
    found = [tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5), at_once=at_once).collect()]
    assert len(found) == len({node for node, _ in found}) and dict(found) == least_reached(edges)


@pytest.mark.parametrize("at_once", [1 << 20, 0])
def test_forests_join_what_edges_join(monkeypatch, at_once):
    """Parts of a partition that are given away early join the same nodes."""
    monkeypatch.setattr(components, "_BATCH", 16)
    rng = np.random.default_rng(5)
    a, b = rng.integers(-300, 300, 400), rng.integers(-300, 300, 400)
    batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 10]), pa.array(b[i : i + 10])], names=["a", "b"]) for i in range(0, 400, 10)]
    parts = list(components._forests(iter(batches), at_once))
    assert len(parts) == 1 if at_once else len(parts) > 1
    joined = least_reached([e for node, root in parts for e in zip(node.tolist(), root.tolist(), strict=True)])
    assert joined == least_reached(zip(a.tolist(), b.tolist(), strict=True))


def test_components_of_a_small_table_take_few_jobs(spark):
    """Each round of stars is ten jobs or so; their records fill the driver where there are many partitions."""
    context = spark.sparkContext
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    context.setJobGroup("few-jobs", "components of a chain")
    try:
        assert {r.root for r in components.components(edges).collect()} == {0}
        assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) <= 8
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_entities_merge_and_relations(spark):
    assert entities.token_set_ratio("John Smith", "Smith, John") == 100 and entities.token_set_ratio("abc", "xyz") < 50
    rows = [("1", "John Smith", "PERSON"), ("2", "Smith, John", "PERSON"), ("3", "John Smith", "PERSON"), ("4", "John A. Smith", "PERSON"), ("5", "Johnson", "PERSON"), ("6", "John Smith", "ORG")]
    found = {(r.type, r.text): r.canonical_text for r in entities.canonical_entities(spark.createDataFrame(rows, "id string, text string, type string")).collect()}
    assert found[("PERSON", "John A. Smith")] == "John Smith" and found[("PERSON", "Johnson")] == "Johnson" and found[("PERSON", "Smith, John")] == "Smith, John"
    chunked = spark.createDataFrame([("c", "Dr. Ada King of Acme Corp met in Paris on 2024-01-02.")], "chunk_id string, text string")
    got = entities.extract(chunked)
    assert {(r.text, r.type) for r in got.collect()} == {("Dr. Ada King", "PERSON"), ("Acme Corp", "ORG"), ("Paris", "LOCATION"), ("2024-01-02", "DATE")}
    relations = spark.createDataFrame([("1", "2", "MENTIONS"), ("1", "3", "MENTIONS"), ("3", "2", "MENTIONS")], "head string, tail string, type string")
    canonical = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "A")], "id string, canonical_id string")
    assert [tuple(r) for r in entities.rewrite_relations(relations, canonical).collect()] == [("A", "B", "MENTIONS")]
    assert tuple(entities.extraction_totals(chunked, got, relations).first()) == (1, 4, 3)
    named = spark.createDataFrame([("x", "Machine Learning"), ("x", "ML")], "type string, text string")
    assert tuple(entities.acronyms(named).first()) == ("ML", "Machine Learning")
    graph = entities.graphml(spark.createDataFrame([("A", "a<b", "ORG")], "canonical_id string, canonical_text string, type string"), entities.rewrite_relations(relations, canonical))
    assert "a&lt;b" in "".join(r.value for r in graph.orderBy("part").collect())


def test_streams_take_new_files_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.csv").write_text("x,y,z\n1,2,3\n")
    listener = ingest_stream.Progress()
    spark.streams.addListener(listener)
    for extra in (None, "b.txt"):
        if extra:
            (source / extra).write_text("words")
        ingest_stream.write_stream(ingest_stream.sections(ingest_stream.new_files(spark, str(source))), out, state, once=True).awaitTermination(60)
    assert sorted(r.section_type for r in spark.read.parquet(out).collect()) == ["data_row", "header", "paragraph", "summary"]
    spark.streams.removeListener(listener)
    counted = ingest_stream.arrivals(ingest_stream.new_files(spark, str(source))).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(60)
    assert {(r.extension, r.files) for r in spark.table("arrivals").collect()} == {(".csv", 1), (".txt", 1)}


def test_command_line(spark, tmp_path, capsys):
    from docflow.__main__ import main

    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n")
    assert main(["--file", str(tmp_path / "a.csv")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["document"]["source_name"] == "a.csv"
    (tmp_path / "b").write_bytes(b"two\nlines")
    assert main(["--batch", str(tmp_path), "--output", str(tmp_path / "out")]) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["failed_files"] == 1


def test_entities_in_parts_against_brute_force(spark, monkeypatch):
    """Blocks dealt in parts of four texts, with the pairs that are dropped before scoring, give what all pairs give."""
    monkeypatch.setattr(entities, "PART", 4)
    rng = random.Random(3)
    words = ["acme", "acmes", "group", "corp", "corporation", "north", "south", "ltd", "ab", "abc"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(["acm", "Acm"]) + w if k == 0 else w for k, w in enumerate(rng.choices(words, k=rng.randint(1, 3))))
        rows.append((str(i), text, rng.choice(["ORG", "ORG", "PERSON", "PRODUCT"])))
    rows += [("n1", None, "ORG"), ("n2", "acme", None)]
    frequency = {}
    for _, text, kind in rows[:160]:
        frequency[kind, text] = frequency.get((kind, text), 0) + 1
    keys, root = sorted(frequency), {k: k for k in frequency}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            least = entities.SHORT_THRESHOLD if min(len(a[1]), len(b[1])) <= entities.SHORT else entities.THRESHOLDS.get(a[0], entities.DEFAULT_THRESHOLD)
            if a[0] == b[0] and a[1][:3].lower() == b[1][:3].lower() and entities.token_set_ratio(a[1], b[1]) >= least:
                root[find(b)] = find(a)
    groups = {}
    for key in keys:
        groups.setdefault(find(key), []).append(key)
    expected = {key: min(own, key=lambda x: (-frequency[x], -len(x[1]), x[1]))[1] for own in groups.values() for key in own}
    found = entities.canonical_entities(spark.createDataFrame(rows, "id string, text string, type string")).collect()
    assert {(r.type, r.text): r.canonical_text for r in found} == expected and len(groups) < len(keys)
    assert {(r.type, r.text): r.frequency for r in found} == frequency


def test_relations_of_neighbouring_mentions(spark):
    chunks = spark.createDataFrame([("c", "Dr. Ann Lee of Acme Corp met Prof. Bo Ray and Mr. Cy Doe in Rome. Acme Corp founded by Mr. Cy Doe"), ("d", "no names"), ("e", None)], "chunk_id string, text string")
    mentions = entities.extract(chunks)
    names = {r.id: r.text for r in mentions.collect()}
    found = [(names[r.head], names[r.tail], r.type) for r in entities.relate(mentions, chunks).collect()]
    assert ("Dr. Ann Lee", "Acme Corp", "WORKS_AT") in found and ("Prof. Bo Ray", "Mr. Cy Doe", "COLLABORATED_WITH") in found and ("Acme Corp", "Mr. Cy Doe", "FOUNDED_BY") in found
    assert {t for *_, t in found} <= set(entities.RELATION_TYPES)


@pytest.mark.parametrize("job", [ingest.ingest, lambda df: jobs.process(df)[1], lambda df: jobs.results(*jobs.process(df))])
def test_empty_tables_and_nulls_in_a_batch(spark, job):
    schema = "source_name string, raw_bytes binary, raw_text string"
    assert job(spark.createDataFrame([], schema)).count() == 0
    assert job(spark.createDataFrame([(None, None, None), (None, bytearray(b"x"), None), ("a.txt", bytearray(b""), None), ("a.pdf", bytearray(b""), "text")], schema)).collect() is not None
