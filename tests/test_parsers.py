"""Parsers against expected sections, as functions and as DataFrames."""

from docflow.operators import mixed, parsers

MARKDOWN = """# Guide

Intro text.

## Steps

1. One
2. Two

```python
x = 1
```

after code

| a | b |
|---|---|
| 1 | 2 |

---
"""


def kinds(sections):
    return [s.kind for s in sections]


def test_plain_paragraphs_and_summary():
    found = parsers.parse_plain("One two.\r\n\r\n\n\nThree")
    assert kinds(found) == ["summary", "paragraph", "paragraph"]
    assert found[1].metadata == {"word_count": 2, "char_count": 8}
    assert "Sections: 2 paragraph" in found[0].content
    assert kinds(parsers.parse_plain(" \n ")) == ["empty"] and kinds(parsers.parse_plain("x")) == ["paragraph"]


def test_structured_variants():
    assert parsers.structure_of("# A\ntext") == "markdown_like" and parsers.structure_of("- a\n- b\nc") == "list_like"
    found = parsers.parse_structured("# Head\nline one\n\nline two\n## Sub\nmore")
    assert [(s.kind, s.content) for s in found[1:]] == [("header", "Head"), ("content", "line one\nline two"), ("header", "Sub"), ("content", "more")]
    listed = parsers.parse_structured("intro\n- a\n\n- b\n1. c\n2. d")
    assert [(s.kind, s.content) for s in listed[1:]] == [("content", "intro"), ("list", "• a\n• b"), ("list", "• c\n• d")]


def test_csv_dialects_padding_and_summary():
    found = parsers.parse_csv('name;size;note\na;1;"x;y"\n\nb;2\n')
    assert found[0].content == "CSV Headers: name | size | note"
    assert [s.content for s in found if s.kind == "data_row"] == ["name: a | size: 1 | note: x;y", "name: b | size: 2"]
    assert found[-1].content == "CSV Summary: 2 data rows with 3 columns"
    assert parsers.parse_csv("")[0].content == "Empty CSV file" and parsers.parse_csv("\n , \n")[0].kind == "empty"


def test_json_paths_stats_and_values():
    text = '{"b": {"x": [1, {"y": null}]}, "a": true, "e": [], "s": "' + "z" * 120 + '", "k": 1.5}'
    found = parsers.parse_json(text)
    assert found[0].content == "Object with 5 keys (b, a, e, ... (2 more))"
    assert found[0].metadata == {"total_keys": 7, "total_arrays": 2, "total_objects": 3, "max_depth": 4}
    assert [s.content for s in found[1:4]] == ["b.x[0]: 1", "b.x[1].y: null", "a: True"]
    assert found[4].content == 's: "' + "z" * 97 + '..."'
    many = parsers.parse_json("[" + ",".join(map(str, range(15))) + "]", group_indexes=True)
    assert len(many) == 2 and many[1].content.endswith("... and 5 more items") and many[1].metadata["sample_paths"] == "[0],[1],[2]"
    assert parsers.parse_json("{bad")[0].metadata["invalid_json"] and parsers.parse_json("[]")[0].content == "Empty array"
    assert parsers.parse_json("3")[0].content == "Single int value"
    assert parsers.json_stats([[]] * 3)["max_depth"] == 1
    assert len(list(parsers.flatten(__import__("json").loads("[" * 500 + "1" + "]" * 500)))) == 1


def test_html_by_kind_with_implied_ends():
    text = "<html><head><title>T &amp; t</title><script>x('</p>')</script></head><body><h2>Second</h2><h1>First</h1><p>A paragraph of text<p>Another <b>bold</b> one<ul><li>a<li>b<li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>1<td>2</table></body>"
    found = [(s.kind, s.content) for s in parsers.parse_html(text)]
    assert found == [
        ("title", "T & t"), ("header", "First"), ("header", "Second"), ("content", "A paragraph of text"), ("content", "Anotherboldone"),
        ("list", "• a\n• b"), ("table", "h | i\n" + "-" * 50 + "\n1 | 2"),
    ]
    assert parsers.parse_html("just words")[0].kind == "fallback" and parsers.parse_html(" ")[0].kind == "empty"


def test_markdown_states():
    found = parsers.parse_markdown(MARKDOWN)
    assert kinds(found) == ["summary", "header_h1", "header_h2", "code_block", "header_h2", "table", "horizontal_rule"]
    assert found[3].metadata["language"] == "python" and found[4].content == "after code"
    assert found[5].metadata["table_rows"] == 1 and found[5].metadata["headers"] == "a | b"
    assert kinds(parsers.parse_markdown("- a\n- b")) == ["list"] and kinds(parsers.parse_markdown("```\nopen")) == ["paragraph"]


def test_mixed_regions_are_disjoint_sorted_and_parsed():
    text = 'Some words first.\n\n{"a": 1, "b": [2]}\n\n```python\nprint(1)\n```\n\nn,m,o\n1,2,3\n4,5,6\n\nlast words'
    regions = mixed.regions_of(text)
    assert [r.format for r in regions] == ["text", "json", "code", "csv", "text"]
    assert all(a.end <= b.start for a, b in zip(regions, regions[1:]))
    found = mixed.parse_mixed(text)
    assert found[0].kind == "summary" and {s.metadata.get("region_format") for s in found[1:]} == {"text", "json", "code", "csv"}


def test_overlap_rule_on_rows_equals_the_function(spark):
    import random

    rng, rows, expected = random.Random(1), [], {}
    for doc in range(20):
        regions = []
        for k in range(12):
            start = rng.randint(0, 60)
            regions.append(mixed.Region("f", start, start + rng.randint(1, 25), str(k), rng.randint(1, 9) / 10))
        rows += [(doc, "f", 0, k, r.start, r.end, r.confidence, r.content) for k, r in enumerate(regions)]
        expected[doc] = sorted((r.start, r.end, r.content) for r in mixed.settle(regions))
    df = spark.createDataFrame(rows, "document_id long, format string, rank int, seq int, start int, end int, confidence double, content string")
    found: dict = {}
    for r in mixed.settle_overlaps(df).collect():
        found.setdefault(r.document_id, []).append((r.start, r.end, r.content))
    assert {k: sorted(v) for k, v in found.items()} == expected


def test_dispatch_and_errors_are_rows(spark):
    rows = [("a", "x,y,z\n1,2,3", "text/csv"), ("b", "# H\ntext", "text/markdown"), ("c", None, "text/html"), ("d", "<a/>", "application/xml")]
    found = parsers.parse(spark.createDataFrame(rows, "document_id string, raw_text string, mime_type string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.document_id, []).append(r.section_type)
    assert by == {"a": ["header", "data_row", "summary"], "b": ["header_h1"], "c": ["empty"], "d": ["paragraph"]}
    counted = mixed.format_summary(mixed.parse(spark.createDataFrame([("m", "words here\n\n{\"a\": 1}", None)], "document_id string, raw_text string, mime_type string")))
    assert {(r.region_format, r.sections) for r in counted.collect()} == {("unknown", 1), ("text", 1), ("json", 2)}


def test_plain_sections_as_columns_equal_the_parser(spark):
    texts = ["", " \n ", "one", "a b\r\n\r\nc\n\n\n\n d\u3000\n\n", "x\n\ny\x1c\n\n\x1f", "é\n \nü", None]
    df = spark.createDataFrame([(str(k), t, m) for k, t in enumerate(texts) for m in ("text/plain", None, "application/xml")], "document_id string, raw_text string, mime_type string")
    found = {}
    for r in parsers.parse(df).orderBy("document_id", "section_idx").collect():
        found.setdefault(r.document_id, []).append((r.section_idx, r.section_type, r.content, sorted(r.metadata.items())))
    for k, t in enumerate(texts):
        own = [(n, s.kind, s.content, sorted(parsers.shown(s.metadata))) for n, s in enumerate(parsers.parse_plain(t or ""))]
        assert sorted(map(str, found[str(k)])) == sorted(map(str, own * 3))
