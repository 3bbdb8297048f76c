"""Entities and relations of chunks, and merging entities that name the same thing."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docflow.functions.text import stable_id
from docflow.operators.batches import map_tuples
from docflow.operators.components import components
from docflow.operators.skew import join_groups
from docflow.plans.staging import staged

#: Types, and least scores by type and for short texts.
ENTITY_TYPES = ("PERSON", "ORG", "PRODUCT", "LOCATION", "DATE", "EVENT", "ROLE", "SKILL")
RELATION_TYPES = ("WORKS_AT", "FOUNDED_BY", "LOCATED_IN", "COLLABORATED_WITH", "HAS_SKILL", "PUBLISHED_ON", "MENTIONS", "PART_OF")
THRESHOLDS, DEFAULT_THRESHOLD, SHORT, SHORT_THRESHOLD = {"PERSON": 88, "ORG": 85}, 88, 6, 92

Extractor = Callable[[str], list[tuple[str, str, int, int]]]
_EXTRACTORS: dict[str, Extractor] = {}

_NAME = r"[A-Z][\w'-]+(?: [A-Z][\w'-]+)*"
_RULES = (
    ("DATE", re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b")),
    ("ORG", re.compile(rf"\b{_NAME} (?:Inc|Corp|Ltd|LLC|GmbH|University|Institute)\b\.?")),
    ("PERSON", re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof)\. {_NAME}")),
    ("LOCATION", re.compile(rf"(?<=\bin ){_NAME}")),
)


def register_extractor(name: str, extractor: Extractor) -> None:
    """Add an extractor: text -> (text, type, start, end) of each entity."""
    _EXTRACTORS[name] = extractor


def by_rules(text: str) -> list[tuple[str, str, int, int]]:
    """A stand-in for a model: dates, organisations, titled persons, places after "in"."""
    return sorted(((m[0], kind, m.start(), m.end()) for kind, rule in _RULES for m in rule.finditer(text)), key=lambda e: (e[2], e[1]))


register_extractor("rules", by_rules)


def extract(chunks: DataFrame, extractor: str = "rules") -> DataFrame:
    """(chunk_id, text) -> chunk_id, id, text, type, start, end."""
    run = _EXTRACTORS[extractor]
    fields = [("chunk_id", pa.string()), ("text", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    out = pa.schema(fields)

    def work(chunk_id: str, text: str | None) -> list[tuple]:
        return [(chunk_id, *e) for e in run(text or "")]

    found = map_tuples(chunks.select("chunk_id", "text"), work, "chunk_id string, text string, type string, start int, end int", out)
    return found.withColumn("id", stable_id(F.col("chunk_id"), F.col("type"), F.col("start")))


#: Relation of two mentions by their types, and words between them that it asks for (none: any).
RELATION_RULES = (
    ("ORG", "PERSON", r"(?i)\bfounded by\b", "FOUNDED_BY"),
    ("PERSON", "ORG", r"(?i)\b(?:works?|worked) (?:at|for)\b|\bof\b|\bat\b", "WORKS_AT"),
    ("PERSON", "PERSON", r"(?i)\bwith\b|\band\b", "COLLABORATED_WITH"),
    ("PERSON", "SKILL", "", "HAS_SKILL"),
    ("ORG", "LOCATION", r"(?i)\bin\b", "LOCATED_IN"),
    ("ORG", "ORG", r"(?i)\bpart of\b", "PART_OF"),
    ("PRODUCT", "DATE", r"(?i)\bon\b", "PUBLISHED_ON"),
    ("LOCATION", "DATE", r"(?i)\bon\b", "PUBLISHED_ON"),
)


def relate(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relations (chunk_id, head, tail, type) of each mention and the next in its chunk; a stand-in for a model.

    ``mentions`` as `extract` gives them; ``chunks``: chunk_id, text. The first of RELATION_RULES that
    holds names the relation, MENTIONS otherwise. Linear in the mentions: no pairs of a whole chunk.
    """
    order = Window.partitionBy("chunk_id").orderBy("start", "type")
    pairs = mentions.withColumn("next", F.lead(F.struct("id", "type", "start")).over(order)).filter("next IS NOT NULL")
    found = pairs.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id")
    between = F.substring(F.col("_text"), F.col("end") + 1, F.greatest(F.col("next.start") - F.col("end"), F.lit(0)))
    kind = [F.when((F.col("type") == head) & (F.col("next.type") == tail) & (between.rlike(cue) if cue else F.lit(True)), F.lit(name)) for head, tail, cue, name in RELATION_RULES]
    return found.select("chunk_id", F.col("id").alias("head"), F.col("next.id").alias("tail"), F.coalesce(*kind, F.lit("MENTIONS")).alias("type"))


# Merging


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the lengths, in percent."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of the sets of words: those shared, with and without those of one side, in percent."""
    left, right = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(x))))) for x in (left - right, right - left))
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


@F.pandas_udf(DoubleType())
def set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def block_key(kind: Column, text: Column) -> Column:
    """Only entities with the same type and first three letters are compared."""
    return F.concat(kind, F.lit(":"), F.substring(F.lower(text), 1, 3))


def threshold(kind: Column, a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    short = (F.length(a) <= SHORT) | (F.length(b) <= SHORT)
    return F.when(short, F.lit(SHORT_THRESHOLD)).otherwise(F.coalesce(F.element_at(table, kind), F.lit(DEFAULT_THRESHOLD)))


#: Texts of a block that one task compares with as many others.
PART = 512


def block_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of texts of a block (type, l, r) that could be over the threshold, each once.

    ``keyed``: type, text, node, block. A large block is dealt by hash into parts, and each pair of
    parts is a group of the join, so no task meets a whole hot block. Before any text is
    scored, pairs go that share no word and whose lengths alone keep them under the threshold.
    """
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    total = keyed.count()
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = join_groups(keyed, sizes, "block", "n", max(1, total)).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    size = F.length(F.array_join(F.array_sort(words), " "))
    row = F.struct("node", "text", words.alias("words"), size.alias("size"))
    left = dealt.select("block", "type", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), row.alias("l"))
    right = dealt.select("block", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), row.alias("r"))
    pairs = left.join(right, ["block", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("l.text") < F.col("r.text")))
    reach = 200.0 * F.least("l.size", "r.size") / (F.col("l.size") + F.col("r.size"))
    could = F.arrays_overlap("l.words", "r.words") | (reach >= threshold(F.col("type"), F.col("l.text"), F.col("r.text")))
    return pairs.filter(could).select("type", "l", "r")


def canonical_entities(entities: DataFrame) -> DataFrame:
    """(id, text, type, ...) -> (type, text, frequency, canonical_text, canonical_id).

    Distinct texts of a block are scored in pairs; pairs over the threshold are merged by
    connected components; the most frequent text (then the longest, then the least) names its
    set. Repeats of a text are counted first, so they add no pairs. Entities without a type or
    text are left out.
    """
    texts = entities.filter("type IS NOT NULL AND text IS NOT NULL").groupBy("type", "text").agg(F.count(F.lit(1)).alias("frequency"))
    keyed = staged(texts.select("*", block_key(F.col("type"), F.col("text")).alias("block"), F.xxhash64("type", "text").alias("node")), "entities")
    scored = block_pairs(keyed).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), "type", F.col("l.text").alias("x"), F.col("r.text").alias("y"))
    same = scored.filter(set_ratio("x", "y") >= threshold(F.col("type"), F.col("x"), F.col("y")))
    roots = components(same.select("a", "b"))
    grouped = keyed.join(roots, "node", "left").withColumn("set", F.coalesce("root", "node"))
    # The least text of those most frequent, then longest: a minimum over what is negated.
    rank = F.struct((-F.col("frequency")).alias("f"), (-F.length("text")).alias("n"), "text")
    names = staged(grouped.groupBy("set").agg(F.min(rank)["text"].alias("canonical_text"), F.count(F.lit(1)).alias("texts")), "names")
    named = join_groups(grouped, names, "set", "texts", max(1, keyed.count()))
    return named.select("type", "text", "frequency", "canonical_text", stable_id(F.col("type"), F.col("canonical_text")).alias("canonical_id"))


def rewrite_relations(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """(head, tail, type) ids and (id, canonical_id) -> distinct relations of canonical ids, none to itself."""
    heads = canonical.select(F.col("id").alias("head"), F.col("canonical_id").alias("head_id"))
    tails = canonical.select(F.col("id").alias("tail"), F.col("canonical_id").alias("tail_id"))
    joined = relations.join(heads, "head", "left").join(tails, "tail", "left")
    new = joined.select(F.coalesce("head_id", "head").alias("head"), F.coalesce("tail_id", "tail").alias("tail"), "type")
    return new.filter("head <> tail").distinct()


def initials(text: Column) -> Column:
    """First letters of the capitalised words."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z])\w*"), F.lit(1)), lambda x: x), "")


def acronyms(texts: DataFrame) -> DataFrame:
    """(type, text) -> (acronym, expansion): texts in capitals alone and those with these initials."""
    short = texts.filter(F.col("text").rlike(r"^[A-Z]{2,6}$")).select(F.col("text").alias("acronym")).distinct()
    full = texts.filter(F.col("text").rlike(r"\s")).select(F.col("text").alias("expansion"), initials(F.col("text")).alias("acronym")).distinct()
    return short.join(full, "acronym").select("acronym", "expansion")


def extraction_totals(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: numbers of chunks, entities and relations."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(chunks, "total_chunks").crossJoin(one(entities, "total_entities")).crossJoin(one(relations, "total_relations"))


def graphml(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Lines (part, value) of a GraphML text: nodes with text and type, then edges with their type."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = entities.sparkSession
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="t" for="all" attr.name="type" attr.type="string"/><key id="x" for="node" attr.name="text" attr.type="string"/><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    nodes = entities.select("canonical_id", "canonical_text", "type").distinct()
    node = F.format_string('<node id="%s"><data key="t">%s</data><data key="x">%s</data></node>', escape(F.col("canonical_id")), escape(F.col("type")), escape(F.col("canonical_text")))
    edge = F.format_string('<edge source="%s" target="%s"><data key="t">%s</data></edge>', escape(F.col("head")), escape(F.col("tail")), escape(F.col("type")))
    return head.unionByName(nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(relations.select(F.lit(2).alias("part"), edge.alias("value")))
