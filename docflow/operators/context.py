"""Context chunks: paragraphs grouped by topic.

Per document, paragraphs are embedded, clustered by k-means with k chosen by silhouette, and each
topic gets keywords, a label, a centroid and the similarity of its paragraphs. With embeddings
and topics given as columns, the same steps are joins and aggregates over a whole corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import stable_id
from docflow.operators.batches import map_tuples
from docflow.operators.chunking import HEADER
from docflow.operators.skew import join_groups
from docflow.plans.staging import staged

_HEADER = re.compile(HEADER, re.MULTILINE)
_TERM = re.compile(r"(?u)\b\w\w+\b")
#: Words that carry no topic.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during
    each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now
    of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this
    those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves""".split()
)
FEATURES, KEYWORDS, LABEL_WORDS = 500, 6, 3

Embedder = Callable[[list[str]], np.ndarray]


def hashed_terms(texts: list[str], size: int = 512) -> np.ndarray:
    """Embeddings without a model: TF-IDF of terms hashed to a fixed size, of unit length."""
    out = np.zeros((len(texts), size))
    for k, text in enumerate(texts):
        for term in _TERM.findall(text.lower()):
            if term not in STOP_WORDS:
                out[k, zlib.crc32(term.encode()) % size] += 1
    out *= np.log((1 + len(texts)) / (1 + (out > 0).sum(0))) + 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def kmeans(points: np.ndarray, k: int, tries: int = 10, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several seeded runs with spread-out starts."""
    best, best_cost = np.zeros(len(points), dtype=int), math.inf
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        centres = points[[rng.integers(len(points))]]
        while len(centres) < k:
            far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
            pick = rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(points))
            centres = np.vstack([centres, points[pick]])
        labels = None
        for _ in range(rounds):
            far = ((points[:, None] - centres[None]) ** 2).sum(2)
            new = far.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            centres = np.vstack([points[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        cost = far.min(1).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = labels, cost
    return best


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance; points alone in a cluster count 0."""
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    far = 1 - unit @ unit.T
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    sums = np.stack([far[:, labels == c].sum(1) for c in kinds], axis=1)
    counts = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(points))
    inside = sums[rows, own] / np.maximum(counts[own] - 1, 1)
    means = sums / counts
    means[rows, own] = np.inf
    other = means.min(1)
    score = np.where(counts[own] > 1, (other - inside) / np.maximum(np.maximum(inside, other), 1e-12), 0.0)
    return float(score.mean())


def choose_topics(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Labels and silhouette of the best k from 2 to min(8, sqrt n); one topic if none is better than none."""
    n = len(points)
    best, best_score = np.zeros(n, dtype=int), -1.0
    for k in range(2, min(8, max(2, math.isqrt(n))) + 1):
        if k >= n:
            break
        labels = kmeans(points, k)
        if len(np.unique(labels)) > 1 and (score := silhouette(points, labels)) > best_score:
            best, best_score = labels, score
    return best, round(best_score, 4) if best_score > -1 else 0.0


def keywords(texts: list[str]) -> list[list[str]]:
    """The KEYWORDS terms of most TF-IDF weight of each text: one and two words, ties by term."""
    counts = []
    for text in texts:
        terms = [t for t in _TERM.findall(text.lower()) if t not in STOP_WORDS]
        own: dict[str, int] = {}
        for term in [*terms, *(f"{a} {b}" for a, b in zip(terms, terms[1:]))]:
            own[term] = own.get(term, 0) + 1
        counts.append(own)
    total: dict[str, int] = {}
    for own in counts:
        for term, n in own.items():
            total[term] = total.get(term, 0) + n
    kept = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FEATURES]}
    held = {t: sum(t in own for own in counts) for t in kept}
    weight = lambda own, t: own[t] * (math.log((1 + len(texts)) / (1 + held[t])) + 1)
    return [sorted((t for t in own if t in kept), key=lambda t: (-weight(own, t), t))[:KEYWORDS] for own in counts]


def paragraphs_with_topic_text(texts: list[str]) -> list[int]:
    """Which paragraphs carry content: not begun by a header, and more than three words or a full stop."""
    return [k for k, t in enumerate(texts) if not _HEADER.match(t) and (len(t.split()) > 3 or re.search(r"[.!?]", t))]


_FIELDS = [("document_id", pa.string()), ("chunk_index", pa.int32()), ("method", pa.string()), ("text", pa.string()), ("topic_id", pa.int32()), ("topic_label", pa.string()), ("topic_words", pa.list_(pa.string())), ("similarity_score", pa.float64()), ("coherence_score", pa.float64())]
SCHEMA = "document_id string, chunk_index int, method string, text string, topic_id int, topic_label string, topic_words array<string>, similarity_score double, coherence_score double"


def topics_of(texts: list[str], embed: Embedder) -> list[tuple]:
    """(chunk_index, method, text, topic, label, words, similarity, coherence) of a document's paragraphs."""
    kept = [texts[k] for k in paragraphs_with_topic_text(texts)]
    if len(kept) < 4:
        return [(k, "paragraph", t, k, f"Group {k + 1}", [], 0.0, 1.0) for k, t in enumerate(texts)]
    points = np.asarray(embed(kept), dtype=float)
    labels, coherence = choose_topics(points)
    kinds = sorted(set(labels.tolist()))
    named = dict(zip(kinds, keywords([" ".join(t for t, label in zip(kept, labels, strict=True) if label == c) for c in kinds]), strict=True))
    centre = {c: points[labels == c].mean(0) for c in kinds}
    out = []
    for k, (text, c) in enumerate(zip(kept, labels.tolist(), strict=True)):
        title = ", ".join(w.title() for w in named[c][:LABEL_WORDS]) or f"Group {c + 1}"
        out.append((k, "context", text, c, title, named[c], round(float(points[k] @ centre[c]), 4), coherence))
    return out


def context_chunks(documents: DataFrame, embed: Embedder = hashed_terms) -> DataFrame:
    """Topic chunks of (document_id, paragraphs array<string>); ``embed`` runs on executors."""
    out = pa.schema(_FIELDS)

    def work(document_id: str, texts: list[str] | None) -> list[tuple]:
        return [(document_id, *t) for t in topics_of(texts or [], embed)]

    return map_tuples(documents.select("document_id", "paragraphs"), work, SCHEMA, out)


def related(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id and the ids of the other chunks of their topic, in order."""
    named = chunks.withColumn("chunk_id", stable_id(F.col("document_id"), F.col("method"), F.col("chunk_index")))
    order = Window.partitionBy("document_id", "topic_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return named.withColumn("related_chunk_ids", F.array_remove(F.collect_list("chunk_id").over(order), F.col("chunk_id")))


def context_groups(chunks: DataFrame) -> DataFrame:
    """One row per document and topic: merged text, number of chunks, mean similarity, label, words."""
    item = F.struct("chunk_index", "text")
    grouped = chunks.groupBy("document_id", "topic_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.round(F.avg("similarity_score"), 4).alias("similarity_score"),
        F.first("topic_label").alias("topic_label"),
        F.first("topic_words").alias("topic_words"),
        F.first("coherence_score").alias("coherence_score"),
    )
    merged = F.array_join(F.transform("items", lambda x: x["text"]), "\n\n")
    return grouped.select("document_id", "topic_id", "topic_label", "topic_words", merged.alias("merged_text"), F.size("items").alias("chunks"), "similarity_score", "coherence_score", F.lit("context_merged").alias("method"))


def in_order(groups: DataFrame) -> DataFrame:
    """Groups with their ``place`` in the document, from 0, by topic."""
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("topic_id")) - 1)


# With embeddings and topics given


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(points: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    """Mean vector of each topic, not of unit length: (topic, centroid, rows).

    Each dimension is averaged with map-side partial sums, so a topic with most of the rows
    costs a row per dimension and task.
    """
    long = points.select(topic, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(topic, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    listed = means.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("items"), F.max("n").alias("rows"))
    return listed.select(topic, F.transform("items", lambda x: x["m"]).alias("centroid"), "rows")


def topic_similarity(points: DataFrame, topic: str = "topic_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """``points`` with the dot product of each vector and its topic's centroid.

    Centroids are staged; those of hot topics are broadcast, so that a topic with most of the rows is
    not sent to one task. Points without a topic are left out.
    """
    own = staged(centroids(points, topic, vector), "centroids")
    joined = join_groups(points, own, topic, "rows", own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    return joined.withColumn("similarity_score", F.round(dot(F.col(vector), F.col("centroid")), digits) + F.lit(0.0)).drop("centroid", "rows")


def strength(score: Column) -> Column:
    return F.when(score >= 0.55, "strong").when(score >= 0.30, "moderate").otherwise("weak")


def badge(score: Column) -> Column:
    return F.when(score * 100 >= 70, "high").when(score * 100 >= 40, "medium").otherwise("low")


def term_weights(texts: DataFrame, group: str, text: str, top: int = KEYWORDS, features: int = FEATURES) -> DataFrame:
    """Keywords of each group of texts over a corpus: (group, term, weight, place), all by aggregates.

    A group is one document of the weighting: count times ln((1 + n) / (1 + df)) + 1, then unit
    length. Terms are one or two words of two letters or digits or more, of the same text, without
    stop words; the ``features`` terms of most occurrences in all count. Ties go by term. The
    counts are staged once; after the choice of features only they and the groups are left.
    """
    stop = F.array(*map(F.lit, sorted(STOP_WORDS)))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda t: ~F.array_contains(stop, t))
    found = texts.select(group, words.alias("_words"))
    pairs = F.zip_with(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    terms = found.select(group, F.explode(F.concat("_words", pairs)).alias("term"))
    counts = staged(terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    n = texts.select(group).distinct().count()
    held = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = held.orderBy(F.col("total").desc(), "term").limit(features).select("term", "df")
    weighed = counts.join(F.broadcast(kept), "term").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    own = Window.partitionBy(group)
    placed = weighed.withColumns({"place": F.row_number().over(own.orderBy(F.col("w").desc(), "term")), "norm": F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))})
    return placed.filter(F.col("place") <= top).select(group, "term", (F.col("w") / F.col("norm")).alias("weight"), "place")
