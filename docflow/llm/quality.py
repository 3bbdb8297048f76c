"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log-likelihood ratio of discrete text statistics,
counted on labelled rows. Sites are a tree: all documents, hosts, paths of a host. At each level a
site's rate of good documents is shrunk towards its parent's, by a strength that the spread of
the sites' rates gives (moments of a one-way analysis of variance); so a sparse site takes its
parent's rate and a large one its own. A document's score is its evidence with its site's rate, to
which the document itself has not contributed, as the prior.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrow import map_rows, utf8
from docflow.operators.skew import join_groups
from docflow.plans.staging import staged

#: Statistics of a text and the values at which a new cell begins; a cell's number is how many its
#: value reaches. Kinds of characters are counted of 1000 bytes, a word's bytes in tenths, distinct words
#: and lines of 100.
CELLS = {
    "symbols": (1, 4, 16, 64, 128, 256),
    "capitals": (5, 15, 30, 60, 120, 240, 480),
    "digits": (1, 8, 32, 128),
    "marks": (5, 10, 15, 20, 30, 40, 60),
    "word_length": (25, 35, 40, 45, 50, 55, 60, 70, 80),
    "distinct_words": (5, 10, 20, 40, 60, 80, 100),
    "distinct_lines": (25, 50, 75, 90, 100),
    "words": (1, 4, 16, 64, 256, 1024, 4096),
}
#: Kinds of characters that are counted.
SYMBOLS, CAPITALS, DIGITS, MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"
#: Rates are kept in millionths, so that sums over sites are exact in any order.
UNIT = 1_000_000


@dataclass(frozen=True)
class QualityParams:
    """smoothing: labelled rows that pull a cell's ratio to none. Strengths of a parent's rate are held
    within ``least`` and ``most`` rows. Documents that score under ``threshold`` are not kept."""

    smoothing: float = 8.0
    least: float = 1.0
    most: float = 1e6
    threshold: float = 0.5


def text_cells(text: bytes | None) -> bytes:
    """The cell of each of CELLS, in order, a byte each. Null is an empty text, whose values are 0."""
    t = text or b""
    words, lines = t.split(), t.split(b"\n") if t else []
    share = lambda count, of, scale: count * scale // of if of else 0
    counts = [share(len(t) - len(t.translate(None, kind)), len(t), 1000) for kind in (SYMBOLS, CAPITALS, DIGITS, MARKS)]
    values = (*counts, share(sum(map(len, words)), len(words), 10), share(len(set(words)), len(words), 100), share(len(set(lines)), len(lines), 100), len(words))
    return bytes(bisect_right(marks, v) for marks, v in zip(CELLS.values(), values, strict=True))


def cell_rows(documents: DataFrame) -> DataFrame:
    """doc_id, host, path, cells binary of documents (doc_id, host, path, text)."""
    out = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("cells", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "cells": [text_cells(t) for t in utf8(batch.column(3))]}

    return map_rows(documents, ["doc_id", "host", "path", "text"], "doc_id long, host string, path string, cells binary", work, out)


@dataclass(frozen=True)
class EvidenceModel:
    """ratios: a log-likelihood ratio for each statistic's cell; base: log-odds of a good row."""

    ratios: list[list[float]]
    base: float


def held_out() -> Column:
    """A quarter of documents, by the first digit of the MD5 of doc_id; a null id is not held out."""
    digit = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1)
    return F.coalesce(digit.isin("2", "6", "a", "e"), F.lit(False))


def _cell(k: int) -> Column:
    return F.conv(F.hex(F.substring("cells", k + 1, 1)), 16, 10).cast("int")


def fit_evidence(cells: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> EvidenceModel:
    """Counts of (statistic, cell, label) over all labelled rows of ``cells`` (doc_id, cells).

    ``labels``: doc_id, quality (0 or 1). Rows with a null are no labels; of several labels of a
    doc_id the least counts. Rows without any doc_id are not labelled. The table of counts has a
    row for each cell, so only some hundred rows reach the driver, at any size. Where a class has
    no row, every ratio and the base is 0.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg((F.min("quality") > 0).alias("_good"))
    rows = cells.join(known, F.col("doc_id") == F.col("_labelled")).select("_good", F.posexplode(F.array(*[_cell(k) for k in range(len(CELLS))])).alias("k", "cell"))
    counts = {(r.k, r.cell, r["_good"]): r.n for r in rows.groupBy("k", "cell", "_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = (sum(n for (k, _, g), n in counts.items() if k == 0 and g is kind) for kind in (True, False))
    if not good or not bad:
        return EvidenceModel([[0.0] * (len(m) + 1) for m in CELLS.values()], 0.0)
    share = good / (good + bad)
    held = lambda k, c, kind, part: (counts.get((k, c, kind), 0) + params.smoothing * part) / (good if kind else bad)
    ratios = [[math.log(held(k, c, True, share)) - math.log(held(k, c, False, 1 - share)) for c in range(len(m) + 1)] for k, m in enumerate(CELLS.values())]
    return EvidenceModel(ratios, math.log(good / bad))


def evidence(model: EvidenceModel) -> Column:
    """Sum of the log-likelihood ratios of a row's ``cells``."""
    parts = [F.get(F.array(*map(F.lit, ratios)), _cell(k)) for k, ratios in enumerate(model.ratios)]
    return reduce(lambda a, b: a + b, parts)


def _strength(rows: float, groups: float, parents: float, squares: float, own: float, above: float, spread: float, params: QualityParams) -> float:
    """Rows that a parent's rate counts as: variance in groups over variance between them.

    own, above: sums of s * s / n over the groups and over their parents; squares: sum of
    q = p * p; spread: rows less the groups' n * n over their parents' n.
    """
    if rows <= groups or groups <= parents:
        return params.most
    within = max(0.0, squares - own) / (rows - groups)
    size = spread / (groups - parents)
    between = ((own - above) / (groups - parents) - within) / size if size > 0 else 0.0
    return params.most if between <= 0 else min(params.most, max(params.least, within / between))


def shrunk(rows: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """``rows`` (host, path string, p long in millionths, ...) with the rates of their sites.

    Adds host_rows, host_rate, path_rows, path_rate: rows and shrunk rates of the row's host and of
    its path in it, both without the row itself. A row without a host has the rate of all rows,
    one without a path that of its host; such rows belong to no site there (0 rows) and take
    no part in its spread. Hosts and paths are grouped with partial aggregation, one row a
    site; hot sites are joined back by a broadcast of bounded size.
    """
    square = F.col("p").cast("decimal(38,0)") * F.col("p")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(square).alias("q")]
    paths = staged(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"], F.count(F.lit(1)).alias("n_paths"))
    hosts = staged(hosts, "hosts")
    total, everything = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = everything / total / UNIT if total else 0.5
    n, s = F.col("n").cast("double"), F.col("s") / F.lit(float(UNIT))
    q = F.col("q").cast("double") / F.lit(float(UNIT) ** 2)
    moments = lambda df: df.agg(F.sum(n), F.count(F.lit(1)), F.sum(s), F.sum(q), F.sum(s * s / n), F.sum(n * n)).first()
    zero = lambda row: [float(x or 0) for x in row]
    h_n, h_k, h_s, h_q, h_own, h_nn = zero(moments(hosts.filter("host IS NOT NULL")))
    strength_host = _strength(h_n, h_k, 1.0, h_q, h_own, h_s * h_s / h_n if h_n else 0.0, h_n - h_nn / h_n if h_n else 0.0, params)
    inner = paths.filter("host IS NOT NULL AND path IS NOT NULL")
    p_n, p_k, _, p_q, p_own, _ = zero(moments(inner))
    over = inner.groupBy("host").agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(n * n).alias("nn"))
    o_k, o_above, o_nn = zero(over.agg(F.count(F.lit(1)), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum(F.col("nn") / F.col("n"))).first())
    strength_path = _strength(p_n, p_k, o_k, p_q, p_own, o_above, p_n - o_nn, params)
    # Back to the rows: hosts to their paths, then paths to their rows, hot ones by broadcasts.
    named = lambda df: df.withColumn("_host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")))
    of_paths = named(paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")))
    of_hosts = named(hosts).select("_host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), "n_paths")
    n_paths = hosts.agg(F.sum("n_paths")).first()[0] or 0
    sites = join_groups(of_paths, of_hosts, "_host", "n_paths", n_paths)
    site_key = lambda df: df.withColumn("_site", F.struct(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")).alias("h"), F.coalesce(F.concat(F.lit("p"), "path"), F.lit("n")).alias("p")))
    sites = staged(site_key(sites).select("_site", "path_n", "path_s", "host_n", "host_s"), "sites")
    joined = join_groups(site_key(rows), sites, "_site", "path_n", total or 0)
    has_host, has_path = F.col("host").isNotNull(), F.col("host").isNotNull() & F.col("path").isNotNull()
    rate = lambda up, strength, s, n: (strength * up + (F.col(s) - F.col("p")) / F.lit(float(UNIT))) / (strength + F.col(n) - 1)
    out = joined.withColumns({"host_rows": F.when(has_host, F.col("host_n")).otherwise(0), "path_rows": F.when(has_path, F.col("path_n")).otherwise(0)})
    out = out.withColumn("host_rate", F.when(has_host, rate(F.lit(mean), F.lit(strength_host), "host_s", "host_n")).otherwise(F.lit(mean)))
    out = out.withColumn("path_rate", F.when(has_path, rate(F.col("host_rate"), F.lit(strength_path), "path_s", "path_n")).otherwise(F.col("host_rate")))
    return out.drop("_site", "path_n", "path_s", "host_n", "host_s")


def url_site(url: Column) -> tuple[Column, Column]:
    """Host (without ``www.``) and the first segment of the path of a URL; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:[Ww]{3}\.)?([^/?#:]+)", 1))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(host != "", host), F.when(first != "", first)


def quality_scores(documents: DataFrame, labels: DataFrame, host: Column, path: Column, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, evidence, host_rows, host_rate, path_rows, path_rate, score, kept of each row.

    ``documents``: doc_id, text and what ``host`` and ``path`` are made of; ``labels``: doc_id, quality
    (0 or 1). Labels of held-out documents are not learned
    from, so they measure the classifier. Null texts are empty; null hosts and paths take their
    parents' rates; a row without doc_id has a score but no label; repeated rows are rows of
    their own; without labels of both classes evidence is 0 and every score is half. An empty
    table gives an empty result. Other columns are not read. Rates and scores have six digits.

    Texts are read once and reduced to eight small numbers, which are staged; everything after
    runs on these narrow rows.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    table = staged(cell_rows(narrow), "cells")
    model = fit_evidence(table.filter(~held_out()), labels, params)
    own = F.col("evidence") + F.lit(model.base)
    scored = table.select("doc_id", "host", "path", evidence(model).alias("evidence"))
    scored = scored.withColumn("p", F.round(F.lit(float(UNIT)) / (1 + F.exp(-own))).cast("long"))
    placed = shrunk(scored, params)
    prior = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = F.round(1 / (1 + F.exp(-(F.col("evidence") + F.log(prior / (1 - prior))))), 6)
    return placed.select(
        "doc_id", held_out().alias("held_out"), F.round("evidence", 6).alias("evidence"),
        F.col("host_rows").cast("long").alias("host_rows"), F.round("host_rate", 6).alias("host_rate"),
        F.col("path_rows").cast("long").alias("path_rows"), F.round("path_rate", 6).alias("path_rate"),
        score.alias("score"), (score >= params.threshold).alias("kept"),
    )


def op3_quality_bayes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents with their source as the host and their language as the path in it."""
    return quality_scores(documents, labels, F.col("source"), F.col("lang"))
