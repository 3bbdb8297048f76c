"""The quality classifier against a plain computation, and its defined results at the edges."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docflow.llm import quality
from tests.llm.cases import awkward, clashing, prose, table

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels, params=quality.QualityParams()):
    """Scores of (doc_id, text, host, path) rows by loops; labels: doc_id -> quality."""
    held = lambda i: i is not None and int(hashlib.md5(str(i).encode()).hexdigest()[0], 16) % 4 == 2
    cells = [quality.text_cells((t or "").encode()) for _, t, _, _ in rows]
    counts, classes = defaultdict(float), defaultdict(float)
    for (i, *_), own in zip(rows, cells):
        if i in labels and not held(i):
            classes[labels[i]] += 1
            for k, c in enumerate(own):
                counts[k, c, labels[i]] += 1
    everyone, ratio, base = sum(classes.values()), lambda k, c: 0.0, 0.0
    if classes[0] and classes[1]:
        part = lambda k, c, q: (counts[k, c, q] + params.smoothing * classes[q] / everyone) / classes[q]
        ratio, base = lambda k, c: math.log(part(k, c, 1) / part(k, c, 0)), math.log(classes[1] / classes[0])
    evidence = [sum(ratio(k, c) for k, c in enumerate(own)) for own in cells]
    p = [round(1e6 / (1 + math.exp(-(e + base)))) / 1e6 for e in evidence]
    mean = sum(p) / len(p)

    def strength(groups, parent_of):
        """By the definition: squares within groups, and between groups and their parents."""
        parents = defaultdict(list)
        for key, values in groups.items():
            parents[parent_of(key)] += values
        n, k, up = sum(map(len, groups.values())), len(groups), len(parents)
        if n <= k or k <= up:
            return params.most
        avg = lambda v: sum(v) / len(v)
        within = sum(sum((x - avg(v)) ** 2 for x in v) for v in groups.values()) / (n - k)
        between = sum(len(v) * (avg(v) - avg(parents[parent_of(g)])) ** 2 for g, v in groups.items()) / (k - up)
        size = (n - sum(sum(len(v) ** 2 for g, v in groups.items() if parent_of(g) == h) / len(vs) for h, vs in parents.items())) / (k - up)
        spread = (between - within) / size if size > 0 else 0
        return params.most if spread <= 0 else min(params.most, max(params.least, within / spread))

    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, h, s), x in zip(rows, p):
        if h is not None:
            hosts[h].append(x)
            if s is not None:
                paths[h, s].append(x)
    kh, kp = strength(hosts, lambda h: 0), strength(paths, lambda key: key[0])
    out = []
    for (i, _, h, s), e, x in zip(rows, evidence, p):
        rate = host_rate = mean if h is None else (kh * mean + sum(hosts[h]) - x) / (kh + len(hosts[h]) - 1)
        if h is not None and s is not None:
            rate = (kp * host_rate + sum(paths[h, s]) - x) / (kp + len(paths[h, s]) - 1)
        prior = min(max(rate, 1e-6), 1 - 1e-6)
        out.append((i, held(i), e, len(hosts[h]) if h is not None else 0, host_rate, len(paths[h, s]) if h is not None and s is not None else 0, rate, 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))))
    return out


def junk(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["$$$", "A!!", "!!", "ZZ"]) for _ in range(20))


@pytest.mark.parametrize("hosts", [3, 40])
def test_scores_equal_a_plain_computation(spark, hosts):
    rng = random.Random(hosts)
    rows, labels = [], {}
    for i in range(400):
        host = rng.choice([None, *[f"h{int(rng.paretovariate(0.7)) % hosts}" for _ in range(9)]])
        path = rng.choice([None, "a", "b", "c", "d"])
        good = rng.random() < (0.9 if host in ("h1", "h3") else 0.5) - (0.2 if path == "a" else 0)
        rows.append((i, prose(i, rng.randint(1, 30)) if good else junk(i), path, host))
        if rng.random() < 0.6:
            labels[i] = int(good)
    label_rows = [(i, q, 0) for i, q in labels.items()] + [(1, None, 0), (None, 1, 0), (10**9, 1, 0)]
    found = quality.op3_quality_bayes(table(spark, rows), spark.createDataFrame(label_rows, LABELS)).orderBy("doc_id").collect()
    expected = brute([(i, t, h, p) for i, t, p, h in rows], labels)
    for r, e in zip(found, expected, strict=True):
        assert (r.doc_id, r.held_out, r.host_rows, r.path_rows) == (e[0], e[1], e[3], e[5])
        assert [r.evidence, r.host_rate, r.path_rate, r.score] == pytest.approx([e[2], e[4], e[6], e[7]], abs=2e-6)
        assert r.kept == (r.score >= 0.5)


def test_sparse_sites_take_their_parents_rate(spark):
    rows = [(h, "p", 1_000_000 * (k < (90 if h == "good" else 10))) for h in ("good", "bad") for k in range(100)]
    rows += [("tiny", "p", 1_000_000), ("mid", "p", 900_000), (None, None, 500_000), ("good", None, 0)]
    found = quality.shrunk(spark.createDataFrame(rows, "host string, path string, p long")).collect()
    rates = defaultdict(set)
    for r in found:
        rates[r.host].add(round(r.host_rate, 2))
    assert min(rates["good"]) > 0.8 and max(rates["bad"]) < 0.2
    assert rates["tiny"] == rates["mid"] == rates[None] == {0.5}, "a site of one row knows nothing but its parent's rate"
    assert all(r.path_rows == 0 and r.path_rate == r.host_rate for r in found if r.path is None)


def test_held_out_labels_are_told_and_never_learned(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    found = quality.op3_quality_bayes(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.kept == (r.quality == 1) for r in found) >= 0.95 * len(found)
    assert sum(r.kept for r in found if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in found)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    same = lambda df: sorted(map(str, df.collect()))
    assert same(quality.op3_quality_bayes(docs, labels)) == same(quality.op3_quality_bayes(docs, flipped))


def test_awkward_rows_and_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (8, 1, None), (None, 0, 0), (9, None, 0)], LABELS)
    df = awkward(spark)
    found = quality.op3_quality_bayes(df, labels).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    assert sorted(map(str, found)) == sorted(map(str, quality.op3_quality_bayes(clashing(df), labels.withColumn("cells", F.lit("x"))).collect()))
    assert {(r.host_rows, r.path_rows) for r in found if r.doc_id == 3} == {(0, 0)}
    assert len({(r.score, r.evidence) for r in found if r.doc_id == 8}) == 1
    assert quality.op3_quality_bayes(table(spark, []), labels).count() == 0
    unlabelled = quality.op3_quality_bayes(df, labels.limit(0)).collect()
    assert {(r.evidence, r.score, r.kept) for r in unlabelled} == {(0.0, 0.5, True)}


def test_sites_of_urls(spark):
    urls = [("https://www.a.example/en/1?x=/y", "a.example", "en"), ("http://U:p@B.example:80", "b.example", None), ("http://b.example/?q", "b.example", None), ("no url", None, None), (None, None, None), ("", None, None)]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "url string")
    host, path = quality.url_site(F.col("url"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [(h, p) for _, h, p in urls]
