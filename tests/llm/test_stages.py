"""Pipeline stages on awkward, clashing and empty tables, and what near dedup finds of planted copies."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from docflow.llm import lsh_forest
from tests.llm.cases import awkward, clashing, prose, table

FILTERS = {name: stage for name, stage in corpus_pipeline.STAGES[:4]}


@pytest.mark.parametrize("name", FILTERS)
def test_stages_stand_awkward_rows(spark, sf, name):
    df = awkward(spark)
    kept = FILTERS[name](spark, df, sf)
    rows = kept.collect()
    assert kept.columns == df.columns and {str(r) for r in rows} <= {str(r) for r in df.collect()}, "rows stay as they are"
    wide = FILTERS[name](spark, clashing(df), sf)
    assert wide.columns == clashing(df).columns
    assert Counter(str(tuple(r[:5])) for r in wide.collect()) == Counter(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, sf, name):
    empty = table(spark, [])
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, sf)
    assert out.count() == 0 and "doc_id" in out.columns


def test_near_dedup_drops_planted_copies_and_keeps_the_rest(spark, sf):
    """Copies with one word in sixty changed are within 0.8 of five-word shingles; recall is measured."""
    rng = random.Random(7)
    rows, planted = [], []
    for g in range(40):
        base = prose(1000 + g, 120).split()
        rows.append((g, " ".join(base)))
        for k in range(rng.randint(1, 6)):
            words = list(base)
            for at in (rng.randrange(60), 60 + rng.randrange(60)):
                words[at] = f"new{rng.random()}"
            planted.append((1000 + 10 * g + k, " ".join(words)))
    rows += [(500 + k, prose(5000 + k, 120)) for k in range(60)]
    kept = {r.doc_id for r in FILTERS["near dedup"](spark, table(spark, [(i, t, "en", "a") for i, t in rows + planted]), sf).collect()}
    assert {i for i, _ in rows} <= kept, "texts that are no copies stay"
    assert sum(i not in kept for i, _ in planted) >= 0.99 * len(planted)
    assert lsh_forest.drop_near_copies.__defaults__[0].width == 5
