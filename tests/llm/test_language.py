"""Language ID against explicit sets of grams, and what its pipeline stage rejects."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import pytest

from docflow.llm import language_id
from tests.llm.cases import awkward, clashing, prose, table


def own_grams(text: str) -> set[bytes]:
    """Byte grams of 1 to 3 of a text with a space on both sides; other bytes than letters are spaces."""
    data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def bin_of(gram: bytes, params: language_id.KernelParams) -> int:
    value = (int.from_bytes(gram, "big") + len(gram)) * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[len(gram) - 1] % 2**32
    value ^= value >> 15
    return value * 0x2C1B3C6D % 2**32 >> (32 - params.bins_log2)


def bins(text: str, params: language_id.KernelParams) -> set[int]:
    return {bin_of(g, params) for g in own_grams(text)}


def test_predictions_equal_sets_of_grams_and_a_plain_ridge(spark):
    """The whole model anew from sets: kernel, Nyström features, weighed ridge, softmax, known share."""
    params = language_id.KernelParams(landmarks=8)
    words = {"x": "haus und der die das ist ein", "y": "the of and to in that house", "z": "maison et le la les un que"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[l].split(), k=rng.randint(1, 12))), l) for i, l in enumerate("xyzxyzyyx" * 12)]
    found = {r.doc_id: r for r in language_id.op2_language_id(table(spark, rows), params).collect()}
    known = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: (r[2], r[0]))
    sets = [bins(t, params) for _, t, _ in known]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    which = [l for _, _, l in known]
    picks = []
    for l in "xyz":
        own = [k for k, w in enumerate(which) if w == l]
        picks += [own[int(k)] for k in np.linspace(0, len(own) - 1, 2)]
    left = np.array([[kernel(a, sets[p]) for p in picks] for a in sets])
    among = np.array([[kernel(sets[a], sets[b]) for b in picks] for a in picks])
    weight = np.array([1 / which.count(w) for w in which])
    weight *= len(known) / weight.sum()
    target = np.array([[1.0 if w == l else -1.0 for l in "xyz"] for w in which])
    solved = np.linalg.lstsq(left.T @ np.diag(weight) @ left + params.ridge * len(known) * among, left.T @ np.diag(weight) @ target, rcond=None)[0]
    profile = {}
    for l in "xyz":
        own = [s for s, w in zip(sets, which) if w == l]
        profile[l] = {b for s in own for b in s if sum(b in o for o in own) >= max(1, params.known_share * len(own))}
    for i, text, _ in rows:
        own = bins(text, params)
        out = np.array([kernel(own, sets[p]) for p in picks]) @ solved
        soft = np.exp(3 * (out - out.max()))
        assert found[i].lang_pred == "xyz"[out.argmax()]
        assert found[i].score == pytest.approx(soft.max() / soft.sum(), abs=1e-3)
        assert found[i].known == pytest.approx(len(own & profile[found[i].lang_pred]) / len(own), abs=1e-6)


def junk(seed: int) -> str:
    """Random letters, letters of an alphabet that no document has, or base64; 40 bytes at least."""
    rng = random.Random(seed)
    kind = rng.choice(["latin", "greek", "han", "base64"])
    if kind == "base64":
        return base64.b64encode(rng.randbytes(rng.randint(60, 900))).decode()
    if kind == "han":
        return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(20, 400)))
    letters = "abcdefghijklmnopqrstuvwxyz" if kind == "latin" else "αβγδεζηθικλμνξοπρστυφχψω"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 300)))


def test_the_stage_drops_junk_and_keeps_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    planted = table(spark, [(10_000 + i, junk(i), None, "src0") for i in range(200)] + [(20_000, "12 !?", None, None), (20_001, None, "en", "a"), (20_002, "", "en", "a")])
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(planted)).select("doc_id").collect()}
    assert not [i for i in kept if i >= 20_000] and sum(i >= 10_000 for i in kept) <= 4, "junk is dropped"
    assert len([i for i in kept if i < 10_000]) >= 0.998 * docs.count(), "documents of a learned language are kept"


def test_stage_on_awkward_tables(spark):
    df = awkward(spark)
    kept = language_id.keep_identified(df).collect()
    assert None in {r.doc_id for r in kept} and [r.doc_id for r in kept].count(8) == 2, "null ids and repeats stay"
    assert not {3, 4, 5, 11} & {r.doc_id for r in kept}, "no text, or none with letters"
    wide = language_id.keep_identified(clashing(df))
    assert wide.columns == clashing(df).columns and sorted(str(tuple(r[:5])) for r in wide.collect()) == sorted(str(tuple(r)) for r in kept)
    assert language_id.keep_identified(table(spark, [])).count() == 0
    nothing = table(spark, [(1, "some text", None, "a"), (2, "...", None, "a")])
    assert [r.doc_id for r in language_id.keep_identified(nothing).collect()] == [1], "without labels only letters count"


def test_calibration_ignores_a_language_of_one_row():
    params = language_id.KernelParams()
    flags = language_id.gram_presence([prose(i, 20).encode() for i in range(9)], params)
    which = np.array([0] * 8 + [1])
    assert 0 < language_id.least_known(flags, which, 2, params) < 1
    assert language_id.least_known(flags[:1], which[:1], 1, params) == 0.0
