"""Language identification with string kernels.

Texts are compared by a blended-spectrum presence kernel: the number of distinct byte n-grams of
several lengths that both hold, normalised by the numbers each holds. Grams are hashed to a fixed
number of bins. Landmarks drawn from the labelled rows give a Nyström approximation, on which
one-versus-rest kernel ridge regression is solved; a batch of texts is scored by two matrix
products (texts x bins by bins x landmarks, then by landmarks x languages). How much of a text's
grams its language's rows know tells texts of no learned language; the least share to accept is
calibrated on labelled rows that took no part in the profile they are held against.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.arrow import by_bytes, map_rows, slices, small_batches

#: Bytes other than letters and parts of UTF-8 sequences count as a space.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
#: Multipliers that hash grams of 1, 2, ... bytes to bins (odd constants).
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


@dataclass(frozen=True)
class KernelParams:
    """rows_per_language and rows_in_all bound the labelled rows that the fit uses.

    A language knows the grams that ``known_share`` of its rows hold. The least share of known grams
    is ``slack`` times that under which ``reject_share`` of labelled rows lie.
    """

    bins_log2: int = 13
    grams: tuple[int, ...] = (1, 2, 3)
    rows_per_language: int = 300
    rows_in_all: int = 6000
    landmarks: int = 96
    ridge: float = 1e-3
    batch_bytes: int = 4 << 20
    batch_rows: int = 256
    known_share: float = 0.02
    reject_share: float = 0.001
    slack: float = 0.9


@dataclass(frozen=True)
class KernelModel:
    """weights: landmarks x languages, on kernel values with the landmarks' gram rows; profile:
    languages x bins, the grams that a language knows; least: share of known grams to accept."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    profile: np.ndarray
    least: float
    params: KernelParams


def letters_only(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_SPACED)


def gram_presence(texts: list[bytes], params: KernelParams) -> np.ndarray:
    """0/1 rows of the bins whose grams each text holds; texts of any length, in one pass.

    Texts are joined with a space on both sides, so edges count as word ends; grams that would
    cross into the next text go to a row that is dropped.
    """
    bins = 1 << params.bins_log2
    flags = np.zeros((len(texts) + 1, bins), dtype=np.uint8)
    if not texts:
        return flags[:0]
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)
    lengths = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    base = np.repeat(np.arange(len(texts), dtype=np.int64) * bins, lengths)
    flat = flags.reshape(-1)
    value = np.zeros(len(data), dtype=np.uint32)
    shift = np.uint32(32 - params.bins_log2)
    for n in range(1, max(params.grams) + 1):
        value = (value[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :] if n > 1 else data.astype(np.uint32)
        if n > 1:
            base[np.maximum(ends - n + 1, 0)] = len(texts) * bins
        if n in params.grams:
            bin_of = (value + np.uint32(n)) * np.uint32(_MIX[(n - 1) % len(_MIX)])
            bin_of ^= bin_of >> np.uint32(15)
            bin_of = (bin_of * np.uint32(0x2C1B3C6D)) >> shift
            flat[base[: len(bin_of)] + bin_of] = 1
    return flags[:-1]


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Normalised presence kernel between rows of 0/1 flags (float32)."""
    norm = np.sqrt(left.sum(1, dtype=np.float32))[:, None] * np.sqrt(right.sum(1, dtype=np.float32))[None, :]
    return (left @ right.T) / np.maximum(norm, 1e-9)


def known_grams(flags: np.ndarray, which: np.ndarray, count: int, share: float) -> np.ndarray:
    """0/1 rows, one a language: the bins that ``share`` of its rows hold, and one row at least."""
    out = np.zeros((count, flags.shape[1]), dtype=np.uint8)
    for k in range(count):
        own = flags[which == k]
        out[k] = own.sum(0, dtype=np.int64) >= max(1.0, share * len(own))
    return out


def least_known(flags: np.ndarray, which: np.ndarray, count: int, params: KernelParams) -> float:
    """The share of known grams to accept, from rows held against profiles of the other half.

    0, which accepts all, where no language has two rows.
    """
    half = np.zeros(len(which), dtype=bool)
    for k in range(count):
        half[np.flatnonzero(which == k)[1::2]] = True
    shares = []
    for side in (half, ~half):
        profile = known_grams(flags[~side], which[~side], count, params.known_share)
        tried = side & np.isin(which, which[~side])
        shares.append((flags[tried] & profile[which[tried]]).sum(1, dtype=np.int64) / flags[tried].sum(1, dtype=np.int64))
    shares = np.concatenate(shares)
    return params.slack * float(np.quantile(shares, params.reject_share)) if len(shares) else 0.0


def labelled_sample(labelled: DataFrame, params: KernelParams) -> DataFrame:
    """A bounded sample of (doc_id, text, lang): per language the rows of least hash of doc_id.

    The choice is made on (doc_id, lang) alone. Languages are counted first, with partial
    aggregation, and a language of n rows keeps those whose hash lies in the part of all hashes
    that holds four times the wanted rows on average (fewer than wanted: once in 10**100); so
    the window over a language, however hot, meets some thousand distinct rows. The texts of the chosen ids (``rows_in_all`` at
    most, so they are broadcast) come from a second scan. Languages beyond ``rows_in_all`` rows
    in all are thinned evenly: each keeps its first rows; of more than ``rows_in_all`` languages
    the first by name are learned and texts of the others are told as one of those or rejected. Rows without doc_id are not chosen;
    of rows with the same doc_id and language the least text is.
    """
    key = F.xxhash64("doc_id")
    ids = labelled.filter(F.col("doc_id").isNotNull()).select("doc_id", "lang", key.alias("_hash"))
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_count")).orderBy("lang").limit(params.rows_in_all)
    part = F.col("_hash") / F.lit(2.0**64) + 0.5
    few = ids.join(F.broadcast(counts), "lang").filter(part * F.col("_count") <= 4 * params.rows_per_language).select("doc_id", "lang", "_hash").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    chosen = few.withColumn("_n", place).filter(F.col("_n") <= params.rows_per_language).orderBy("_n", "lang").limit(params.rows_in_all).select("doc_id", "lang")
    found = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    return found.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(labelled: DataFrame, params: KernelParams = KernelParams()) -> KernelModel | None:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang); None if there is nothing.

    Executors reduce each sampled text to its gram bins (1 kB at 13 bits); only those and the
    labels reach the driver, at most ``rows_in_all`` of them.
    """
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("flags", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(1).to_pylist()
        packed: list[bytes] = []
        for i, j in by_bytes(texts, len, params.batch_bytes):
            packed += [row.tobytes() for row in np.packbits(gram_presence([letters_only(t) for t in texts[i:j]], params), axis=1)]
        return {"doc_id": batch.column(0), "lang": batch.column(2), "flags": packed}

    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = labelled_sample(usable.select(F.col("doc_id").cast("long"), "text", "lang"), params)
    rows = map_rows(sample, ["doc_id", "text", "lang"], "doc_id long, lang string, flags binary", work, out).collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.doc_id is None, r.doc_id, r.flags))
    rows = [r for r in rows if any(r.flags)]
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    bits = np.stack([np.unpackbits(np.frombuffer(r.flags, dtype=np.uint8)) for r in rows])
    flags = bits.astype(np.float32)
    which = np.array([languages.index(r.lang) for r in rows])
    # Landmarks: the same number of each language, spread over its rows.
    each = max(1, params.landmarks // len(languages))
    picks = np.concatenate([(own := np.flatnonzero(which == k))[np.unique(np.linspace(0, len(own) - 1, min(each, len(own))).astype(int))] for k in range(len(languages))])
    targets = np.where(which[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = 1.0 / np.bincount(which, minlength=len(languages))[which]  # languages count alike
    share *= len(rows) / share.sum()
    left = kernel(flags, flags[picks]).astype(np.float64)
    among = kernel(flags[picks], flags[picks]).astype(np.float64)
    weighed = left * share[:, None]
    solved = np.linalg.lstsq(weighed.T @ left + params.ridge * len(rows) * among, weighed.T @ targets, rcond=None)[0]
    profile, least = known_grams(bits, which, len(languages), params.known_share), least_known(bits, which, len(languages), params)
    return KernelModel(languages, bits[picks], solved.astype(np.float32), profile, least, params)


def predict(texts: list[str | None], model: KernelModel | None) -> tuple[list[str], list[float], list[float]]:
    """Language, score and known share of each text. ``und`` and 0 for null, a text without letters, no model.

    The score is the probability-like share of the best language: the ridge outputs (about 1 for
    the language, -1 for the others) through a softmax. The known share is that of the text's
    grams which the language's labelled rows know.
    """
    names, scores, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    if not lettered:
        return names, scores, known
    p = model.params
    right, profile = model.landmarks.astype(np.float32), model.profile.astype(np.float32)
    norm = np.sqrt(right.sum(1))
    for i, j in by_bytes(lettered, lambda k: len(texts[k]), p.batch_bytes):
        for a in range(i, j, p.batch_rows):
            rows = lettered[a : min(j, a + p.batch_rows)]
            flags = gram_presence([letters_only(texts[k]) for k in rows], p).astype(np.float32)
            held = flags.sum(1)
            values = (flags @ right.T) / np.maximum(np.sqrt(held)[:, None] * norm[None, :], 1e-9)
            out = values @ model.weights
            soft = np.exp(3.0 * (out - out.max(1, keepdims=True)))
            best, all_rows = out.argmax(1), np.arange(len(rows))
            top = soft[all_rows, best] / soft.sum(1)
            share = (flags @ profile.T)[all_rows, best] / np.maximum(held, 1)
            for k, b, s, own in zip(rows, best, top, share, strict=True):
                names[k], scores[k], known[k] = model.languages[b], float(min(1.0, max(0.0, s))), float(own)
    return names, scores, known


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, model: KernelModel | None, columns: list[str]) -> DataFrame:
    """``columns`` of documents (long, boolean or string) with lang_pred, score and known.

    Null and letterless texts give ``und``; texts of any length are read whole; repeated rows
    get equal answers; the model (under 2 MB at the default parameters) goes with the task.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = dict(documents.select(*columns).dtypes)
    out = pa.schema([*((c, kinds[types[c]]) for c in columns), ("lang_pred", pa.string()), ("score", pa.float64()), ("known", pa.float64())])
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", lang_pred string, score double, known double"

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        names, scores, known = predict(batch.column(len(columns)).to_pylist(), shared.value)
        return {c: batch.column(k) for k, c in enumerate(columns)} | {"lang_pred": names, "score": scores, "known": known}

    return map_rows(documents, [*columns, "text"], schema, work, out)


def fit_documents(documents: DataFrame, params: KernelParams = KernelParams()) -> KernelModel | None:
    return fit(documents.filter(~held_out()), params)


def op2_language_id(documents: DataFrame, params: KernelParams = KernelParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known of every document; held-out rows are never learned from."""
    model = fit_documents(documents, params)
    narrow = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return identify(narrow, model, ["doc_id", "held_out"])


def keep_identified(documents: DataFrame) -> DataFrame:
    """Documents in a learned language: rejects ``und`` and texts of whose grams too few are known.

    The least share of known grams comes from the labelled rows (`least_known`): about one in a
    thousand of texts in a learned language would lie under it without the slack. Random letters
    and languages that were not learned know few grams of any language and go; texts of a few
    words of a learned language stay. All columns and rows stay as they are otherwise: a stage
    returns the columns of documents, so predictions are not written over ``lang``, which later
    stages do not read. The model is fitted on the table's own labelled rows that are not held
    out; with no labelled row there is no language to tell, and only texts without letters go.
    """
    model = fit_documents(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if shared.value is None:
                keep = [bool(t and _LETTER.search(t)) for t in texts]
            else:
                names, _, known = predict(texts, shared.value)
                keep = [n != "und" and k >= shared.value.least for n, k in zip(names, known, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
