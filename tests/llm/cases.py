"""Small tables that every operator must stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) if len(r) < 5 else r for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(words))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd letters."""
    long = prose(1, 30_000)
    rows = [
        (1, "Hello world this is a text", "en", "a"),
        (2, "hello WORLD this is a text", "en", None),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t ", "de", "a"),
        (6, long, "de", "b"),
        (7, long + " end", "de", "b"),
        (8, "Straße É é ΣΑΣ 漢字 😀 \x1c   x", "el", "\U0001f600"),
        (8, "Straße É é ΣΑΣ 漢字 😀 \x1c   x", "el", "\U0001f600"),
        (None, "no id at all", "en", "a"),
        (9, "a", "en", "a"),
        (10, "a", "en", "a"),
        (11, "!!! ??? 123", "en", "c"),
        (12, "x" * 5000, "en", "c"),
    ]
    return table(spark, rows)


def clashing(df: DataFrame) -> DataFrame:
    """The table with further columns named like those that operators use inside."""
    names = ["size", "copies", "target", "rank", "hilbert", "shard", "_part", "_place", "_id", "_row", "digest", "keep_id", "kept", "rep", "cls", "score", "lang_pred", "held_out", "ids", "frame", "_maybe", "_word", "label", "n_rows", "source_size", "_n", "_hash"]
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
