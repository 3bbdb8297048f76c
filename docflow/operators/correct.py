"""Correction of OCR text: substitution rules, and a frequency dictionary by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Python's \w; Java's \b follows other letters and differs between versions.
_WORD = r"[\p{L}\p{N}_]"
#: Misread characters and what they stand for, in order.
SUBSTITUTIONS = (
    (rf"(?<!{_WORD})0(?=[A-Za-z])", "O"),
    (rf"(?<=[A-Za-z])0(?!{_WORD})", "o"),
    (rf"(?<!{_WORD})1(?=[A-Za-z])", "I"),
    (rf"(?<=[A-Za-z])1(?!{_WORD})", "l"),
)
#: Substitutions that need a context to be right.
GATED = ((r"rn", "m"), (r"(?<!\s)(?<!^)([A-Z])", r" $1"))
LEAST_CONFIDENCE = 0.85


def ocr_rules(text: Column, confidence: Column | None = None, gated: bool = False) -> Column:
    """The text with misread characters replaced, where its confidence is low (always, without one)."""
    fixed = text
    for pattern, by in SUBSTITUTIONS + (GATED if gated else ()):
        fixed = F.regexp_replace(fixed, pattern, by)
    return fixed if confidence is None else F.when(confidence < LEAST_CONFIDENCE, fixed).otherwise(text)


def _less_one(word: Column) -> Column:
    """All strings that lack one character of the word."""
    return F.when(
        F.length(word) > 0,
        F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word)))),
    ).otherwise(F.array().cast("array<string>"))


def deletions(word: Column, distance: int = 2) -> Column:
    """The word and all it can become by leaving out up to ``distance`` characters."""
    found, last = F.array(word), F.array(word)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _less_one)))
        found = F.array_union(found, last)
    return found


def _pieces(length: Column, distance: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of the ``distance`` + 1 pieces of words of a length."""
    cuts = [F.floor(length * k / (distance + 1)).cast("int") for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _own_pieces(word: Column, distance: int) -> Column:
    """Pieces of a dictionary word, with their number and the word's length."""
    parts = _pieces(F.length(word), distance)
    return F.array(*[F.struct(F.lit(k).alias("k"), F.length(word).alias("n"), F.substring(word, a + 1, n).alias("piece")) for k, (a, n) in enumerate(parts)])


def _met_pieces(word: Column, distance: int) -> Column:
    """What the pieces of any word within ``distance`` can be: one of them is in the word as it is, moved by up to that."""
    moves = range(-distance, distance + 1)
    keys = [
        F.struct(F.lit(k).alias("k"), (F.length(word) + more).alias("n"), F.substring(word, a + 1 + move, n).alias("piece"))
        for more in moves
        for k, (a, n) in enumerate(_pieces(F.length(word) + more, distance))
        for move in moves
    ]
    return F.array_distinct(F.array(*keys))


def dictionary_corrections(words: DataFrame, dictionary: DataFrame, keep: DataFrame | None = None, distance: int = 2, longest: int = 24) -> DataFrame:
    """(word) and (word, frequency) -> word, correction, distance for unknown words that have one.

    Candidates meet by equal deletions, an equi-join whose rows grow with the words' lengths and
    not with the product of the tables; the edit distance decides, then the frequency, then the
    word. Words longer than ``longest`` meet by equal pieces instead, whose number is the same for
    any length. ``keep``: words (proper nouns) left as they are.
    """
    unknown = words.select("word").distinct().filter(F.length("word") > 0).join(dictionary.select("word"), "word", "left_anti")
    if keep is not None:
        unknown = unknown.join(keep.select("word").distinct(), "word", "left_anti")
    known = dictionary.select(F.col("word").alias("correction"), "frequency")
    left = unknown.filter(F.length("word") <= longest).select("word", F.explode(deletions(F.col("word"), distance)).alias("key"))
    right = known.filter(F.length("correction") <= longest + distance).select("*", F.explode(deletions(F.col("correction"), distance)).alias("key"))
    left_long = unknown.filter(F.length("word") > longest).select("word", F.explode(_met_pieces(F.col("word"), distance)).alias("key"))
    right_long = known.filter(F.length("correction") > longest - distance).select("*", F.explode(_own_pieces(F.col("correction"), distance)).alias("key"))
    met = left.join(right, "key").drop("key").union(left_long.join(right_long, "key").drop("key")).distinct()
    close = met.withColumn("distance", F.levenshtein("word", "correction", distance)).filter(F.col("distance").between(0, distance))
    order = Window.partitionBy("word").orderBy("distance", F.col("frequency").desc(), "correction")
    return close.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("word", "correction", "distance")
