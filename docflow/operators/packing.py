"""Packing pieces of text into chunks of bounded size, with overlap; tokens are words.

The greedy rule depends on order, so each document's pieces are folded inside its row: no
shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import strip
from docflow.operators.chunking import paragraphs, sentences

MOST, OVERLAP = 512, 64


def tokens(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?U)\s+", -1), lambda t: t != "")


def pack(pieces: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Chunks of at most ``most`` tokens, but for a piece that is longer or an overlap before it.

    A chunk is closed when the next piece would not fit; its last ``overlap`` tokens begin the next.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the size")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        own, now = tokens(piece), acc["now"]
        full = (F.size(now) > 0) & (F.size(now) + F.size(own) > most)
        carried = F.slice(now, F.greatest(F.lit(1), F.size(now) - overlap + 1), F.lit(overlap)) if overlap else none
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(now, " "))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, carried).otherwise(now), own).alias("now"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], F.array_join(acc["now"], " "))).otherwise(acc["done"]))


def windows(text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Windows of ``most`` tokens, ``most`` - ``overlap`` apart, until one reaches the end."""
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the size")
    own = tokens(text)
    last = F.greatest(F.lit(0), F.size(own) - overlap - 1)
    starts = F.sequence(F.lit(0), last, F.lit(most - overlap))
    return F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(own, s + 1, F.lit(most)), " ")))


def packed_chunks(documents: DataFrame, text: str = "raw_text", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, text) -> document_id, chunk_index, strategy, text.

    Paragraphs are packed where there are several, else sentences, else windows slide over tokens.
    """
    by_paragraph, by_sentence = paragraphs(F.col(text)), sentences(F.col(text))
    strategy = F.when(F.size(by_paragraph) > 1, "paragraph").when(F.size(by_sentence) > 1, "sentence").otherwise("sliding_window")
    chunks = F.when(F.size(by_paragraph) > 1, pack(by_paragraph, most, overlap)).when(F.size(by_sentence) > 1, pack(by_sentence, most, overlap)).otherwise(windows(F.col(text), most, overlap))
    return documents.select("document_id", strategy.alias("strategy"), F.posexplode(chunks).alias("chunk_index", "text")).select("document_id", "chunk_index", "strategy", "text")
