"""Dropping documents by id without shuffling the texts of those that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the set that is broadcast: 2 ** 17 words of 64 bits at most, whatever the input.
BITS_LOG2 = 23


def _place(column: str) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(column), F.lit(1 << BITS_LOG2))
    return F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def maybe_in(rows: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false if ``column`` is surely not in ``ids`` (one column).

    A bit set by hash, of a fixed size, is broadcast. The more ids, the more rows are flagged
    that are not among them; none that is among them is missed. Nulls are not flagged.
    """
    name = ids.columns[0]
    word, bit = _place(name)
    words = ids.filter(F.col(name).isNotNull()).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _place(column)
    marked = rows.withColumns({"_word": word, "_own": bit}).join(F.broadcast(words), "_word", "left")
    hit = F.col(column).isNotNull() & F.col("_bits").isNotNull() & (F.col("_own").bitwiseAND(F.col("_bits")) != 0)
    return marked.withColumn(flag, hit).drop("_word", "_own", "_bits")


def without_ids(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in ``dropped`` (doc_id); null ids stay, columns as they are.

    Rows that the bit set clears pass through as scanned; only the others are shuffled for the
    anti-join that decides. Columns are packed, so that no name clashes.
    """
    packed = documents.select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_row"))
    marked = maybe_in(packed, dropped.select(F.col("doc_id").alias("_drop")), "_id", "_maybe")
    stays = marked.filter(~F.col("_maybe")).select("_row")
    # An outer join and a filter: Catalyst would push an anti-join below the bit set's filter and
    # shuffle every row.
    gone = dropped.select(F.col("doc_id").cast("long").alias("_id")).distinct().withColumn("_gone", F.lit(True))
    decided = marked.filter("_maybe").join(gone, "_id", "left").filter("_gone IS NULL").select("_row")
    return stays.unionByName(decided).select("_row.*")
