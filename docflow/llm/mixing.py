"""Mixing sources to target weights by systematic sampling [native].

Each source gets a target by weight, stopped at a multiple of its own size; a document's expected
number of copies is its source's target over its source's size. The expected copies are prefix
summed within the source, one random offset is added, and the document is emitted once for each
integer boundary that its interval crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.ranks import ranked
from docflow.operators.skew import join_groups
from docflow.plans.staging import staged

#: Production parameters: weights by place of the source, share of all sizes, most copies, seed.
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "docflow-mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(value: Column, salt: str) -> Column:
    """A number in [0, 1) with 20 bits from the MD5 of salt and value (null as the empty string)."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources: (source, source_size) -> (source, source_size, target double).

    Sources by code point, null last, take the weights in turn. Together they share ``share`` of
    all sizes; a target stops at ``most`` times its source's size and the excess is shared anew
    by weight until none is above. That fixed point fills sources in the order of cap over
    weight: a source is capped while its weight's part of what is left reaches its cap, which
    running sums over the sorted sources decide at once. The table has one row per source (a
    dimension table), so its windows run unpartitioned.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_w", F.get(cycle, (F.row_number().over(place) - 1) % len(weights)))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = weighed.withColumns({"_left": left, "_wleft": weight_left})
    levels = levels.withColumn("_capped", F.col("_left") * F.col("_w") >= F.col("_cap") * F.col("_wleft"))
    # The first source that is not capped sets the level for all after it.
    first = F.row_number().over(full)
    levels = levels.withColumn("_i", first)
    at = F.min(F.when(~F.col("_capped"), F.struct("_i", "_left", "_wleft"))).over(every)
    levels = levels.withColumn("_at", at)
    target = F.when(F.col("_at").isNull() | (F.col("_i") < F.col("_at._i")), F.col("_cap")).otherwise(
        F.col("_at._left") * F.col("_w") / F.col("_at._wleft")
    )
    return levels.select("source", "source_size", F.least(target, F.col("_cap")).alias("target"))


def systematic_mix(df: DataFrame, source: Column, size: Column, ties: list[Column], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies`` int of each row.

    Within a source, rows run from small to large (then by a hash and ``ties``), so the copies of
    each size follow the expectation and the words taken miss the target by one large document
    at most. The offset comes from the seed and the source, so reruns agree. A hot source spans
    many ranges of the one range shuffle. Rows without words (null or blank text) have size 0
    and take part; a source of no size has target 0 and no copies. An empty table gives an
    empty result. Give ``df`` narrow, without texts.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # no source is a source of its own
    keyed = df.withColumns({"source": source, "size": size}).withColumn("_key", key)
    order = [F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("size"), *ties]
    placed = ranked(keyed, order, "mix", "_rank", "_total")
    stats = placed.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    stats = staged(stats, "sources")
    targets = source_targets(stats.select("source", "source_size"), weights, share, most).withColumn("_key", key)
    table = staged(stats.join(targets.select("_key", "target"), "_key").select("_key", "source_size", "target", "_first", "_rows"), "targets")
    rows = table.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    joined = join_groups(placed, table, "_key", "_rows", rows, ask=True)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("_rank") - F.col("_first")
    edge = lambda k: F.floor(k * F.col("_rate") + F.col("_offset"))
    copies = edge(i + 1) - edge(i)
    out = joined.withColumns({"_rate": rate, "_offset": unit_hash(F.col("source"), seed)})
    out = out.withColumn("copies", F.greatest(F.least(copies, F.lit(int(most))), F.lit(0)).cast("int"))
    return out.drop("_key", "_first", "_rows", "_rank", "_total", "_rate", "_offset")


def mixed_documents(documents: DataFrame, *more: Column) -> DataFrame:
    """`systematic_mix` of documents by source and words, with doc_id and ``more``.

    Texts are read once: the rows are staged with their sizes before the range shuffle samples them.
    """
    narrow = staged(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *more), "narrow")
    return systematic_mix(narrow, F.col("source"), F.col("size"), [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")])


def op10_systematic_mix(documents: DataFrame) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken long, copies int."""
    return mixed_documents(documents).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_rows(documents: DataFrame) -> DataFrame:
    """Documents as the mix takes them: each row as many times as it has copies, same columns.

    The mix is made on narrow rows and joined back by doc_id, so texts are shuffled once, evenly.
    Where doc_id repeats or is null it cannot tell rows apart, and whole rows go through the
    mix. Rows are packed in a struct, so that no column name clashes.
    """
    row = F.struct("*").alias("_row")
    copies = staged(mixed_documents(documents).select("doc_id", "copies"), "copies")
    rows, ids = copies.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        # A merge join at every size: the copies grow with the documents, so they are not broadcast.
        some = copies.filter("copies > 0").withColumnRenamed("doc_id", "_id").hint("merge")
        taken = documents.select(F.col("doc_id").alias("_id"), row).join(some, "_id")
    else:
        taken = mixed_documents(documents, row).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
