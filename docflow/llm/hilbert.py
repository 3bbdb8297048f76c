"""Sharding by Hilbert-curve order [native].

Several metadata dimensions are quantised to a few bits each, the cell's index on the Hilbert
curve is computed by a fold over bit planes, rows are ordered by (index, tie-breakers), and the
order is cut into runs. Cells are quantiles that follow the order of a dimension's values, and
neighbouring rows share ranges of every dimension, so the least and largest values of each run
prune files for filters on any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.ranks import ranked, running_total
from docflow.plans.staging import staged


def curve_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """Entry corner, direction and Gray-code rank of each of the 2**dims sub-cells, by rule."""
    cells = range(1 << dims)
    gray = [i ^ (i >> 1) for i in cells]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in cells]

    def trailing_ones(i: int) -> int:
        return (i ^ (i + 1)).bit_length() - 1

    direction = [0 if i == 0 else (trailing_ones(i - 1) if i % 2 == 0 else trailing_ones(i)) % dims for i in cells]
    rank = [gray.index(c) for c in cells]
    return entry, direction, rank


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point whose coordinates are integers in [0, 2**bits).

    The state of the walk (entry corner and direction) is folded over the bit planes from the
    top; all tables have 2**dims entries and are literals. Null coordinates give null.
    """
    dims = len(cells)
    if dims < 2 or dims * bits > 62:
        raise ValueError("two dimensions at least, and 62 bits in all at most")
    mask = (1 << dims) - 1
    entry, direction, rank = (F.array(*map(F.lit, t)) for t in curve_tables(dims))

    def shift(x: Column, by: Column, left: bool) -> Column:
        return F.call_function("shiftleft" if left else "shiftright", x, by)

    def rotate_right(x: Column, by: Column) -> Column:
        return shift(x, by, False).bitwiseOR(shift(x, F.lit(dims) - by, True)).bitwiseAND(F.lit(mask))

    def rotate_left(x: Column, by: Column) -> Column:
        return shift(x, by, True).bitwiseOR(shift(x, F.lit(dims) - by, False)).bitwiseAND(F.lit(mask))

    def plane(i: Column) -> Column:
        parts = [shift(shift(c.cast("int"), i, False).bitwiseAND(F.lit(1)), F.lit(k), True) for k, c in enumerate(cells)]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    def step(acc: Column, i: Column) -> Column:
        turn = ((acc["d"] + 1) % dims).cast("int")
        w = F.get(rank, rotate_right(plane(i).bitwiseXOR(acc["e"]), turn))
        return F.struct(
            shift(acc["h"], F.lit(dims), True).bitwiseOR(w.cast("long")).alias("h"),
            acc["e"].bitwiseXOR(rotate_left(F.get(entry, w), turn)).alias("e"),
            ((acc["d"] + F.get(direction, w) + 1) % dims).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def quantile_bounds(df: DataFrame, column: str, cells: int) -> list[tuple]:
    """(value, cell) ascending, ``cells`` at most: the least value of each cell that has one.

    A value's cell is the part of all rows, of ``cells`` equal ones, in which the middle of its
    rows lies: few values spread over all cells, a hot one has its own. Distinct values are
    counted with partial aggregation and ordered by ranges; only the bounds reach the driver.
    Nulls do not count; without values there are no bounds.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(values, [F.col("value")], "n", "values", "_before", "_total")
    cell = F.floor((F.col("_before") + F.col("n") / 2) * cells / F.col("_total")).cast("int")
    return sorted((r.first, r.cell) for r in placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("first")).collect())


def quantile_cell(value: Column, bounds: list[tuple]) -> Column:
    """The cell of the last bound that the value reaches; null is cell 0."""
    found = [F.when(value >= F.lit(first), F.lit(cell)) for first, cell in reversed(bounds)]
    return F.coalesce(*found, F.lit(0))


def hilbert_shards(df: DataFrame, cells: list[Column], bits: int, shards: int, ties: list[Column], law: str = "rows", size: Column | None = None) -> DataFrame:
    """``df`` with ``hilbert`` long, ``shard`` int (0 to shards - 1) and ``slot`` long.

    ``law`` ``rows`` cuts the order into runs whose row counts are at most one apart; slots are
    gapless from 0 in each shard. Rows with the same cell are ordered by ``ties``; end them in a
    near-unique column, then a hot cell (a third of all rows in one source, say) is spread over
    ranges and shards. An empty table gives an empty result; null dimensions are cell 0;
    repeated rows are rows of their own. ``df`` may have any other columns except those named
    here: narrow it before, since its rows are shuffled once.
    """
    if law != "rows":
        raise ValueError("only the law 'rows' is cut here")
    if shards < 1:
        raise ValueError("at least one shard")
    placed = ranked(df.withColumn("hilbert", hilbert_index(cells, bits)), [F.col("hilbert"), *ties], "hilbert")
    shard = F.expr(f"(rank * {shards}) div n_rows").cast("int")
    first = F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")  # rows before the shard, rounded up
    return placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop("rank", "n_rows")


#: Production parameters of the query: dimensions, bits of each, shards.
DIMENSIONS, SHARDS, BITS = ("source", "lang", "size"), 16, 4


def document_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, hilbert, shard, slot of every document.

    Texts are read once: the narrow rows are staged before their quantiles and ranges are taken.
    """
    narrow = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        "source",
        "lang",
    )
    table = staged(narrow, "narrow")
    cells = [quantile_cell(F.col(c), quantile_bounds(table, c, 1 << BITS)) for c in DIMENSIONS]
    return hilbert_shards(table, cells, BITS, shards, [F.col("doc_id"), F.col("text_crc32")])


def shard_ranges(placed: DataFrame, columns: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row a shard: rows, and the least and largest value and the nulls of each column."""
    per = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count(F.when(F.col(c).isNull(), 1))))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *per)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Documents written as files of one shard each below ``path``/data, in the order of the curve.

    Returns `shard_ranges`, also written to ``path``/ranges, from which a reader picks the shards
    that a filter can touch; inside a file, Parquet's statistics prune row groups in turn.
    doc_id must be unique and not null, since places are joined back by it; texts are shuffled
    by ranges of the order, so a shard may have several files and no task holds a shard.
    """
    spark = documents.sparkSession
    placed = staged(document_shards(documents, shards), "placed")
    rows, ids = placed.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows != ids:
        raise ValueError("doc_id is not unique")
    where = placed.select(F.col("doc_id").alias("_id"), "shard", "slot").hint("merge")
    joined = documents.join(where, F.col("doc_id") == F.col("_id")).drop("_id")
    ordered = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.drop("slot").write.partitionBy("shard").parquet(f"{path}/data")
    shard_ranges(placed).coalesce(1).write.parquet(f"{path}/ranges")
    return spark.read.parquet(f"{path}/ranges")


def op1_hilbert_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards of documents by (source, language, size); contract columns and the curve index.

    doc_id, size long (UTF-8 bytes plus 1; null text: 1), text_crc32 long (null as empty), law
    ``rows``, shard, slot, grown_shard (null: the law is not ``key``), hilbert.
    """
    return document_shards(documents, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
