"""The registry of queries and what they share: tables, conversations as texts, white space in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"), F.lit("text/plain").alias("mime_type"), "lang")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """One Markdown text per conversation: a heading with the role before each turn."""
    turn = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    listed = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: x["t"]), "\n\n")
    return listed.select(F.col("conv_id").alias("document_id"), text.alias("raw_text"), F.lit("text/markdown").alias("mime_type"))


#: The same texts in SQL.
CONVERSATIONS = r"""(SELECT conv_id AS document_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS raw_text
 FROM conversations GROUP BY conv_id)"""
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip_sql(text: str) -> str:
    return _STRIP.format(text)


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Counts as bigint, so that both engines agree on types."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in columns or df.columns])
