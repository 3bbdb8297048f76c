"""Structured Streaming: new files and texts through the same ingestion and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from docflow.operators import parsers
from docflow.sources.ingest import ingest

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files as they come: source_name, raw_bytes, raw_text, arrived."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("source_name"), F.col("content").alias("raw_bytes"), F.lit(None).cast("string").alias("raw_text"), F.col("modificationTime").alias("arrived"))


def sections(stream: DataFrame) -> DataFrame:
    """Sections of the stream's text documents; stateless, so each row is handled once."""
    return parsers.parse(ingest(stream).filter("routing_target = 'text_handler' AND error IS NULL"))


def arrivals(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files and bytes per window of arrival and name extension; later than ``late`` is dropped."""
    extension = F.regexp_extract("source_name", r"(\.[^./]+)$", 1)
    grouped = stream.withWatermark("arrived", late).groupBy(F.window("arrived", window), extension.alias("extension"))
    return grouped.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("raw_bytes")).alias("bytes"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events (user_id, ts) per session of a user: a pause of ``gap`` ends one."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return grouped.agg(F.count(F.lit(1)).alias("events"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet exactly once; with ``once`` what is there is taken and the query ends."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


class Progress(StreamingQueryListener):
    """Rows and batches so far, for a progress display."""

    def __init__(self) -> None:
        self.batches, self.rows, self.ended = 0, 0, False

    def onQueryStarted(self, event):
        self.ended = False

    def onQueryProgress(self, event):
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended = True
