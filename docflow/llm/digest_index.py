"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest, kept under a path. New data is
digested once, reduced to one row per digest, sort-merge anti-joined with the index (the index
side needs no shuffle) and the digests that it lacks are appended in the same bucketing.

Appending is safe to repeat: an attempt's digests count only once the attempt is committed, which is
its last step, after the batch's verdicts are stored. A run that failed is started again and finds
none of its own digests; one that was committed gives its stored verdicts again.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.arrow import map_rows, utf8
from docflow.llm.filters import without_ids
from docflow.operators.skew import join_groups
from docflow.plans.staging import new_path, staged


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_digests(documents: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 (hex) of the text with A-Z lower-cased, as UTF-8; null is empty.

    Lower-casing touches ASCII letters only, so it is done on bytes in Arrow batches, one text
    at a time.
    """
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.string())])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = utf8(batch.column(1))
        return {"doc_id": batch.column(0), "digest": [hashlib.sha256((t or b"").lower()).hexdigest() for t in texts]}

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], "doc_id long, digest string", work, out)


class DigestIndex:
    """A digest index at ``path``: (digest, keep_id, attempt), one row per digest, in ``buckets`` buckets.

    ``path``/digests holds the table, ``path``/verdicts the stored verdicts of each attempt and
    ``path``/begun and ``path``/committed a file named for each attempt. The table is external: its
    files persist, and the catalogue entry is made again by whichever session opens it and goes
    with `close`. One writer at a time may run.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self._open = False

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Drop the catalogue entry; the files stay."""
        if self._open:
            self.spark.sql(f"DROP TABLE {self.table}")
            self._open = False

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> set[str]:
        path, fs = self._file(folder)
        return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()

    def _mark(self, folder: str, attempt: str) -> None:
        path, fs = self._file(folder, attempt)
        fs.create(path, False).close()

    def begin(self, run: str) -> str:
        """A new attempt at a run; what earlier attempts left without committing is ignored."""
        attempt = f"{run}-{uuid.uuid4().hex}"
        self._mark("begun", attempt)
        return attempt

    def commit(self, attempt: str) -> None:
        self._mark("committed", attempt)

    def committed(self, run: str) -> str | None:
        """The attempt that committed the run."""
        return next((a for a in self._names("committed") if a.rpartition("-")[0] == run), None)

    def verdict_path(self, attempt: str) -> str:
        return f"{self.path}/verdicts/{attempt}"

    def read(self, attempt: str | None = None) -> DataFrame | None:
        """(digest, keep_id) of committed attempts and of ``attempt``; None if there is no table yet."""
        if not self._open:
            path, fs = self._file("digests")
            if not fs.exists(path):
                return None
            self._declare()
        dead = sorted(self._names("begun") - self._names("committed") - {attempt})
        found = self.spark.table(self.table)
        return (found.filter(~F.col("attempt").isin(dead)) if dead else found).select("digest", "keep_id")

    def _declare(self) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, attempt STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        self._open = True

    def unseen(self, groups: DataFrame, attempt: str | None = None) -> DataFrame:
        """Rows of ``groups`` (digest, ...) whose digest the index lacks."""
        known = self.read(attempt)
        if known is None:
            return groups
        return groups.hint("merge").join(known.select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, attempt: str) -> None:
        """Add (digest, keep_id) rows, one file per bucket; each file is sorted by digest."""
        self.read()
        rows = fresh.select("digest", "keep_id", F.lit(attempt).alias("attempt")).repartition(self.buckets, "digest")
        if not self._open:
            self._declare()
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)


VERDICT = "doc_id long, keep_id long, group_size long, kept boolean, digest string"


def deduplicate(documents: DataFrame, index: DigestIndex, run: str | None = None) -> DataFrame:
    """Deduplicate ``documents`` (doc_id, text) against the index and append what is new.

    Returns one row per row of ``documents``: doc_id, keep_id (of a digest that the index had:
    its keep_id; of a new one: the largest doc_id of its group), group_size long (rows of this
    batch with the digest), kept boolean (this row stays: its digest is new and it is the first
    of the rows with that doc_id), digest.

    ``run`` names the batch, for repeats: a run that was committed returns its stored verdicts and
    appends nothing; one that failed before starts anew. Without a name the batch is a new run.

    Null texts count as empty and are one group. Rows with a null doc_id lose to any other row;
    a group of null ids alone keeps one row, with a null keep_id. A row repeated with the same
    doc_id and text is kept once per id: all its repeats say ``kept``, since they are the same
    document. An empty table gives an empty result. Only doc_id and text are read, so other
    columns and their names do not matter.

    Digests are staged once (about 70 bytes a row) and fed in two batches, the larger ids first, so
    that the second is anti-joined with what the first appended and the index holds the largest
    id of each new digest. The verdicts are then read from the index. Batches are grouped with
    map-side partial aggregation, so a group of any size costs one row per task. Rows take their
    group back by a join on the digest, those of hot digests by a broadcast of bounded size.
    """
    spark = documents.sparkSession
    if attempt := run and index.committed(run):
        return spark.read.schema(VERDICT).parquet(index.verdict_path(attempt))
    attempt = index.begin(run or uuid.uuid4().hex)
    digests = staged(text_digests(documents), "digests")
    rows, low, high = digests.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    first = F.lit(False) if low is None else F.coalesce(F.col("doc_id") > (low + high) // 2, F.lit(False))
    anew = index.read() is None
    groups, fresh = [], []
    for batch in (first, ~first):
        grouped = digests.filter(batch).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups.append(staged(grouped, "groups"))
        fresh.append(staged(index.unseen(groups[-1], attempt).select("digest", "keep_id"), "fresh"))
        index.append(fresh[-1], attempt)
    sizes = groups[0].union(groups[1]).groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    found = sizes.hint("merge").join(index.read(attempt).hint("merge"), "digest")
    if anew:
        found = found.withColumn("_new", F.lit(True))
    else:
        new = fresh[0].union(fresh[1]).select("digest", F.lit(True).alias("_new"))
        found = found.join(new, "digest", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    verdicts = staged(found.select("digest", "keep_id", "group_size", "_new"), "groups")
    both = join_groups(digests, verdicts, "digest", "group_size", rows)
    kept = F.col("_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest").write.parquet(index.verdict_path(attempt))
    index.commit(attempt)
    return spark.read.schema(VERDICT).parquet(index.verdict_path(attempt))


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, with a bucket for each shuffle partition."""
    return DigestIndex(spark, new_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def drop_copies(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Documents with one row of each group of equal texts left; other columns stay as they are.

    Where doc_id is unique and never null, copies are dropped by id and the texts that stay are
    not shuffled. Else ids cannot tell rows apart, and one row of each digest is taken whole.
    """
    with index or new_index(documents.sparkSession) as own:
        found = deduplicate(documents, own)
    rows, ids = found.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        return without_ids(documents, found.filter(~F.col("kept")).select("doc_id"))
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), 256)
    packed = documents.select(digest.alias("digest"), F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_row"))
    wanted = found.filter("kept").select("digest").distinct()
    one = packed.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.coalesce(F.max_by("_row", "_id"), F.first("_row")).alias("_row"))
    return one.select("_row.*")


def op8_exact_dedup(documents: DataFrame) -> DataFrame:
    """All documents against a new index: doc_id, keep_id, group_size, kept, text_sha256."""
    with new_index(documents.sparkSession) as index:
        return deduplicate(documents, index).withColumnRenamed("digest", "text_sha256")
