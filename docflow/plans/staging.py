"""Shared staging folders: tables written once and read by later jobs.

Stages that are read more than once are written as Parquet under the folder which the cluster
names in ``spark.checkpoint.dir``. Every executor and the driver see it, a lost executor loses
nothing that was written, and Spark's commit protocol makes retried tasks safe.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset (tests, a local session) and the
    master is local, a temporary folder is set; on a cluster an unset folder is an error, since
    no machine-local folder would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docflow/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete this application's staged tables; call it when results that read from them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
