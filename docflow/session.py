"""Session settings that the engine assumes, and a builder for local work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Semantics: timestamps in UTC, repeated map keys keep the last value.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Execution: let AQE choose partition counts, split skewed joins and switch join strategies.
EXECUTION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | None = None, memory: str = "8g", app: str = "docflow", **conf: str) -> SparkSession:
    """A session on this machine; on a cluster, bring your own and call `apply_semantics`."""
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    settings = SEMANTIC_CONF | EXECUTION_CONF | {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Set what results depend on, on a session that someone else configured."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark
