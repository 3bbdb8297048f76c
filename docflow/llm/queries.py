"""Queries over this subpackage's operators, one opN_<name> each, on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from docflow.llm import oracles

#: Query name -> module of the operator.
MODULES = {
    "op1_hilbert_shards": "hilbert",
    "op2_language_id": "language_id",
    "op3_quality_bayes": "quality",
    "op4_avi_media": "avi",
    "op5_license_scan": "license_scan",
    "op6_bpe_tree": "bpe_tree",
    "op7_lsh_forest": "lsh_forest",
    "op8_exact_dedup": "digest_index",
    "op9_token_store": "token_store",
    "op10_systematic_mix": "mixing",
}


#: Tables that a query reads beside documents.
TABLES = {"op3_quality_bayes": ("labels",)}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    operator = getattr(import_module(f"docflow.llm.{MODULES[name]}"), name)
    return operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", *TABLES.get(name, ()))])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
