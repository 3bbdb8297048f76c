"""Every registered query of the library at the smallest scale: a stable schema, and the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__
from docflow.plans import catalog, outputs  # noqa: F401  each registers its queries
from verify_oracle import TABLES, plain


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf, tables, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.schema == catalog.QUERIES[name](spark, sf).schema
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    if name not in catalog.ORACLES:
        return
    relation = tables.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == names
    theirs = relation.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall()
    shown = lambda found: sorted(str([plain(v) for v in r]) for r in found)
    assert shown(rows) == shown(theirs)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_does_not_import_the_subpackage():
    from pathlib import Path

    root = Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "docflow.llm" not in path.read_text()
