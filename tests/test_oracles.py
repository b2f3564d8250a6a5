"""Every query against its SQL counterpart on an independent engine, value by value."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from messlab.plans.catalog import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def cell(value):
    if pd.isna(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame: pd.DataFrame) -> list[str]:
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(cell, row))) for row in ordered.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf, name):
    found = queries()[name](spark, sf).toPandas()
    wanted = duck.execute(oracle_sql()[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    assert entry(spark).count() > 0
