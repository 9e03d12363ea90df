"""Every query against its SQL in DuckDB; queries without SQL run and give rows."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lexarium.plans import registry
from tests.conftest import SF, TABLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/*.parquet'" if os.path.isdir(at) else f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def value(x):
        if pd.isna(x):
            return None
        return float(x) if isinstance(x, (float, decimal.Decimal)) else int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, db, name):
    found, wanted = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
