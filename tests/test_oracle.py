"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from loomspark.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted(([plain(v) for v in r] for r in df[sorted(df)].astype(object).to_numpy()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect().execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
