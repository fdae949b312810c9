"""Every registered query of the library against its SQL, value by value."""

import duckdb
import pandas as pd
import pytest

from trajecta.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return x.item() if hasattr(x, "item") else x

    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, isinstance(v, str), v) if v is not None else (True, False, 0) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_query_has_a_stable_name():
    assert set(ORACLE_SQL) <= set(QUERIES) and all(n.isidentifier() for n in QUERIES)
