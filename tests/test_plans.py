"""Every plan against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import all_plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_plans()))
def test_plan(spark, db, name):
    run, sql = all_plans()[name]
    got = run(spark, SF).toPandas()
    assert len(got) > 0
    if sql:
        want = db.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry_module_works_alone(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
