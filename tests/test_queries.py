"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from lumenflow.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return str(round(float(v), 5) + 0.0)
        return str(v)

    df = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    for df in (got, want):
        for c in df.columns:
            if str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].astype("datetime64[us]").astype(str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
