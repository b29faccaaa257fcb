import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quern.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(d: pd.DataFrame) -> list[str]:
    plain = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 5) if isinstance(x, (float, int)) or hasattr(x, "item") and not isinstance(x, bool) else str(x)
    return sorted(str(tuple(plain(x) for x in r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_is_its_sql(spark, con, name):
    got, want = own.QUERIES[name](spark, SF).toPandas(), con.execute(own.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_other_queries_run(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
