"""Every query against its SQL on the smallest tables; queries without SQL must give rows."""

import duckdb
import pandas as pd
import pytest

from tessitura.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"
Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def canon(x: pd.DataFrame) -> list:
    x = x[sorted(x.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in row) for row in x.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, name):
    got = Q[name](spark, D).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    else:
        assert len(got) > 0
