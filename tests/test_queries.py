"""Every query of the engine against its SQL."""

import duckdb
import pytest

from millrace import exhibits

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def values(rows, columns):
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in rows[sorted(columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(exhibits.QUERIES))
def test_query(spark, sf, duck, name):
    got = exhibits.QUERIES[name](spark, sf).toPandas()
    if name in exhibits.ORACLES:
        want = duck.execute(exhibits.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got, got.columns) == values(want, want.columns)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
