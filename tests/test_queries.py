import duckdb
import pytest

from parley import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
