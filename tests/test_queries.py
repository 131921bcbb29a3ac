import pytest
from oracle import both, duck

from sievework import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf_dir, con, name):
    got, want = both(Q.QUERIES[name](spark, sf_dir), Q.SQL[name], con)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows(spark, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))
