"""Every query that has SQL gives the rows of its SQL; the others run."""

import pytest

from oracle import assert_same, connect
from tessera import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(name, spark, sf_dir, db):
    assert_same(catalog.QUERIES[name](spark, sf_dir), db, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
