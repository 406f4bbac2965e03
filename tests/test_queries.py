"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

from quarrymill.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = oracle.spark_rows(registry.QUERIES[name](spark, sf_dir))
    assert got == oracle.sql_rows(duck, registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 189
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
