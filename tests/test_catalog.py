import pytest

from foldloom import catalog

from .compare import differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, small, name):
    assert differences(spark, small, name, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, small, name):
    assert catalog.QUERIES[name](spark, small).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
