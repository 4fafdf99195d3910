import pytest

from foldloom.llm import queries as q

from ..compare import differences


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, small, name):
    assert differences(spark, small, name, q.queries()[name], q.oracle_sql()[name]) == ""
