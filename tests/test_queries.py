import pytest
from compare import compare, duck

import __spark_entry__ as entry

CORE = sorted(n for module in entry.MODULES if ".llm" not in module.__name__ for n in module.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, sf, con, name):
    ok, said = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert ok is not False, said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
