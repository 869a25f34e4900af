"""Every catalogue query against DuckDB on the driver's smallest tables."""

import oracle
import pytest

from prismlake.plans import catalogue, upkeep  # noqa: F401 (adds its queries)


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    names, rows = oracle.rows_of_duck(duck, catalogue.ORACLE[name])
    assert names == sorted(df.columns)
    assert oracle.rows_of_spark(df) == rows


def test_entry_is_importable_and_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
