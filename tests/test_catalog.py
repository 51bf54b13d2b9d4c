"""Every query of the catalogue: against its SQL where it has one, else that it runs and holds no NaN."""

import math

import pytest

from axonframe.plans import catalog
from tests.frames import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same(df, duck, catalog.ORACLES[name])
    else:
        rows = df.collect()
        assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    from axonframe import model

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    model.bound_batches(spark)
    assert spark.conf.get(key) == "8m"
    spark.conf.set(key, "3m")
    model.bound_batches(spark)
    assert spark.conf.get(key) == "3m"
    spark.conf.set(key, before)
