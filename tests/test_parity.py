"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

from conftest import rows_of
from quern.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(ORACLES[name]).df()
    whole = [c for c in got.columns if str(got[c].dtype).startswith("float") and str(want[c].dtype) in ("Int64", "int64")]
    got = got.astype({c: "Int64" for c in whole})
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
