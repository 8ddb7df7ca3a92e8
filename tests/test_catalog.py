import pytest
from compare import duck, rows

from quarry.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = rows(QUERIES[name](spark, sf).toPandas())
    if name in ORACLES:
        assert got == rows(duck(sf, ORACLES[name]))
    else:
        assert got[0]
