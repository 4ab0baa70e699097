"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from boutlake.plans import catalog

from . import oracle


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLE:
        oracle.compare(df, con, catalog.ORACLE[name])
    else:
        assert df.count() > 0
