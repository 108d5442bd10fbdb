"""Every query with SQL has the rows of its SQL; the others run and have columns."""

import pytest
from compare import connect, differences

from strandline.plans import all_queries, all_sql


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, small, con, name):
    got = all_queries()[name](spark, small).toPandas()
    if name in all_sql():
        assert not differences(got, con.execute(all_sql()[name]).df())
    else:
        assert len(got.columns)
