import pytest

from pulsegrid.registry import ORACLES, QUERIES

from .conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLES[name], SF)
