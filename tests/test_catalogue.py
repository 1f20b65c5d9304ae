import pytest

from kgspark.plans import catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)
