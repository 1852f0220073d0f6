"""Every query over written files against its SQL, on the smallest tables."""

import pytest

from marlstone import scenarios

from .oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(scenarios.QUERIES))
def test_query(spark, name):
    same_rows(scenarios.QUERIES[name](spark, SF), scenarios.SQL[name], SF)
