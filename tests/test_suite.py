"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from marlstone import suite

from .oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, name):
    same_rows(suite.QUERIES[name](spark, SF), suite.SQL[name], SF)
