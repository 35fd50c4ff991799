"""Registered queries against their DuckDB SQL at the smallest scale."""

import compare
import pytest

from halocline.plans import core, more

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(core.SQL | more.SQL))
def test_query_agrees(spark, con, name):
    said = compare.compare(spark, con, (core.QUERIES | more.QUERIES)[name], (core.SQL | more.SQL)[name], SF)
    assert not said, said
