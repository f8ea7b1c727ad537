import os

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and all(f"p{n}_found" in q for n in (1, 3, 4, 6))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    assert e.entry(spark).count() > 0
