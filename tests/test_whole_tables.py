"""Queries over whole tables grow with them."""

import pytest

from tallyspark import plans

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
GROWING = {"journal_findings": "n", "journal_findings_all": "n", "refresh_problems": "n"}


@pytest.mark.parametrize("name", list(GROWING))
def test_sums_grow_with_the_table(spark, name):
    a, b = (sum(r[GROWING[name]] for r in plans.QUERIES[name](spark, d).collect()) for d in (SMALL, LARGER))
    assert b > 5 * a
