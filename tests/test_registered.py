"""Every registered report against its SQL on the smallest data set; the jobs are
compared by ``python -m checks.compare``, which takes longer."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect

DATA = "/root/testdata/sf0.001"
QUICK = [n for n in queries() if n.startswith("P")] + ["J01_daily_rollup", "J09_sweep_views", "J11_anonymised_views"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not here")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(spark, duck, DATA, queries()[name], oracle_sql()[name])
    assert ok, note


def test_entry_and_names(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
