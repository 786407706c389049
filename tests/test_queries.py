"""Every query with SQL agrees with it; the others run."""

from __future__ import annotations

import os

import compare
import pytest

from evalloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    f = catalog.queries()[name]
    if name in SQL:
        assert not compare.difference(spark, name, f, SQL[name], SF)
    else:
        assert f(spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["greedy_tracks", "last_frame_miou", "suppression"])
def test_box_queries_without_sql_take_all_orders(spark, name):
    assert catalog.queries()[name](spark, SF).where("clip_id % 10 <> 0").limit(1).count() == 1
