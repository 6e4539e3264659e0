"""Corrections of long lists: no frame that is added up anew for each row, and equal p values share their last rank."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ridgeline.functions import ordered, stats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["de_status", "de_summary", "significant_pivot", "top_significant"])
def test_no_frame_ends_with_the_last_row(spark, monkeypatch, name):
    plans, running = [], stats.running
    monkeypatch.setattr(stats, "running", lambda *a, **b: plans.append((out := running(*a, **b))._jdf.queryExecution().analyzed().toString().lower()) or out)
    __spark_entry__.queries()[name](spark, SF)
    assert plans and not any("unboundedfollowing" in p for p in plans)


def test_equal_p_share_their_last_rank(spark, monkeypatch):
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.04, 0.04, 0.04, 0.5, None, None])] + [("h", 7, 0.04)], "grp string, id long, p double").repartition(5)
    for small in (ordered.SMALL, 0):
        monkeypatch.setattr(ordered, "SMALL", small)
        got = stats.bh_adjust(df, "p", "q", "grp")
        plans = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plans  # ranks are written, a row a distinct p
        assert [r.q if r.q is None else round(r.q, 12) for r in got.orderBy("id").collect()] == [0.05, 0.05, 0.05, 0.05, 0.5, None, None, 0.04]
        assert got.where(F.col("q").isNull()).count() == 2
