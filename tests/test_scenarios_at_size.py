"""Scenarios of the same samples share their filter and factors, and each is as if it were alone."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import expression
from ridgeline.plans import count_queries, scenario_queries

SF = "/root/testdata/sf0.001"
LEAST, IN_SAMPLES = 10, 2


@pytest.mark.parametrize("name", ["split_de", "de_wald"])
def test_factors_are_made_once_for_the_same_samples(spark, monkeypatch, name):
    seen, medians = [], expression.medians
    monkeypatch.setattr(expression, "medians", lambda df, *a: seen.append(df.groupBy("set", "category").count().collect()) or medians(df, *a))
    plans = scenario_queries if name in scenario_queries.QUERIES else count_queries
    plans.QUERIES[name](spark, SF)
    sets = {"split_de": 1, "threshold_split_de": 1, "de_wald": 1, "leave_one_out_de": 4}[name]
    assert len({r["set"] for r in seen[0]}) <= sets


def test_a_scenario_alone(spark):
    bulk, groups = count_queries.bulk(spark, SF), count_queries.split_groups(spark)
    every = expression.wald(bulk, groups, LEAST, IN_SAMPLES).where("scenario = '3'").orderBy("category", "gene").collect()
    alone = expression.wald(bulk, groups.where(F.col("scenario") == "3"), LEAST, IN_SAMPLES).orderBy("category", "gene").collect()
    assert every and [tuple(r)[:3] for r in every] == [tuple(r)[:3] for r in alone]
    assert all(a.padj == pytest.approx(b.padj) and a.stat == pytest.approx(b.stat) for a, b in zip(every, alone))
