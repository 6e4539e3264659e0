import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import stats


def test_bh_on_known_values(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,), (0.8,), (None,)], "p double")
    got = {r.p: r.q for r in stats.bh_adjust(df, "p", "q").collect()}
    assert got.pop(None) is None
    assert {k: round(v, 9) for k, v in got.items()} == {0.01: 0.025, 0.04: 0.05, 0.03: 0.05, 0.005: 0.025, 0.8: 0.8}
    bonferroni = {r.p: r.q for r in stats.bonferroni(df, "p", "q").collect()}
    assert bonferroni[0.04] == pytest.approx(0.2) and bonferroni[0.8] == 1.0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.2), (1, 0.8)], "y int, p double")
    assert stats.auc(df, "y", "p").first()["auc"] == 0.875
    assert stats.auc(df.where("y = 1"), "y", "p").first()["auc"] is None


def test_medians_of_groups_of_all_sizes(spark):
    rng = np.random.default_rng(0)
    groups = {**{g: rng.normal(size=g) for g in (1, 2, 3, 4, 9, 10, 1000, 1001, 6001, 20000)}, 30: np.ones(30), 3000: np.repeat([1.0, 5.0], 1500)}
    df = spark.createDataFrame([(g, float(v), i) for g, x in groups.items() for i, v in enumerate(x)], "g long, v double, w long").repartition(4)
    got = {r.g: (r.n, r.median_v, r.median_w) for r in stats.medians(df, ["v", "w"], "g").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == (len(x), pytest.approx(np.median(x), abs=1e-12), (len(x) - 1) / 2)
    nulls = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "g string, v double")
    assert {r.g: (r.n, r.median_v) for r in stats.medians(nulls, ["v"], "g").collect()} == {"a": (1, None), "b": (2, 1.0)}


def test_mann_whitney_exact(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 4.0), (0, 1.0), (0, 2.0)], "label int, value double").withColumn("feature", F.lit("f"))
    row = stats.mann_whitney_p(stats.mann_whitney(df, "feature")).first()
    assert row["u"] == 4 and row["p"] == pytest.approx(1 / 3)


def test_exact_probability_by_enumeration():
    from itertools import combinations

    n1, n0 = 4, 5
    us = []
    for c in combinations(range(n1 + n0), n1):
        us.append(sum(c) + n1 - n1 * (n1 + 1) / 2)
    for u in (0, 3, 10, 14, 20):
        tail = max(u, n1 * n0 - u)
        assert stats.exact_u_probability(u, n1, n0) == pytest.approx(min(1, 2 * np.mean([x >= tail for x in us])))


def test_normal_tail(spark):
    z = [0.0, 0.5, 1.0, 1.96, 3.0, 5.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(r.z / math.sqrt(2)) / 2) < 1e-7 for r in rows)


def test_cohens_d(spark):
    rows = [("f", 0, 1.0), ("f", 0, 3.0), ("f", 1, 4.0), ("f", 1, 6.0), ("g", 0, 1.0), ("g", 0, 1.0), ("g", 1, 2.0), ("g", 1, 2.0)]
    df = spark.createDataFrame(rows, "feature string, label int, value double")
    got = {r.feature: r.cohens_d for r in stats.group_summary(df).collect()}
    assert got["f"] == pytest.approx(3 / math.sqrt(2)) and got["g"] is None


def test_wilson_is_symmetric_at_half(spark):
    low, high = stats.wilson(F.lit(8.0), F.lit(16.0))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert row["low"] + row["high"] == pytest.approx(1) and row["low"] == pytest.approx(0.28003, abs=1e-4)


@pytest.mark.parametrize("df,want", [(1, 12.7062), (5, 2.57058), (30, 2.04227), (63, 1.99834)])
def test_t_quantile(df, want):
    assert stats.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)
    assert stats.t_quantile(0.025, df) == pytest.approx(-want, abs=1e-4)


def test_permutation_modes(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "v double")
    row = df.select(*[stats.permutation_p(F.col("v"), F.lit(0.5), m).alias(m) for m in ("plus_one", "plain", "lower")]).first()
    assert (row["plus_one"], row["plain"], row["lower"]) == (0.75, pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_signif(spark):
    row = spark.range(1).select(stats.signif(F.lit(0.00123456)).alias("a"), stats.signif(F.lit(-98765.0), 2).alias("b"), stats.signif(F.lit(0.0)).alias("c")).first()
    assert (round(row["a"], 9), row["b"], row["c"]) == (0.00123, -99000.0, 0.0)


def test_t_interval_of_one_value(spark):
    row = stats.t_interval(spark.createDataFrame([(2.5,)], "v double"), "v").first()
    assert (row["mean"], row["low"], row["high"]) == (2.5, 2.5, 2.5)


def test_intervals_have_their_published_values(spark):
    low, high = stats.wilson(F.lit(8.0), F.lit(10.0))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert abs(row.low - 0.4901625) < 1e-6 and abs(row.high - 0.9433178) < 1e-6
    row = stats.t_interval(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double"), "v").first()
    assert abs(row.low - 0.4457397) < 1e-5 and abs(row.high - 4.5542603) < 1e-5


def test_large_groups_never_reach_the_exact_count(spark, monkeypatch):
    rows = [("f", i % 2, float(i)) for i in range(3000)] + [("g", i % 2, float(i * i)) for i in range(12)]
    long = spark.createDataFrame([(i, y, f, v) for i, (f, y, v) in enumerate(rows)], "animal int, label int, feature string, value double")
    got = {r.feature: r.p for r in stats.mann_whitney_p(stats.mann_whitney(long, "feature")).collect()}
    assert got["g"] == stats.exact_u_probability(21.0, 6, 6) and 0.9 < got["f"] <= 1.0
