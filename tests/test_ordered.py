import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import ordered, stats


@pytest.fixture(params=["one range", "many ranges"])
def ranges(request, monkeypatch):
    if request.param == "many ranges":
        monkeypatch.setattr(ordered, "SMALL", 0)
        monkeypatch.setattr(ordered, "BROADCAST_ROWS", 3)


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, *[x / 8 for x in range(40)]]), rng.randrange(2)) for i in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "g string, id long, v double, label int").repartition(6)


def test_numbers_and_sums(spark, ranges):
    data = rows(1)
    got = ordered.numbered(table(spark, data), ["g"], [F.desc("v"), "id"]).collect()
    for g in ("a", "b", "c", None):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [x[1] for x in own]
    whole = ordered.numbered(table(spark, data), [], ["id"]).collect()
    assert all(r["rank"] == r.id + 1 for r in whole) and len(whole) == len(data)
    placed = ordered.in_ranges(table(spark, data), ["g"], ["id"])
    sums = {r.id: (r.s, r.low) for r in ordered.running(placed, ["g"], ["id"], {"s": F.col("label")}, {"low": F.col("v")}).collect()}
    for g in ("a", "b", "c", None):
        own = [x for x in data if x[0] == g]
        for i, x in enumerate(own):
            assert sums[x[1]] == (sum(y[3] for y in own[:i]), min((y[2] for y in own[i:] if y[2] is not None), default=None))


def test_mid_ranks(spark, ranges):
    data = [x for x in rows(2) if x[0]]
    got = {r.id: r["rank"] for r in stats.mid_ranks(table(spark, data), "v", "rank", "g").collect()}
    for x in data:
        own = [y[2] for y in data if y[0] == x[0] and y[2] is not None]
        want = None if x[2] is None else sum(v < x[2] for v in own) + (sum(v == x[2] for v in own) + 1) / 2
        assert got[x[1]] == want


def test_tests_and_corrections(spark, ranges):
    data = [x for x in rows(3) if x[0]]
    df = table(spark, data).withColumnsRenamed({"v": "value"})
    tests = {r.g: r for r in stats.mann_whitney(df, "g").collect()}
    aucs = {r.g: r.auc for r in stats.auc(df, "label", "value", "g").collect()}
    for g in "abc":
        one, zero = ([x[2] for x in data if x[0] == g and x[3] == k and x[2] is not None] for k in (1, 0))
        u = sum((a > b) + (a == b) / 2 for a in one for b in zero)
        both = one + zero
        assert tests[g].u == u and (tests[g].n1, tests[g].n0) == (len(one), len(zero)) and aucs[g] == pytest.approx(u / len(one) / len(zero))
        assert tests[g].tie_term == sum(both.count(v) ** 2 - 1 for v in both)
    adjusted = {r.id: r.q for r in stats.bh_adjust(df.withColumn("p", F.col("value") / 5), "p", "q", "g").collect()}
    for g in "abc":
        own = sorted((x[2] / 5, x[1]) for x in data if x[0] == g and x[2] is not None)
        least, want = 1.0, {}
        for i in range(len(own), 0, -1):
            least = min(least, own[i - 1][0] * len(own) / i)
            want[own[i - 1][1]] = least
        assert all(adjusted[i] == pytest.approx(v) for i, v in want.items())
    assert all(adjusted[x[1]] is None for x in data if x[2] is None) and len(adjusted) == len(data)
    whole = stats.bh_adjust(df.withColumn("p", F.col("value") / 5), "p", "q").agg(F.min("q")).first()[0]
    assert whole is not None


def test_empty(spark, ranges):
    empty = table(spark, []).withColumnsRenamed({"v": "value"})
    assert ordered.numbered(empty, ["g"], ["id"]).collect() == [] and stats.bh_adjust(empty, "value", "q", "g").collect() == [] and stats.mann_whitney(empty, "g").collect() == []
