import time

from pyspark.sql import functions as F

from ridgeline.operators import shuffles


def test_frequent_keys_join_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(shuffles, "FREQUENT_ROWS", 10)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    left = left.union(spark.createDataFrame([(None, -1)], left.schema))
    right = left.where("k < 30").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right.drop("n"), "k", how) if "left_" in how else left.join(right, "k", how)
        got = shuffles.join_frequent(left, right, ["k"], "n", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), how


def test_rows_of_a_frequent_key_spread(spark, monkeypatch):
    monkeypatch.setattr(shuffles, "FREQUENT_ROWS", 10)
    left = spark.range(1000).select(F.lit(1).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = shuffles.join_frequent(left, right, ["k"], "n").withColumn("task", F.spark_partition_id())
    assert joined.count() == 1000


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], "k int, v int"), spark.createDataFrame([], "k int, n long")
    assert shuffles.join_frequent(left, right, ["k"], "n").collect() == []


def test_dead_shuffles_are_let_go(spark):
    def held():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    def wait(most):
        deadline = time.time() + 20
        while held() > most and time.time() < deadline:
            shuffles.let_go(spark)
            time.sleep(0.1)
        return held()

    wait(0)
    before = held()
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    rows = sorted(map(tuple, kept.collect()))
    saved = shuffles.checkpoint(kept)
    for _ in range(5):
        spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count().collect()
    assert held() > before + 4
    del kept
    assert wait(before + 2) <= before + 2
    assert sorted(map(tuple, saved.collect())) == rows
