"""Folds, splits, leave-one-out and label permutations as tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def outer_folds(animals: DataFrame) -> DataFrame:
    """(fold, control, exercised): every pair of one animal of each label; animals (animal, label) in order of their names as text.

    Pairs are as many as the two groups' sizes multiplied, by definition of the design.
    """
    names = animals.select(F.col("animal").cast("string").alias("animal"), "label").distinct()
    control, exercised = (names.where(F.col("label") == k).select(F.col("animal").alias(c)) for k, c in ((0, "control"), (1, "exercised")))
    return control.crossJoin(exercised).withColumn("fold", F.row_number().over(Window.orderBy("control", "exercised")) - 1)


def fold_sizes(folds: DataFrame, windows: DataFrame) -> DataFrame:
    """``folds`` with the numbers of training and test windows; ``windows``: animal, windows."""
    n = windows.select(F.col("animal").cast("string").alias("animal"), "windows")
    total = windows.agg(F.sum("windows").alias("all"))
    test = folds.join(n.toDF("control", "a"), "control").join(n.toDF("exercised", "b"), "exercised").withColumn("n_test", F.col("a") + F.col("b"))
    return test.crossJoin(F.broadcast(total)).select("fold", "control", "exercised", (F.col("all") - F.col("n_test")).alias("n_train"), "n_test")


def exact_splits(spark: SparkSession, items: list, choose: int) -> DataFrame:
    """(split, item, small): all ways to choose a small group, in lexicographic order."""
    rows = [(i, x, x in chosen) for i, chosen in enumerate(combinations(items, choose)) for x in items]
    return spark.createDataFrame(rows, f"split int, item {'string' if items and isinstance(items[0], str) else 'long'}, small boolean")


def leave_one_out(items: DataFrame, droppable: DataFrame) -> DataFrame:
    """(scenario, item): all items, then all but each of ``droppable``; both have ``item``."""
    scenarios = droppable.select(F.concat(F.lit("without_"), F.col("item").cast("string")).alias("scenario"), F.col("item").alias("gone"))
    rest = items.join(scenarios, items["item"] != F.col("gone")).select("scenario", "item")
    return items.select(F.lit("all").alias("scenario"), "item").unionByName(rest)


def label_permutations(spark: SparkSession, animals: list, labels: list[int], times: int, seed: int = 42) -> DataFrame:
    """(permutation, animal, label): labels shuffled over animals, reproducibly, in the order given."""
    rng = np.random.default_rng(seed)
    rows = [(p, a, int(y)) for p in range(1, times + 1) for a, y in zip(animals, np.array(labels)[rng.permutation(len(labels))])]
    return spark.createDataFrame(rows, "permutation int, animal string, label int")


def observed_rank(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Per ``by``: the observed value (``is_true``), how many reach it, of how many, and that share."""
    real = F.max(F.when(F.col("is_true"), F.col(value)))
    table = values.withColumn("observed", real.over(Window.partitionBy(*by)))
    reached = F.count_if(F.col(value) >= F.col("observed"))
    return table.groupBy(*by).agg(F.max("observed").alias("observed"), reached.alias("reached"), F.count(value).alias("splits"), (reached / F.count(value)).alias("p"))
