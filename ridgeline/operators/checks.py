"""What must hold of a table at load, and sets of its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` if it has all columns; else a ValueError names those that it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_groups(df: DataFrame, column: str, groups: Sequence) -> DataFrame:
    """``df`` if each of ``groups`` has a row; else a ValueError names the empty ones."""
    found = {r[0] for r in df.where(F.col(column).isin(list(groups))).select(column).distinct().collect()}  # as many as ``groups`` at most
    if missing := [str(g) for g in groups if g not in found]:
        raise ValueError(f"groups without rows: {', '.join(missing)}")
    return df


def require_complete(df: DataFrame, column: str) -> DataFrame:
    """``df`` if no row lacks ``column``; else a ValueError says how many do."""
    if n := df.where(F.col(column).isNull()).count():
        raise ValueError(f"{n} rows without {column}")
    return df


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) by falling count, then by value; nulls don't count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "value")


def in_all(df: DataFrame, member: str, group: str) -> DataFrame:
    """(member): values that every group has."""
    pairs = df.select(F.col(member).alias("member"), F.col(group).alias("group")).distinct()
    groups = pairs.agg(F.countDistinct("group").alias("groups"))
    return pairs.groupBy("member").agg(F.count("group").alias("n")).join(F.broadcast(groups), F.col("n") == F.col("groups")).select("member")


def only_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` that ``right`` hasn't."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def same_values(left: DataFrame, right: DataFrame, column: str) -> bool:
    """Whether both have the same set of values."""
    return only_in(left, right, column).isEmpty() and only_in(right, left, column).isEmpty()


def comparison(results: dict[str, DataFrame | None]) -> DataFrame:
    """One row per name: its one-row result with status ``ok``, or status ``failed`` where there is none."""
    out = None
    spark = next(df for df in results.values() if df is not None).sparkSession
    for name, df in results.items():
        row = spark.createDataFrame([(name, "failed")], "name string, status string") if df is None else df.select(F.lit(name).alias("name"), F.lit("ok").alias("status"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
