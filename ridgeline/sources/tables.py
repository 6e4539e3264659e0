"""Adapters from the driver's tables: series, sparse counts, points, gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(animal, label, pos, v): one series per user in order of time, less its mean."""
    user = Window.partitionBy("user_id")
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return events.select(
        F.col("user_id").alias("animal"), (F.col("user_id") % 2).alias("label"),
        (F.row_number().over(user.orderBy("ts", "event_id")) - 1).alias("pos"),
        (F.col("value") - F.avg("value").over(user)).alias("v"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, bead, gene, category, n): counts as they are listed; coordinates may repeat, so this is for sums."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("sample"), F.col("l_orderkey").alias("bead"), F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("category"), F.col("l_quantity").cast("long").alias("n"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, bead, gene, category, n): sparse counts, summed over repeated coordinates; what is absent is zero."""
    return places(spark, sf_dir).groupBy("sample", "bead", "gene", "category").agg(F.sum("n").alias("n"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x, y): points in the plane."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def gene_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, entrez): several symbols may share an entrez."""
    part = read(spark, sf_dir, "part").select("p_partkey")
    size = part.count()
    return part.select(F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % F.lit(max(1, size * 9 // 10))).alias("entrez"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("gene"))
