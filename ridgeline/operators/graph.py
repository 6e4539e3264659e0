"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shuffles import checkpoint, frequent_limit, join_frequent, let_go


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; a component's name is its smallest node.

    Labels start at the smallest neighbour. In each round an edge offers the label
    at one end to the other end and to that end's own label, then labels of labels
    are taken; the number of rounds grows with the logarithm of the longest path.
    All steps are joins and minima; each round is checkpointed and the files of the last one deleted. The edges of a
    hub and the nodes of a large component are dealt over several tasks. Null ends
    are ignored; a loop names its node alone.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = checkpoint(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node"))
    hubs = frequent_limit(labels, "degree")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"), F.col("degree").alias("na"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("degree").alias("nb"))
        ends = join_frequent(join_frequent(both, left, ["a"], "na", limit=hubs).drop("na"), right, ["b"], "nb", limit=hubs).where("lb < la")
        offers = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("lb").alias("label")), F.struct(F.col("la").alias("node"), F.col("lb").alias("label")))).alias("x")).select("x.*")
        moved = checkpoint(offers.groupBy("node").agg(F.min("label").alias("offer")))
        if moved.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        hooked = checkpoint(labels.join(moved, "node", "left").select("node", F.least("label", "offer").alias("label"), "degree"))
        parents = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        known = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(parents, "label")
        limit = frequent_limit(hooked.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "n")
        jumped = hooked.join(parents, "label") if limit is None else join_frequent(hooked, checkpoint(known), ["label"], "n", limit=limit)
        labels = checkpoint(jumped.select("node", F.least("label", "above").alias("label"), "degree"))
        let_go(labels.sparkSession)
