"""Written tables and joins whose frequent keys are dealt over several tasks."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is frequent with more rows than this, and more than one in so many of all rows (so there are fewer such keys than that).
FREQUENT_ROWS, FREQUENT_KEYS = 1_000, 100_000


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with files in the folder of spark.checkpoint.dir.

    Where no folder is set, a local session (tests) takes one of this machine; any other raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to any more.

    It deletes them when the driver's JVM collects garbage, which a driver of many small steps may
    not do for long, while the files stay on the executors' disks. Checkpoints go too where
    spark.cleaner.referenceTracking.cleanCheckpoints is set. Python's own dead handles go first, as
    each keeps a table of the JVM alive.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def frequent_limit(counts: DataFrame, count: str) -> int | None:
    """The rows over which a key is frequent, given ``counts`` by key; None if no key is."""
    total, largest = counts.agg(F.sum(count), F.max(count)).first()
    limit = max(FREQUENT_ROWS, -(-int(total or 0) // FREQUENT_KEYS))
    return limit if (largest or 0) > limit else None


def join_frequent(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", limit: int | None = -1) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, a frequent key of ``left`` dealt over several tasks.

    ``count`` is a column of ``right``: how many rows ``left`` has of the key, at
    most. Rows of a frequent key go to one of several slots by a hash of the row;
    ``right``'s rows of that key are repeated for each slot. Which keys are frequent
    is broadcast: fewer than FREQUENT_KEYS, by the rule itself. Without such keys
    it is a plain join. Null keys match nothing. ``right`` should be a written
    table, as it is read several times; ``limit`` saves one of these, if known.
    """
    limit = frequent_limit(right, count) if limit == -1 else limit
    if limit is None:
        return left.join(right, keys, how)
    slots = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    frequent = right.where(F.col(count) > limit).groupBy(*keys).agg(F.max(slots).alias("_slots"))
    dealt = left.join(F.broadcast(frequent), keys, "left")
    dealt = dealt.withColumn("_slot", F.pmod(F.xxhash64(*[F.col(f.name) for f in left.schema if "map<" not in f.dataType.simpleString()]), F.coalesce("_slots", F.lit(1))).cast("int")).drop("_slots")
    repeated = right.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.greatest(slots, F.lit(1)) - 1)))
    return dealt.join(repeated, [*keys, "_slot"], how).drop("_slot")
