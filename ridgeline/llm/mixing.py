"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in that source's shuffle (the order of
a hash of its id). Its virtual finish time is the source's words up to and
including it, divided by the source's target; a second pass over the source
continues from the first. All finish times together, in order, are the mix, and
the mix ends where its words reach the budget.

No source and no stretch of time is ever one task: a source's sums run over
ranges of the hash, the global ones over the partitions of a range sort by
finish time, and rows are sorted inside those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, column, is_sortable, join_frequent, marked, partitions, table, text_column

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2

#: Rows in a hash range, about.
RANGE_ROWS = 2_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: source, turn, source_size, target. ``sizes``: source, size.

    Sources by code point, null last, weigh ``weights`` in turn. Targets add up to
    ``share`` of all words; none is above ``epochs`` times its source's size, and
    what that cuts off goes to the others by weight, again and again. Targets are
    so ``min(weight * level, cap)``, and the level is the first at which the next
    source by cap / weight isn't full. A source without words has target 0.
    """
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = known.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    known = known.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("turn", F.lit(len(weights))).cast("int") + 1))
    known = known.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("cap").over(everything))
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    known = known.withColumn("level", (total - full) / open_weight)
    known = known.withColumn("reached", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    return known.select("source", "turn", "source_size", F.least(F.col("weight") * F.coalesce("reached", "level"), F.col("cap")).alias("target"))


def running_words(rows: DataFrame, mixed: DataFrame, count: int) -> DataFrame:
    """``rows`` (source, id, size, place) with turn, source_size, target and ``upto``: the source's words up to the row, in the order of ``place`` (an MD5)."""
    ranges = 1 + count // RANGE_ROWS
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = rows.withColumn("range", F.floor(share * ranges))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    sums = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range"))
    sums = sums.join(mixed, sums["source"].eqNullSafe(mixed["source"])).select(sums["source"].alias("s"), F.col("range").alias("r"), "before", "turn", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("place", "id", "size", "mark")
    rows = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["range"] == sums["r"]))
    return joined.withColumn("upto", F.col("before") + F.col("inside")).drop("s", "r", "before", "inside", "range")


def mix_end(queue: DataFrame, budget: float) -> Row | None:
    """The last (finish, turn) of ``queue`` (finish, turn, size) that the budget covers, in order of both."""
    parts = partitions(queue.sparkSession)
    # once written, partitions of the range sort are as fixed as a column
    queue = checkpoint(queue.repartitionByRange(parts, "finish", "turn").withColumn("part", F.spark_partition_id()))
    sums = queue.groupBy("part").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row per partition
    inside = Window.partitionBy("part").orderBy("finish", "turn").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("inside", F.sum("size").over(inside)).join(sums, "part")
    return queue.where(F.col("before") + F.col("inside") <= F.lit(budget)).agg(F.max(F.struct("finish", "turn"))).first()[0]


def _mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What :func:`mix` returns, and ``mark``, a digest of id, text and source."""
    rows = df.select(
        column(df, id_column).alias("id"), column(df, source).cast("string").alias("source"),
        F.regexp_count(text_column(df, text), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(column(df, id_column).cast("string"), F.lit(""))).alias("place"),
        marked(df, id_column, text, source).alias("mark"),
    )
    rows = checkpoint(rows)
    mixed = checkpoint(targets(rows, weights, share, epochs))
    placed = checkpoint(running_words(rows, mixed, rows.count()))
    finish = [F.when(F.col("size") > 0, (F.col("upto") + F.lit(e) * F.col("source_size")) / F.col("target")) for e in range(epochs)]
    queue = placed.select("turn", "size", F.explode(F.array(*finish)).alias("finish")).where("finish IS NOT NULL")
    end = mix_end(queue, (mixed.agg(F.sum("target")).first()[0] or 0.0) + 1e-6)
    times = F.lit(0)
    for f in finish:
        last = F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["turn"]).alias("turn")) if end else None
        times = times + (F.when(F.struct(f.alias("finish"), F.col("turn")) <= last, 1).otherwise(0) if end else 0)
    times = F.when(F.col("size") > 0, times).otherwise(0)
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * times).cast("long").alias("taken"), "mark")


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    ``size`` is the number of words, ``taken`` the words the mix takes of the row:
    its size for each pass in which it finishes in time, so 0, 1 or ``epochs``
    times its size. Documents are taken whole; the one that would cross the
    budget isn't taken. A null text
    has size 0; null sources are one source, the last; null ids share one place.
    Rows that repeat are rows of their own. Other columns are ignored. An empty
    table gives no rows.
    """
    return _mix(df, weights, share, epochs, id_column, text, source).drop("mark")


def mixed_documents(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df`` that the mix takes, with all columns, once for each pass that takes them.

    Rows equal in id, text and source are one document with as many copies: the one
    that sorts first by its other columns is written as often as the mix takes them
    all together. So the words that are written are those that :func:`mix` takes.
    Documents without words (null texts too) are never taken. An empty table gives
    no rows; columns of any name pass through.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    found = _mix(df, weights, share, epochs, id_column, text, source)
    times = found.where("size > 0").groupBy("mark").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("taken") / F.col("size")).cast("long").alias("times"))
    times = checkpoint(times.where("times > 0"))
    own = df.select(*[column(df, c).alias(n) for c, n in zip(df.columns, names)], marked(df, id_column, text, source).alias("mark"))
    taken = join_frequent(own, times, ["mark"], "rows")
    out = taken.where("rows = 1").select(*names, "times")
    if not times.where("rows > 1").isEmpty():
        order = F.struct(*[n for n, f in zip(names, df.schema) if is_sortable(f.dataType)])
        first = taken.where("rows > 1").groupBy("mark", "times").agg(F.min_by(F.struct(*names), order).alias("row"))
        out = out.unionByName(first.select("row.*", "times"))
    return out.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*names).toDF(*df.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2 * n AS cap FROM s
), l AS (
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, turn, n, least(weight * max(CASE WHEN level <= cap / weight THEN level END) OVER (), cap) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.turn, t.n, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT doc_id, turn, size, (upto + e.e * n) / target AS finish FROM p CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1) e WHERE size > 0
), c AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, turn ROWS UNBOUNDED PRECEDING) AS upto FROM q
), k AS (
  SELECT doc_id, sum(size) AS taken FROM c WHERE upto <= (SELECT sum(target) FROM t) + 1e-6 GROUP BY doc_id
)
SELECT p.doc_id, p.size::BIGINT AS size, p.n::BIGINT AS source_size, round(p.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (doc_id)
"""
