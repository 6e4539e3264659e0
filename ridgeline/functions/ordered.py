"""Running sums and ranks over lists that no task has to hold: a prefix sum in two levels.

Rows are dealt by ranges of their order and written once. Each range adds up its own rows, the sums of the ranges, a
row a range and group, give every range what comes before it, and the two are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shuffles import checkpoint

#: A list of at most so many rows is one range.
SMALL = 50_000

#: So many sums of ranges, or fewer, are broadcast.
BROADCAST_ROWS = 100_000


def _name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` written, with ``_range``: the number of the range of (``by``, ``order``) that a row is in."""
    written = checkpoint(df)
    if written.count() <= SMALL:
        return written.withColumn("_range", F.lit(0))
    return checkpoint(written.repartitionByRange(*[F.col(b) for b in by], *map(_name, order)).withColumn("_range", F.spark_partition_id()))


def joined(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys``, nulls being equal; ``table`` is broadcast if it is small."""
    right = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    right = F.broadcast(right) if table.count() <= BROADCAST_ROWS else right
    if not keys:
        return df.crossJoin(right)  # one row
    on = None
    for i, k in enumerate(keys):
        same = df[k].eqNullSafe(right[f"_k{i}"])
        on = same if on is None else on & same
    return df.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def running(ranges: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column] | None = None, least_from_here: dict[str, Column] | None = None) -> DataFrame:
    """``ranges`` (see :func:`in_ranges`, with the same ``by`` and ``order``) with more columns.

    ``sums``: the sum of an expression over all rows of the group that come before. ``least_from_here``: the
    least value of one from this row to the last of the group.
    """
    sums, least = sums or {}, least_from_here or {}
    inputs = {f"_in{i}": e for i, e in enumerate([*sums.values(), *least.values()])}
    table = ranges.withColumns(inputs)
    own = Window.partitionBy(*by, "_range").orderBy(*map(_name, order))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    if least:
        # a frame that ends with the last row is added up anew for each row, so it is walked from the last row on
        table = table.withColumn("_place", F.row_number().over(own))
    after = Window.partitionBy(*by, "_range").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    names = [*sums, *least]
    local = [F.coalesce(F.sum(f"_in{i}").over(before), F.lit(0)) if n in sums else F.min(f"_in{i}").over(after) for i, n in enumerate(names)]
    out = table.withColumns({f"_own{i}": e for i, e in enumerate(local)})
    # a row a range and group
    each = table.groupBy(*by, "_range").agg(*[(F.sum if n in sums else F.min)(f"_in{i}").alias(f"_of{i}") for i, n in enumerate(names)])
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")
    outer = [(F.sum if n in sums else F.min)(f"_of{i}").over(group.rowsBetween(Window.unboundedPreceding, -1) if n in sums else group.rowsBetween(1, Window.unboundedFollowing)).alias(f"_off{i}") for i, n in enumerate(names)]
    offsets = checkpoint(each.select(*by, "_range", *outer))
    found = joined(out, offsets, [*by, "_range"])
    final = {n: F.col(f"_own{i}") + F.coalesce(f"_off{i}", F.lit(0)) if n in sums else F.least(f"_own{i}", f"_off{i}") for i, n in enumerate(names)}
    return found.withColumns(final).drop("_place", *[f"_{kind}{i}" for kind in ("in", "own", "off") for i in range(len(names))])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 within ``by``, in an order without ties."""
    return running(in_ranges(df, by, order), by, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("int")).drop("_range")


def totals(df: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """``df`` with sums over the groups ``by``, which are added up before they are joined."""
    return joined(df, checkpoint(df.groupBy(*by).agg(*[e.alias(n) for n, e in sums.items()])), by)
