"""Ranks, tests, corrections, effect sizes and intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shuffles import checkpoint, join_frequent
from .ordered import in_ranges, joined, running, totals

#: The 0.975 quantile of the normal distribution (a fixed value).
Z_975 = 1.959963984540054

#: Where the share of true nulls is estimated (fixed values).
GRID = tuple(i / 20 for i in range(1, 20))


def below(counted: DataFrame, value: str, count: str, *by: str) -> DataFrame:
    """``counted`` (a row a distinct ``value`` of ``by``) with ``_below``: how many rows have a smaller one."""
    return running(in_ranges(counted, by, [value]), by, [value], {"_below": F.col(count)}).drop("_range")


def mid_ranks(df: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """``df`` with ``out``: the rank within ``by``, ties at the mean of their ranks; rows without a value have none."""
    counted = below(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), value, "_c", *by)
    ranks = checkpoint(counted.select(*by, value, "_c", (F.col("_below") + (F.col("_c") + 1) / F.lit(2.0)).alias(out)))
    return join_frequent(df, ranks, [*by, value], "_c", how="left").drop("_c")


#: Share of ranks on each side of the middle that a sketch leaves for exact counting, and the sketch's accuracy (error 1 / accuracy).
MIDDLE, ACCURACY = 0.001, 10_000


def medians(df: DataFrame, values: Sequence[str], *by: str) -> DataFrame:
    """(by, n, and the exact median of each of ``values``), without holding or sorting a group: nulls don't count.

    A mergeable sketch brackets the middle of each group; values are then counted, all below the bracket together
    and one by one inside, which is some thousandth of a group. ``by`` names at least one column without nulls.
    """
    stacked = df.select(*by, F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_which", "_v")).where("_v IS NOT NULL")
    keys = [*by, "_which"]
    marks = stacked.groupBy(*keys).agg(F.percentile_approx("_v", [0.5 - MIDDLE, 0.5 + MIDDLE], ACCURACY).alias("_b"), F.count(F.lit(1)).alias("_n"))
    marks = checkpoint(marks.select(*keys, F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"), "_n"))
    near = join_frequent(stacked, marks, keys, "_n").where(F.col("_v") <= F.col("_high")).withColumn("_v", F.when(F.col("_v") >= F.col("_low"), F.col("_v")))
    counted = near.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_c").over(order)).where("_v IS NOT NULL")
    first, second = (F.min(F.when(F.col("_upto") >= F.floor((F.col("_n") + d) / F.lit(2)), F.col("_v"))) for d in (1, 2))
    found = upto.groupBy(*keys).agg(((first + second) / 2).alias("_m"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_which") == i, F.col("_m"))).alias(f"median_{v}") for i, v in enumerate(values)])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(wide, list(by), "left")


def signif(x: Column, digits: int = 3) -> Column:
    """``x`` rounded to significant digits, half to even; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def group_summary(long: DataFrame) -> DataFrame:
    """Per feature of (animal, label, feature, value): means and sample deviations of both groups and Cohen's d (null if the pooled deviation is 0)."""
    one, zero = F.when(F.col("label") == 1, F.col("value")), F.when(F.col("label") == 0, F.col("value"))
    table = long.groupBy("feature").agg(
        F.avg(zero).alias("control_mean"), F.stddev_samp(zero).alias("control_sd"), F.avg(one).alias("exercised_mean"), F.stddev_samp(one).alias("exercised_sd"),
        F.count(zero).alias("n0"), F.count(one).alias("n1"), F.var_samp(zero).alias("var0"), F.var_samp(one).alias("var1"),
    )
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0"), (F.col("n0") + F.col("n1") - 2).cast("double")))
    d = F.when(pooled > 0, (F.col("exercised_mean") - F.col("control_mean")) / pooled)
    return table.withColumn("cohens_d", d).drop("n0", "n1", "var0", "var1")


def mann_whitney(long: DataFrame, *by: str) -> DataFrame:
    """Per ``by``: U of label 1, group sizes, whether there are ties, and the tie term of the variance; values are counted before they are ranked."""
    is_ = lambda k: F.count_if(F.col("label") == k)
    counted = long.where("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c"), is_(1).alias("_c1"), is_(0).alias("_c0"))
    ranked = below(counted, "value", "_c", *by)
    rank, cube = F.col("_below") + (F.col("_c") + 1) / F.lit(2.0), F.col("_c") * (F.col("_c") * F.col("_c") - 1)
    table = ranked.groupBy(*by).agg(F.sum("_c1").alias("n1"), F.sum("_c0").alias("n0"), F.sum(F.when(F.col("_c1") > 0, F.col("_c1") * rank)).alias("r1"), F.sum(cube).alias("tie_term"))
    return table.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).drop("r1")


def exact_u_probability(u: float, n1: int, n0: int) -> float:
    """Two-sided exact p of U without ties, by counting arrangements."""
    ways = {0: 1}
    counts = [[None] * (n0 + 1) for _ in range(n1 + 1)]
    for i in range(n1 + 1):
        for j in range(n0 + 1):
            if i == 0 or j == 0:
                counts[i][j] = {0: 1}
                continue
            ways = dict(counts[i][j - 1])
            for k, v in counts[i - 1][j].items():
                ways[k + j] = ways.get(k + j, 0) + v
            counts[i][j] = ways
    ways = counts[n1][n0]
    tail = max(u, n1 * n0 - u)
    return min(1.0, 2 * sum(v for k, v in ways.items() if k >= tail) / math.comb(n1 + n0, n1))


def u_normal_p(table: DataFrame) -> Column:
    """Two-sided p of U by the normal approximation with ties and continuity corrected."""
    n = F.col("n1") + F.col("n0")
    mean = F.col("n1") * F.col("n0") / F.lit(2.0)
    sd = F.sqrt(F.col("n1") * F.col("n0") / F.lit(12.0) * (n + 1 - F.try_divide(F.col("tie_term").cast("double"), (n * (n - 1)).cast("double"))))
    z = F.try_divide(F.abs(F.col("u") - mean) - F.lit(0.5), sd)
    return F.least(F.lit(1.0), 2 * normal_tail(F.greatest(z, F.lit(0.0))))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by the rational approximation of Abramowitz and Stegun 26.2.17 (absolute error below 7.5e-8)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def mann_whitney_p(table: DataFrame) -> DataFrame:
    """``table`` of :func:`mann_whitney` with ``p``: exact where the smaller group has 8 or fewer, the larger 200 or fewer, and nothing ties; else normal."""
    # a row per feature; the function is called for all rows, whatever the condition around it, so others pass it a null
    exact = F.udf(lambda u, a, b: exact_u_probability(u, a, b) if u is not None and a and b else None, "double")
    small = (F.least("n1", "n0") <= 8) & (F.col("tie_term") == 0) & (F.greatest("n1", "n0") <= 200)
    return table.withColumn("p", F.when(small, exact(F.when(small, F.col("u")), "n1", "n0")).otherwise(u_normal_p(table)))


def bh_adjust(df: DataFrame, p: str, out: str, *by: str, least: bool = True, written: bool = False) -> DataFrame:
    """Benjamini-Hochberg within ``by``: the running minimum of p m / rank from the largest p, at most 1 (unless ``least`` is false); nulls stay null and don't count.

    Equal p are counted before they are ranked and share their last rank. ``df`` is read twice, so it is written first,
    unless it is ``written`` or quickly made again.
    """
    df = df if written else checkpoint(df)
    ranges = in_ranges(df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")), by, ["_p"])
    ranks = joined(running(ranges, by, ["_p"], {"_before": F.col("_c")}), checkpoint(ranges.groupBy(*by).agg(F.sum("_c").alias("_m"))), by)
    scaled = F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_c"))
    table = checkpoint(running(ranks, by, ["_p"], least_from_here={"_least": scaled}).select(*by, "_p", F.least("_least", F.lit(1.0)).alias("_least") if least else "_least"))
    # rows without a p match nothing, and are dealt out
    key = F.coalesce(p, -1.0 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    return joined(df.withColumn("_p", key), table, [*by, "_p"]).withColumn(out, F.when(F.col(p).isNotNull(), F.col("_least"))).drop("_p", "_least")


def null_share(tested: float, reach: Sequence[float], grid: Sequence[float], smooth: bool = True) -> float:
    """The share of true nulls among ``tested`` p values, of which ``reach`` are at each value of ``grid`` or over.

    Smoothed over the grid by a natural cubic spline of three degrees of freedom and read at its end, or
    (``smooth`` false) the value with the least estimated mean squared error.
    """
    x, w = np.array(grid, float), np.array(reach, float)
    share = w / tested / (1 - x)
    if len(x) < 4:
        return float(min(share[-1], 1.0))
    if smooth:
        knots = np.quantile(x, [0, 1 / 3, 2 / 3, 1])
        bend = lambda k: (np.clip(x - knots[k], 0, None) ** 3 - np.clip(x - knots[3], 0, None) ** 3) / (knots[3] - knots[k])
        basis = np.column_stack([np.ones(len(x)), x, bend(0) - bend(2), bend(1) - bend(2)])
        fitted = basis @ np.linalg.lstsq(basis, share, rcond=None)[0]
        return float(min(max(fitted[-1], 1e-12), 1.0))
    error = w / (tested**2 * (1 - x) ** 2) * (1 - w / tested) + (share - np.quantile(share, 0.1)) ** 2
    return float(min(share[int(np.argmin(error))], 1.0))


def q_values(df: DataFrame, p: str, out: str, *by: str, grid: Sequence[float] = GRID, smooth: bool = True) -> DataFrame:
    """q values within ``by``: the running minimum of p m pi0 / rank, where pi0 is :func:`null_share` of the group's p values; nulls stay null."""
    reach = [F.count_if(F.col(p) >= t).alias(f"_r{i}") for i, t in enumerate(grid)]
    counted = df.groupBy(*by).agg(F.count(p).alias("_m"), *reach)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b[["_m", *[f"_r{i}" for i in range(len(grid))]]].to_numpy(float)
            yield b[list(by)].assign(_share=[null_share(r[0], r[1:], grid, smooth) if r[0] else None for r in rows])

    kinds = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    share = checkpoint(counted.mapInPandas(shares, f"{kinds}_share double"))
    return joined(bh_adjust(df, p, "_q", *by, least=False), share, by).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.col("_q") * F.col("_share"), F.lit(1.0)))).drop("_q", "_share")


def bonferroni(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    return totals(df, by, _m=F.count(p)).withColumn(out, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def wilson(k: Column, n: Column, z: float = Z_975) -> tuple[Column, Column]:
    """Wilson interval of k of n."""
    p = k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def auc(df: DataFrame, label: str, score: str, *by: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks of distinct scores; null if a class is missing. Rows without a score don't count."""
    # equal scores first, so ranks run over distinct scores
    counted = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_score")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col(label) == 1).alias("_c1"), F.count_if(F.col(label) == 0).alias("_c0"))
    ranked = below(counted, "_score", "_c", *by).withColumn("_rank", F.col("_below") + (F.col("_c") + 1) / F.lit(2.0))
    table = ranked.groupBy(*by).agg(F.sum("_c1").alias("n1"), F.sum("_c0").alias("n0"), F.sum(F.col("_c1") * F.col("_rank")).alias("r1"))
    return table.withColumn("auc", F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0), (F.col("n1") * F.col("n0")).cast("double"))).drop("r1")


def permutation_p(null: Column, observed: Column, mode: str) -> Column:
    """``plus_one``: (#null >= observed + 1) / (n + 1); ``with_observed`` and ``plain``: the share of values >= observed; ``lower``: of values <= observed."""
    above = F.count_if(null >= observed)
    if mode == "plus_one":
        return (above + 1) / (F.count(null) + 1)
    return F.try_divide((F.count_if(null <= observed) if mode == "lower" else above).cast("double"), F.count(null).cast("double"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection."""
    low, high = 0.0, 1e6
    target = 2 * (1 - max(p, 1 - p))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(df / 2, 0.5, df / (df + mid * mid)) > target else (low, mid)
    return (low + high) / 2 * (1 if p >= 0.5 else -1)


def t_interval(df: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """One row (mean, low, high): mean and t interval; a single value is its own interval."""
    row = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    n = row.first()["n"]
    half = F.lit(0.0) if n < 2 else F.col("sd") / math.sqrt(n) * t_quantile((1 + confidence) / 2, n - 1)
    return row.select("mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def feature_table(long: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per feature: group means, deviations, Cohen's d, U, p and its BH correction, by falling |d|."""
    tests = mann_whitney_p(mann_whitney(long, "feature")).select("feature", F.col("u").alias("mannwhitney_U"), F.col("p").alias("p_raw"))
    table = bh_adjust(group_summary(long).join(tests, "feature", "left"), "p_raw", "p_bh_corrected")
    return table.orderBy(F.abs("cohens_d").desc_nulls_last(), "feature")
