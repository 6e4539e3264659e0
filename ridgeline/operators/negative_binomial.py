"""Negative binomial regression of summed counts on a group, with dispersions moderated over genes.

Per gene: a dispersion by the Cox-Reid adjusted profile likelihood, a second one
with a prior around the trend over genes, coefficients by iteratively reweighted
least squares, a Wald test, and counts that stand out by Cook's distance. Genes are
rows, and their steps run on Arrow batches of them, vectorised over genes.

Per scenario and category: the trend a0 + a1 / mean by repeated gamma regressions
with an identity link, or a local regression where that fails; the width of the
prior; the least mean that lets most genes be significant. Each is a short loop on
the driver over sums that Spark takes over all genes, a row or a few bins a
scenario and category; genes themselves never leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bh_adjust, medians
from . import counts
from .shuffles import checkpoint

#: Least dispersion and mean (fixed values); genes of at least USED dispersion make the trend.
LEAST, LEAST_MEAN = 1e-8, 0.5
USED = 100 * LEAST

#: Ratios of a dispersion to the trend outside which a gene is left out of the next regression (fixed values), and regressions at most.
GOOD, REGRESSIONS, STEPS = (1e-4, 15.0), 10, 25

#: Least variance of the prior, deviations over the trend that keep a gene's own dispersion, ridge on log2 coefficients (fixed values).
PRIOR_LEAST, OWN_OVER, RIDGE = 0.25, 2.0, 1e-6

#: Bins of log mean in a local regression, and its share of genes.
LOCAL_BINS, LOCAL_SHARE = 100, 0.7

#: Quantiles of the mean that are tried as filters, and the level at which genes count as significant there.
FILTERS, ALPHA = 50, 0.1

KEYS = ("scenario", "category")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series from x + 8 on."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * np.where(x < 1e4, x + i, 1.0)
    y = np.where(x < 1e4, x + 8, x)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(shift)


def profile(log_alpha: np.ndarray, y: np.ndarray, mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted profile log-likelihood of each row's dispersion; ``x`` is 1 in the second group."""
    a = np.exp(log_alpha)[:, None]
    r = 1 / a
    fit = (log_gamma(y + r) - log_gamma(np.broadcast_to(r, y.shape)) - y * np.log(mu + r) - r * np.log1p(mu * a)).sum(1)
    w = 1 / (1 / mu + a)
    one = (w * x).sum(1)
    return fit - 0.5 * np.log(one * (w.sum(1) - one))


def maximum(f: Callable[[np.ndarray], np.ndarray], rows: int, low: float, high: float, grid: int = 48, steps: int = 44) -> np.ndarray:
    """Where ``f``, a function for each row, is greatest: the best of a grid, then golden sections around it."""
    points = np.linspace(low, high, grid)
    best, at = np.full(rows, -np.inf), np.zeros(rows)
    for p in points:
        v = f(np.full(rows, p))
        better = v > best
        best, at = np.where(better, v, best), np.where(better, p, at)
    width, golden = points[1] - points[0], (math.sqrt(5) - 1) / 2
    a, b = np.maximum(at - width, low), np.minimum(at + width, high)
    c, d = b - golden * (b - a), a + golden * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        left = fc > fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        new = np.where(left, b - golden * (b - a), a + golden * (b - a))
        c, d = np.where(left, new, d), np.where(left, c, new)
        v = f(new)
        fc, fd = np.where(left, v, fd), np.where(left, fc, v)
    return (a + b) / 2


def group_means(y: np.ndarray, sf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each row's fitted means by group, at least LEAST_MEAN."""
    q = y / sf
    m1 = (q * x).sum(1, keepdims=True) / x.sum(1, keepdims=True)
    m0 = (q * (1 - x)).sum(1, keepdims=True) / (1 - x).sum(1, keepdims=True)
    return np.maximum(sf * np.where(x > 0, m1, m0), LEAST_MEAN)


def own_dispersion(y: np.ndarray, sf: np.ndarray, x: np.ndarray) -> np.ndarray:
    mu, most = group_means(y, sf, x), max(10.0, y.shape[1])
    found = maximum(lambda t: profile(t, y, mu, x), len(y), math.log(LEAST / 10), math.log(most))
    return np.clip(np.exp(found), LEAST, most)


def shared_dispersion(y: np.ndarray, sf: np.ndarray, x: np.ndarray, own: np.ndarray, trend: np.ndarray, prior: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The dispersion with the greatest posterior; a row far over the trend keeps its own."""
    mu, most, centre = group_means(y, sf, x), max(10.0, y.shape[1]), np.log(trend)
    found = maximum(lambda t: profile(t, y, mu, x) - (t - centre) ** 2 / (2 * prior), len(y), math.log(LEAST / 10), math.log(most))
    return np.where(np.log(own) > centre + OWN_OVER * np.sqrt(spread), own, np.clip(np.exp(found), LEAST, most))


def regression(y: np.ndarray, sf: np.ndarray, x: np.ndarray, alpha: np.ndarray, steps: int = 100) -> tuple:
    """Change and its error (log2), converged, fitted means, leverages."""
    a, ridge = alpha[:, None], RIDGE / math.log(2) ** 2
    q = np.log(np.maximum(y / sf, 0.1))
    b0, b1 = (q * (1 - x)).sum(1) / (1 - x).sum(1), np.zeros(len(y))
    b1 = (q * x).sum(1) / x.sum(1) - b0
    before, done = np.full(len(y), np.inf), np.zeros(len(y), bool)

    def fitted(b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        return np.maximum(sf * np.exp(np.clip(b0[:, None] + b1[:, None] * x, -60, 60)), LEAST_MEAN)

    for _ in range(steps):
        mu = fitted(b0, b1)
        w, z = mu / (1 + a * mu), np.log(mu / sf) + (y - mu) / mu
        s, s1, t, t1 = w.sum(1) + ridge, (w * x).sum(1), (w * z).sum(1), (w * z * x).sum(1)
        det = s * (s1 + ridge) - s1 * s1
        n0, n1 = ((s1 + ridge) * t - s1 * t1) / det, (s * t1 - s1 * t) / det
        b0, b1 = np.where(done, b0, n0), np.where(done, b1, n1)
        mu, r = fitted(b0, b1), 1 / a
        deviance = -2 * (log_gamma(y + r) - log_gamma(np.broadcast_to(r, y.shape)) - y * np.log(mu + r) + y * np.log(mu) - r * np.log1p(mu * a)).sum(1)
        done |= np.abs(deviance - before) / (np.abs(deviance) + 0.1) < 1e-8
        before = deviance
        if done.all():
            break
    mu = fitted(b0, b1)
    w = mu / (1 + a * mu)
    s, s1 = w.sum(1), (w * x).sum(1)
    det = (s + ridge) * (s1 + ridge) - s1 * s1
    i00, i01, i11 = (s1 + ridge) / det, -s1 / det, (s + ridge) / det
    variance = i01 * i01 * s + 2 * i01 * i11 * s1 + i11 * i11 * s1
    leverage = w * (i00[:, None] + 2 * i01[:, None] * x + i11[:, None] * x)
    return b1 / math.log(2), np.sqrt(variance) / math.log(2), done & (np.abs(b1) < 30), mu, leverage


def trimmed(v: np.ndarray, ratio: float) -> np.ndarray:
    """Means of rows without ``ratio`` of their values on either end."""
    cut = int(ratio * v.shape[1])
    return np.sort(v, axis=1)[:, cut : v.shape[1] - cut].mean(1)


def stands_out(y: np.ndarray, sf: np.ndarray, x: np.ndarray, mu: np.ndarray, leverage: np.ndarray) -> np.ndarray:
    """Rows with a count whose Cook's distance passes the 0.99 quantile of F(2, n - 2), in a group of three or more; not where three counts are greater."""
    n, q = y.shape[1], y / sf
    groups = [g for g in (x[0] > 0, x[0] <= 0) if g.sum() >= 3]
    if n <= 2 or not groups:
        return np.zeros(len(y), bool)
    spread = []
    for g in groups:
        kind = 0 if g.sum() <= 3 else 1 if g.sum() <= 23 else 2
        ratio, scale = ((1 / 3, 2.04), (1 / 4, 1.86), (1 / 8, 1.51))[kind]  # fixed values
        spread.append(scale * trimmed((q[:, g] - trimmed(q[:, g], ratio)[:, None]) ** 2, ratio))
    mean = q.mean(1)
    alpha = np.maximum((np.max(spread, axis=0) - mean) / mean**2, 0.04)[:, None]
    cooks = (y - mu) ** 2 / (mu + alpha * mu * mu) / 2 * leverage / (1 - leverage) ** 2
    cooks[:, ~np.any(groups, axis=0)] = -np.inf
    limit = (n - 2) / 2 * (0.01 ** (-2 / (n - 2)) - 1)
    at = cooks.argmax(1)
    return (cooks.max(1) > limit) & ((y > y[np.arange(len(y)), at][:, None]).sum(1) < 3)


def gene_rows(bulk: DataFrame, groups: DataFrame, least: int, samples: int) -> DataFrame:
    """(scenario, category, gene, y, sf, x): counts, size factors and groups of each gene that passes the filter, a value a sample of its scenario.

    Filter and size factors are made for each scenario from its own samples; those of a design are few.
    """
    own = checkpoint(bulk.join(F.broadcast(groups), "sample").select("scenario", F.col("category").cast("string").alias("category"), "sample", "grp", "gene", "n"))
    kept = counts.gene_filter(own, least, samples, *KEYS)
    kept_cells = own.join(kept, [*KEYS, "gene"], "left_semi")
    many = groups.groupBy("scenario").agg(F.countDistinct("sample").alias("samples"))
    factors = counts.size_factors(kept_cells.join(F.broadcast(many), "scenario"), F.col("samples"), *KEYS)
    design = checkpoint(factors.join(groups, ["scenario", "sample"]))
    filled = kept.join(F.broadcast(design), list(KEYS)).join(own.select(*KEYS, "sample", "gene", "n"), [*KEYS, "sample", "gene"], "left")
    rows = filled.groupBy(*KEYS, "gene").agg(F.array_sort(F.collect_list(F.struct("sample", F.coalesce("n", F.lit(0)).cast("double").alias("y"), F.col("size_factor").alias("sf"), F.col("grp").cast("double").alias("x")))).alias("c"))
    return rows.select(*KEYS, "gene", *[F.col(f"c.{v}").alias(v) for v in ("y", "sf", "x")])


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places of the rows of each number of samples, and their counts, factors and groups as matrices."""
    sizes = np.array([len(v) for v in batch.column("y")])
    for m in np.unique(sizes):
        at = np.flatnonzero(sizes == m)
        yield at, [np.array([v.as_py() for v in batch.column(c).take(pa.array(at))]).reshape(len(at), m) for c in ("y", "sf", "x")]


def with_own_dispersion(rows: DataFrame) -> DataFrame:
    """``rows`` with base_mean and own (null where a scenario has one group only, or no more samples than groups)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, own = np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            for at, (y, sf, x) in _by_size(batch):
                mean[at] = (y / sf).mean(1)
                fit = (x.sum(1) > 0) & (x.sum(1) < x.shape[1]) & (x.shape[1] > 2) & (mean[at] > 0)
                if fit.any():
                    own[at[fit]] = own_dispersion(y[fit], sf[fit], x[fit])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean), pa.array(own, from_pandas=True)], names=[*batch.schema.names, "base_mean", "own"])

    gene = rows.schema["gene"].dataType.simpleString()
    return rows.mapInArrow(run, f"scenario string, category string, gene {gene}, y array<double>, sf array<double>, x array<double>, base_mean double, own double")


def trends(table: DataFrame) -> dict[tuple, dict]:
    """By (scenario, category): a0 and a1, or the points (log mean, log dispersion) of a local regression; without an entry no trend could be fitted.

    ``table``: scenario, category, base_mean, own. Every regression step is one sum over all genes.
    """
    used = checkpoint(table.where(F.col("own") > USED).select(*KEYS, (1 / F.col("base_mean")).alias("x"), F.col("own").alias("y")))
    spark = table.sparkSession
    state = {tuple(r): {"c": (0.1, 1.0), "good": (0.1, 1.0), "old": (0.1, 1.0), "step": 0, "fits": 0} for r in used.select(*KEYS).distinct().collect()}  # a row a scenario and category
    done, failed = {}, set()
    while state:
        now = spark.createDataFrame([(*k, *v["c"], *v["good"]) for k, v in state.items()], "scenario string, category string, c0 double, c1 double, g0 double, g1 double")
        ratio = F.col("y") / (F.col("g0") + F.col("g1") * F.col("x"))
        w = 1 / F.pow(F.col("c0") + F.col("c1") * F.col("x"), F.lit(2.0))
        rows = used.join(F.broadcast(now), list(KEYS)).where((ratio > GOOD[0]) & (ratio < GOOD[1])).withColumn("w", w)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate((F.col("w"), F.col("w") * F.col("x"), F.col("w") * F.col("x") * F.col("x"), F.col("w") * F.col("y"), F.col("w") * F.col("x") * F.col("y")))]).collect()
        seen = {tuple(r[c] for c in KEYS): [r[f"s{i}"] for i in range(5)] for r in sums}
        for k, v in list(state.items()):
            s, sx, sxx, sy, sxy = seen.get(k, [0.0] * 5)
            det = s * sxx - sx * sx
            c = ((sxx * sy - sx * sxy) / det, (s * sxy - sx * sy) / det) if det > 1e-12 * max(s * sxx, 1e-300) else (-1.0, -1.0)
            if min(c) <= 0:
                failed.add(k)
                del state[k]
                continue
            still = max(abs(a / b - 1) for a, b in zip(c, v["c"])) < 1e-7
            v["c"], v["step"] = c, v["step"] + 1
            if still or v["step"] >= STEPS:
                moved = sum(math.log(a / b) ** 2 for a, b in zip(c, v["old"]))
                v["old"], v["good"], v["step"], v["fits"] = c, c, 0, v["fits"] + 1
                if moved < 1e-6:
                    done[k] = {"a": c}
                    del state[k]
                elif v["fits"] > REGRESSIONS:
                    failed.add(k)
                    del state[k]
    return done | (local_trends(used, failed) if failed else {})


def local_trends(used: DataFrame, wanted: set[tuple]) -> dict[tuple, dict]:
    """Local linear regressions of log dispersion on log mean, weighted by the mean, on sums by bins of log mean."""
    spark = used.sparkSession
    named = spark.createDataFrame(sorted(wanted), "scenario string, category string")
    rows = used.join(F.broadcast(named), list(KEYS)).select(*KEYS, (-F.ln("x")).alias("u"), F.ln("y").alias("v"), (1 / F.col("x")).alias("w"))
    ends = rows.groupBy(*KEYS).agg(F.min("u").alias("low"), F.max("u").alias("high"))
    binned = rows.join(F.broadcast(ends), list(KEYS)).withColumn("bin", F.least(F.floor(F.coalesce(F.try_divide(F.col("u") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * LOCAL_BINS), F.lit(LOCAL_BINS - 1)))
    sums = binned.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(f"s{i}") for i, e in enumerate((F.col("w"), F.col("w") * F.col("u"), F.col("w") * F.col("v"), F.col("w") * F.col("u") * F.col("u"), F.col("w") * F.col("u") * F.col("v")))]).collect()
    out = {}
    for k in wanted:
        own = sorted((r for r in sums if tuple(r[c] for c in KEYS) == k), key=lambda r: r["bin"])
        if len(own) < 3:
            continue
        n, s = np.array([r["n"] for r in own], float), np.array([[r[f"s{i}"] for i in range(5)] for r in own])
        at = s[:, 1] / s[:, 0]
        points = []
        for u in at:
            order = np.argsort(np.abs(at - u))
            reach = np.abs(at - u)[order][min(len(at) - 1, int(np.searchsorted(np.cumsum(n[order]), LOCAL_SHARE * n.sum())))]
            kernel = np.clip(1 - (np.abs(at - u) / max(reach * 1.0001, 1e-9)) ** 3, 0, None) ** 3
            t, tu, tv, tuu, tuv = (kernel[:, None] * s).sum(0)
            slope = (t * tuv - tu * tv) / det if (det := t * tuu - tu * tu) > 1e-12 * t * tuu else 0.0
            points.append(tv / t + slope * (u - tu / t))
        out[k] = {"points": (at.tolist(), points)}
    return out


def prior_variance(histogram: np.ndarray, free: int, spread: float) -> float:
    """The variance of the prior on log dispersions, given how residuals (bins of half a unit from -10 on) and their robust variance spread.

    With more than three degrees of freedom the sampling variance is taken off; else the width is
    that for which the distribution of log chi-square plus a normal is closest to the residuals.
    """
    if free > 3:
        return max(spread - trigamma(free / 2), PRIOR_LEAST)
    step = 0.02
    u = np.arange(-40, 20, step)
    base = np.exp(free / 2 * (u + math.log(free)) - np.exp(np.minimum(u + math.log(free), 50)) / 2)
    base /= base.sum()
    observed, best = histogram / max(histogram.sum(), 1), (np.inf, 0.0)
    small = min(observed[observed > 0], default=1.0)
    edges = np.arange(-10, 10.25, 0.5)
    for variance in np.linspace(0, 8, 161):
        density = base
        if variance > 0:
            reach = np.arange(-5 * math.sqrt(variance), 5 * math.sqrt(variance) + step, step)
            kernel = np.exp(-(reach**2) / (2 * variance))
            density = np.convolve(base, kernel / kernel.sum(), "same")
        upto = np.concatenate([[0], np.cumsum(density)])
        expected = np.diff(np.interp(edges, np.append(u, u[-1] + step), upto))
        expected /= expected.sum()
        divergence = float((observed * (np.log(observed + small) - np.log(expected + small))).sum())
        best = min(best, (divergence, float(variance)))
    return max(best[1], PRIOR_LEAST)


def trigamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    z = 1 / (x * x)
    return out + 1 / x + z / 2 + z / x * (1 / 6 - z * (1 / 30 - z / 42))


def fit(rows: DataFrame) -> DataFrame:
    """Per gene of ``rows`` (see :func:`gene_rows`): baseMean, log2FoldChange, lfcSE, stat, pvalue (null for an outlying count), own, trend, dispersion, converged; genes of a scenario and category without a trend are left out."""
    spark = rows.sparkSession
    table = checkpoint(with_own_dispersion(rows))
    found = trends(table.where("own IS NOT NULL"))
    gene = table.schema["gene"].dataType.simpleString()
    schema = f"scenario string, category string, gene {gene}, baseMean double, log2FoldChange double, lfcSE double, stat double, pvalue double, own double, trend double, dispersion double, converged boolean"
    if not found:
        return spark.createDataFrame([], schema)

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            mean = batch.column("base_mean").to_numpy()
            keys = list(zip(batch.column("scenario").to_pylist(), batch.column("category").to_pylist()))
            for k in set(keys) & set(found):
                at = np.array([x == k for x in keys])
                own = found[k]
                out[at] = own["a"][0] + own["a"][1] / mean[at] if "a" in own else np.exp(np.interp(np.log(mean[at]), *own["points"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(out, LEAST), from_pandas=True)], names=[*batch.schema.names, "trend"])

    with_trend = table.where("own IS NOT NULL").mapInArrow(curve, f"scenario string, category string, gene {gene}, y array<double>, sf array<double>, x array<double>, base_mean double, own double, trend double").where("trend IS NOT NULL AND NOT isnan(trend)")
    with_trend = checkpoint(with_trend)
    residuals = with_trend.where(F.col("own") >= USED).select(*KEYS, (F.ln("own") - F.ln("trend")).alias("r"), (F.size("y") - 2).alias("free"))
    middle = medians(residuals, ["r"], *KEYS)
    away = residuals.join(F.broadcast(middle.select(*KEYS, "median_r")), list(KEYS)).withColumn("away", F.abs(F.col("r") - F.col("median_r")))
    spreads = {tuple(r[c] for c in KEYS): (1.4826 * r["median_away"]) ** 2 for r in medians(away, ["away"], *KEYS).collect()}
    free, histograms = {}, {}
    for r in residuals.where(F.abs("r") < 10).groupBy(*KEYS, F.floor((F.col("r") + 10) * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("free").alias("free")).collect():  # forty bins a scenario and category
        k = tuple(r[c] for c in KEYS)
        free[k] = r["free"]
        histograms.setdefault(k, np.zeros(40))[int(r["bin"])] += r["n"]
    priors = {k: (prior_variance(histograms.get(k, np.zeros(40)), free.get(k, 4), s), s) for k, s in spreads.items()}

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = {c: np.full(n, np.nan) for c in ("lfc", "se", "stat", "p", "alpha")}
            converged = np.zeros(n, bool)
            widths = np.array([priors.get(k, (PRIOR_LEAST, 0.0)) for k in zip(batch.column("scenario").to_pylist(), batch.column("category").to_pylist())]).reshape(n, 2)
            own, trend = batch.column("own").to_numpy(), batch.column("trend").to_numpy()
            for at, (y, sf, x) in _by_size(batch):
                alpha = shared_dispersion(y, sf, x, own[at], trend[at], widths[at, 0], widths[at, 1])
                lfc, se, ok, mu, leverage = regression(y, sf, x, alpha)
                stat = lfc / se
                p = np.array([math.erfc(abs(s) / math.sqrt(2)) for s in stat])
                p[stands_out(y, sf, x, mu, leverage)] = np.nan
                for c, v in zip(out, (lfc, se, stat, p, alpha)):
                    out[c][at] = v
                converged[at] = ok
            arrays = [*[batch.column(c) for c in (*KEYS, "gene", "base_mean")], *[pa.array(out[c], from_pandas=True) for c in ("lfc", "se", "stat", "p")], batch.column("own"), batch.column("trend"), pa.array(out["alpha"]), pa.array(converged)]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return checkpoint(with_trend.mapInArrow(test, schema))


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.2, rounds: int = 3) -> np.ndarray:
    """Robust local linear regression of a few points."""
    n, reach = len(x), max(2, int(share * len(x) + 1e-9))
    robust, out = np.ones(n), np.zeros(n)
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[reach - 1]
            w = robust * np.clip(1 - (d / max(h, 1e-12)) ** 3, 0, None) ** 3
            if w.sum() <= 0:
                out[i] = y[i]
                continue
            centre = (w * x).sum() / w.sum()
            width = (w * (x - centre) ** 2).sum()
            out[i] = (w * y).sum() / w.sum() + ((w * (x - centre) * y).sum() / width * (x[i] - centre) if width > 1e-18 else 0)
        left = np.abs(y - out)
        scale = 6 * np.median(left)
        if scale < 1e-12:
            break
        robust = np.clip(1 - (left / scale) ** 2, 0, None) ** 2
    return out


def chosen_filter(shares: np.ndarray, rejected: np.ndarray) -> int:
    """The first filter with close to as many significant genes as the best one; the first of all where none has over ten."""
    if rejected.max(initial=0) <= 10:
        return 0
    smooth = lowess(shares, rejected.astype(float))
    left = (rejected - smooth)[rejected > 0]
    enough = np.flatnonzero(rejected > smooth.max() - math.sqrt((left**2).mean()))
    return int(enough[0]) if len(enough) else 0


def filtered_padj(table: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``table`` with padj by false discovery rate in each scenario and category, null under the mean that filters best and where p is.

    Filters are quantiles of the mean. How many genes each would leave significant is
    the fixed point of counting p values under alpha times that number over the genes tested,
    from all of them down: one count over all genes a round, for all filters of all groups.
    """
    spark = table.sparkSession
    shares = np.linspace(0, 0.95, FILTERS)
    quantiles = table.groupBy(*KEYS).agg(F.percentile_approx("baseMean", shares.tolist(), 100_000).alias("cuts"))
    groups = {tuple(r[c] for c in KEYS): r for r in quantiles.collect()}  # fifty numbers a scenario and category
    if not groups:
        return table.withColumn("padj", F.col("pvalue"))
    tested = checkpoint(table.where("pvalue IS NOT NULL").select(*KEYS, "baseMean", "pvalue"))
    limits = {k: [alpha] * FILTERS for k in groups}
    counts_, total = {}, None
    while True:
        now = spark.createDataFrame([(*k, list(map(float, groups[k]["cuts"])), list(map(float, v))) for k, v in limits.items()], "scenario string, category string, cuts array<double>, limits array<double>")
        joined = tested.join(F.broadcast(now), list(KEYS))
        passes = [F.col("baseMean") >= F.col("cuts")[i] for i in range(FILTERS)]
        aggregates = [F.count_if(p & (F.col("pvalue") <= F.col("limits")[i])).alias(f"k{i}") for i, p in enumerate(passes)]
        rows = joined.groupBy(*KEYS).agg(*aggregates, *([F.count_if(p).alias(f"m{i}") for i, p in enumerate(passes)] if total is None else [])).collect()
        if total is None:
            total = {tuple(r[c] for c in KEYS): np.array([r[f"m{i}"] for i in range(FILTERS)]) for r in rows}
        new = {tuple(r[c] for c in KEYS): np.array([r[f"k{i}"] for i in range(FILTERS)]) for r in rows}
        if all((counts_.get(k, np.full(FILTERS, -1)) == v).all() for k, v in new.items()):
            break
        counts_ = new
        limits = {k: (alpha * v / np.maximum(total[k], 1)).tolist() for k, v in new.items()}
    cut = [(*k, float(r["cuts"][chosen_filter(shares, counts_[k])]) if k in counts_ else 0.0) for k, r in groups.items()]
    kept = table.join(F.broadcast(spark.createDataFrame(cut, "scenario string, category string, cut double")), list(KEYS))
    return bh_adjust(kept.withColumn("tested", F.when(F.col("baseMean") >= F.col("cut"), F.col("pvalue"))), "tested", "padj", *KEYS).drop("tested", "cut")


def wald(bulk: DataFrame, groups: DataFrame, least: int, samples: int) -> DataFrame:
    """(scenario, category, gene, baseMean, log2FoldChange, lfcSE, stat, pvalue, padj, dispersion, converged).

    ``bulk``: category, sample, gene, n; ``groups`` (scenario, sample, grp) says which
    samples each scenario compares, group 1 against 0. Genes need ``least`` counts in ``samples`` samples of
    the scenario. A scenario with a single group, no replicates or no trend has no rows.
    """
    table = fit(gene_rows(bulk, groups, least, samples))
    return filtered_padj(table).select("scenario", "category", "gene", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj", "dispersion", "converged")


def status_table(table: DataFrame, bulk: DataFrame, groups: DataFrame, least: int, samples: int, depth: int) -> DataFrame:
    """Per scenario and category: status (analysed, skipped_low_depth under ``depth`` counts in a sample, skipped_fit_failed), min_depth, genes that pass the filter and what :func:`expression.summary` counts of those analysed."""
    from .expression import summary

    own = bulk.join(F.broadcast(groups), "sample").withColumn("category", F.col("category").cast("string"))
    many = groups.groupBy("scenario").agg(F.countDistinct("sample").alias("samples"))
    totals = own.groupBy(*KEYS, "sample").agg(F.sum("n").alias("total")).groupBy(*KEYS).agg(F.min("total").alias("least"), F.count(F.lit(1)).alias("have"))
    lowest = totals.join(F.broadcast(many), "scenario").select(*KEYS, F.when(F.col("have") < F.col("samples"), F.lit(0)).otherwise(F.col("least")).alias("min_depth"))
    passing = counts.gene_filter(own, least, samples, *KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("genes_tested"))
    found = summary(table, *KEYS).drop("genes_tested")
    joined = lowest.join(passing, list(KEYS), "left").join(found.withColumn("fitted", F.lit(True)), list(KEYS), "left")
    low = F.col("min_depth") < depth
    status = F.when(low, "skipped_low_depth").when(F.col("fitted").isNull(), "skipped_fit_failed").otherwise("analysed")
    return joined.select(*KEYS, status.alias("status"), "min_depth", F.when(~low, F.coalesce("genes_tested", F.lit(0))).alias("genes_tested"), *[F.when(status == "analysed", F.col(c)).alias(c) for c in ("n_padj_005", "min_padj", "n_lfc_gt1")])
