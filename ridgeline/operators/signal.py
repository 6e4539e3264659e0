"""Long ordered series: cropping, scaling, count-based windows and their features.

A series is (animal, label, pos, v) with positions from 0 without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shuffles import checkpoint, join_frequent

#: Samples of one series in a range that one task puts in order.
RANGE = 100_000


def _with_totals(series: DataFrame, *totals: Column) -> DataFrame:
    """``series`` with ``totals`` of each series, and ``n``, its length; a long one is dealt over several tasks."""
    sums = checkpoint(series.groupBy("animal").agg(F.count(F.lit(1)).alias("n"), *totals))
    return join_frequent(series, sums, ["animal"], "n")


def with_previous(series: DataFrame, name: str = "before") -> DataFrame:
    """``series`` with the value of the sample before, in ranges of positions that also hold the last one of the range before."""
    own = F.floor(F.col("pos") / F.lit(RANGE))
    ranges = F.when(F.col("pos") % RANGE == RANGE - 1, F.array(own, own + 1)).otherwise(F.array(own))
    spread = series.withColumn("_range", F.explode(ranges))
    found = spread.withColumn(name, F.lag("v").over(Window.partitionBy("animal", "_range").orderBy("pos")))
    return found.where(F.col("_range") == own).drop("_range")


#: Frequency bands in Hz, both edges included (fixed values).
BANDS = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "slow_gamma": (30, 60), "fast_gamma": (60, 100), "high_freq": (100, 300)}
TIME_FEATURES = ("min", "max", "zero_crossings", "energy", "rms", "signal_variability", "diff_variance", "num_peaks", "peak_valley_ratio", "std_peak_height")
CONTRASTS = ("fast_slow_gamma_ratio", "gamma_beta_ratio")
SPECTRAL_FEATURES = (*[f"{b}_power" for b in BANDS], *[f"{b}_rel" for b in BANDS], *CONTRASTS)
FEATURES = (*TIME_FEATURES, *SPECTRAL_FEATURES)


def finite(df: DataFrame, value: str = "v") -> DataFrame:
    """Rows whose value is a finite number."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def centre_crop(series: DataFrame, keep: int) -> DataFrame:
    """The middle ``keep`` samples of each series, renumbered; a shorter one stays whole."""
    start = F.greatest(F.floor((F.col("n") - keep) / F.lit(2)), F.lit(0))
    return _with_totals(series).withColumn("start", start).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + keep)).withColumn("pos", (F.col("pos") - F.col("start")).cast("long")).select(series.columns)


def zscore(series: DataFrame) -> DataFrame:
    """``v`` less its mean over the series, by the population standard deviation; null where that is 0."""
    whole = _with_totals(series, F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return whole.withColumn("v", F.try_divide(F.col("v") - F.col("mean"), F.col("sd"))).select(series.columns)


def negative(v: Column) -> Column:
    """The sign bit, which -0.0 has too."""
    return v.cast("string").startswith("-")


def window_counts(series: DataFrame, size: int, step: int) -> DataFrame:
    """(animal, label, n, windows): how many full windows each series has."""
    n = F.count(F.lit(1))
    return series.groupBy("animal", "label").agg(n.alias("n"), F.greatest(F.floor((n - size) / F.lit(step)) + 1, F.lit(0)).cast("long").alias("windows"))


def sliding_windows(series: DataFrame, size: int, step: int) -> DataFrame:
    """Each sample once for every full window it is in, with ``win`` and ``k``, its place there.

    A sample at ``pos`` is in windows floor(pos / step) and the few before; no array of a whole series is made.
    """
    last = F.least(F.floor(F.col("pos") / F.lit(step)), F.floor((F.col("n") - size) / F.lit(step)))
    first = F.greatest(F.ceil((F.col("pos") - (size - 1)) / F.lit(step)), F.lit(0))
    spread = _with_totals(series).withColumn("first", first).withColumn("last", last).where("first <= last")
    return spread.withColumn("win", F.explode(F.sequence("first", "last"))).withColumn("k", (F.col("pos") - F.col("win") * step).cast("long")).select(*series.columns, "win", "k")


def min_windows(windows: DataFrame, least: int) -> DataFrame:
    """(animal, label, windows, n, included): the report of series with enough windows."""
    return windows.withColumn("included", F.col("windows") >= least)


def time_features(series: DataFrame, size: int, step: int) -> DataFrame:
    """Per window: min, max, zero_crossings, energy, rms, signal_variability, diff_variance.

    Differences are taken once over the series; a window leaves out that of its first sample.
    """
    before = F.col("before")
    with_steps = with_previous(series).withColumn("d", F.col("v") - before).withColumn("cross", (negative(F.col("v")) != negative(before)).cast("long"))
    inside = F.col("k") > 0
    windows = sliding_windows(with_steps, size, step)
    return windows.groupBy("animal", "label", "win").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.when(inside, F.col("cross")).otherwise(0)).alias("zero_crossings"),
        F.sum(F.col("v") * F.col("v")).alias("energy"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.stddev_pop(F.when(inside, F.col("d"))).alias("signal_variability"), F.var_pop(F.when(inside, F.col("d"))).alias("diff_variance"),
    )


def _with_next(points: DataFrame, name: str) -> DataFrame:
    """``points`` (animal, pos, v) with ``name``, the struct (pos, v) of the next point of the series.

    Ranges of positions are put in order each by itself; the first point of each range is then carried, over a table
    of one row a range, to the range before that has any.
    """
    marked = points.withColumn("_range", F.floor(F.col("pos") / F.lit(RANGE)))
    firsts = marked.groupBy("animal", "_range").agg(F.min_by(F.struct("pos", "v"), "pos").alias("_first"))
    firsts = firsts.withColumn("_beyond", F.lead("_first").over(Window.partitionBy("animal").orderBy("_range"))).drop("_first")
    found = marked.withColumn("_near", F.lead(F.struct("pos", "v")).over(Window.partitionBy("animal", "_range").orderBy("pos")))
    joined = found.join(firsts, ["animal", "_range"])
    return joined.withColumn(name, F.coalesce("_near", "_beyond")).drop("_near", "_beyond", "_range")


def extrema(series: DataFrame) -> DataFrame:
    """(animal, a, b, at, height, kind): peaks and valleys as runs a..b of equal values between lower (higher) neighbours, at their middle.

    A run starts where a value differs from the one before; its end and its neighbours' heights are those of the starts
    around it, found in ranges of positions. The last run of a series has nothing after it and is no peak.
    """
    starts = with_previous(series.select("animal", "pos", "v")).where("before IS NULL OR v <> before").select("animal", "pos", "v", "before")
    runs = _with_next(starts, "after").where("before IS NOT NULL AND after IS NOT NULL")
    height, left, right = F.col("v"), F.col("before"), F.col("after.v")
    kind = F.when((left < height) & (right < height), "peak").when((left > height) & (right > height), "valley")
    b = F.col("after.pos") - 1
    return runs.withColumn("kind", kind).where("kind IS NOT NULL").select("animal", F.col("pos").alias("a"), b.alias("b"), F.floor((F.col("pos") + b) / F.lit(2)).alias("at"), F.col("v").alias("height"), "kind")


def peak_features(series: DataFrame, size: int, step: int) -> DataFrame:
    """Per window: num_peaks, peak_valley_ratio, std_peak_height.

    A run is inside a window if both its neighbours are. Peaks reach mean + sd / 2 of the window, valleys its mean.
    """
    stats = sliding_windows(series, size, step).groupBy("animal", "label", "win").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    runs = extrema(series)
    first = F.greatest(F.ceil((F.col("b") + 2 - size) / F.lit(step)), F.lit(0))
    last = F.floor((F.col("a") - 1) / F.lit(step))
    runs = runs.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("win", F.explode(F.sequence("first", "last"))).drop("first", "last")
    joined = stats.join(runs, ["animal", "win"], "left")
    peak = (F.col("kind") == "peak") & (F.col("height") >= F.col("mean") + F.lit(0.5) * F.col("sd"))
    valley = (F.col("kind") == "valley") & (F.col("height") <= F.col("mean"))
    peaks, valleys = F.count_if(peak), F.count_if(valley)
    return joined.groupBy("animal", "label", "win").agg(
        peaks.alias("num_peaks"), (peaks / (valleys + 1)).alias("peak_valley_ratio"), F.coalesce(F.stddev_pop(F.when(peak, F.col("height"))), F.lit(0.0)).alias("std_peak_height")
    )


def _trapezoid(y: np.ndarray, dx: float) -> np.ndarray:
    return (y[:, 1:] + y[:, :-1]).sum(axis=1) * dx / 2


def welch(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean periodogram of each row of ``x``: half-overlapping Hann segments less their mean, one-sided density."""
    n = np.arange(segment)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * n / segment)
    starts = range(0, x.shape[1] - segment + 1, segment - segment // 2)
    total = 0
    for s in starts:
        part = x[:, s : s + segment]
        total = total + np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
    psd = total / len(starts) / (fs * (taper**2).sum())
    psd[:, 1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), psd


def band_powers(x: np.ndarray, fs: float) -> np.ndarray:
    """Absolute and relative band powers and their contrasts, a row per window."""
    freqs, psd = welch(x, fs, int(min(x.shape[1], fs)))
    step, nyquist = freqs[1] - freqs[0], fs / 2
    power = []
    for name, (low, high) in BANDS.items():
        inside = (freqs >= low) & (freqs <= (min(high, nyquist - 1) if name == "high_freq" else high)) & (low < nyquist)
        some = psd[:, inside]
        power.append(np.zeros(len(x)) if not inside.any() else some[:, 0] * step if inside.sum() == 1 else _trapezoid(some, step))
    total = _trapezoid(psd, step)
    share = [np.divide(p, total, out=np.zeros(len(x)), where=total > 0) for p in power]
    at = {name: i for i, name in enumerate(BANDS)}
    slow, fast, beta = power[at["slow_gamma"]], power[at["fast_gamma"]], power[at["beta"]]
    out = np.stack([*power, *share, fast / (slow + 1e-12), (slow + fast) / (beta + 1e-12)], axis=1)
    return np.where(np.isfinite(out), out, 0.0)


def spectral_features(series: DataFrame, size: int, step: int, fs: float) -> DataFrame:
    """Band powers of each window by Welch's method, in Arrow batches of windows."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"])
    windows = sliding_windows(series, size, step).groupBy("animal", "label", "win").agg(samples.alias("samples"))
    keys = windows.drop("samples").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, size))
            made = band_powers(x, fs) if len(x) else np.zeros((0, len(SPECTRAL_FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c) for c in made.T]], names=["animal", "label", "win", *SPECTRAL_FEATURES])

    for name in SPECTRAL_FEATURES:
        keys = keys.add(name, "double")
    return windows.mapInArrow(run, keys)


def window_features(series: DataFrame, size: int, step: int, fs: float) -> DataFrame:
    """All 26 features of each window; what isn't finite is 0."""
    keys = ["animal", "label", "win"]
    table = time_features(series, size, step).join(peak_features(series, size, step), keys).join(spectral_features(series, size, step, fs), keys)
    clean = [F.coalesce(F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in FEATURES]
    return table.select(*keys, *clean)


def dead_features(table: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature, sd) of features that hardly vary."""
    sd = table.agg(*[F.stddev_pop(f).alias(f) for f in features])
    return sd.unpivot([], list(features), "feature", "sd").where("sd < 1e-12")


def long(table: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(animal, label, feature, value): each animal's mean of each feature, the unit of inference."""
    means = table.groupBy("animal", "label").agg(*[F.avg(f).alias(f) for f in features])
    return means.unpivot(["animal", "label"], list(features), "feature", "value")
