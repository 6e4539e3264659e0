import numpy as np
import pytest

from ridgeline.operators import signal


def series(spark, values, animal=0, label=0):
    return spark.createDataFrame([(animal, label, i, float(v)) for i, v in enumerate(values)], "animal long, label int, pos long, v double")


@pytest.mark.parametrize("n,want", [(20, [0, 1, 2, 3]), (8, [0]), (7, []), (0, [])])
def test_windows(spark, n, want):
    rows = signal.sliding_windows(series(spark, range(n)), 8, 4).collect()
    assert sorted({r.win for r in rows}) == want
    for w in want:
        assert sorted((r.k, r.v) for r in rows if r.win == w) == [(k, 4.0 * w + k) for k in range(8)]


@pytest.mark.parametrize("n", [450245, 450250])
def test_window_count_of_a_long_series(spark, n):
    df = spark.range(n).selectExpr("0L AS animal", "0 AS label", "id AS pos", "0D AS v")
    assert signal.window_counts(df, 5000, 2500).first()["windows"] == 179


@pytest.mark.parametrize("n,start", [(11, 3), (3, 0), (4, 0)])
def test_centre_crop(spark, n, start):
    rows = sorted((r.pos, r.v) for r in signal.centre_crop(series(spark, range(n)), 4).collect())
    assert rows == [(i, float(start + i)) for i in range(min(4, n))]


def test_zero_crossings_use_the_sign_bit(spark):
    row = signal.time_features(series(spark, [1, -1, 0, -0.0, 2]), 5, 5).first()
    assert row["zero_crossings"] == 4


@pytest.mark.parametrize("values,peaks", [([0, 1, 1, 1, 0], [2]), ([0, 1, 1, 0, 2, 0], [1, 4]), ([1, 1, 0, 1, 1], []), ([3, 1, 2], []), ([0, 5, 4, 4, 6, 1], [1, 4])])
def test_peaks(spark, values, peaks):
    rows = signal.extrema(series(spark, values)).where("kind = 'peak'").collect()
    assert sorted(r["at"] for r in rows) == peaks


def test_peaks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(signal, "RANGE", 4)
    rng = np.random.default_rng(7)
    x = [*rng.integers(0, 3, 60), *[5] * 15, 1, 2]  # runs longer than a range, and ranges without a start
    got = {(r.a, r.b, r.height, r.kind) for r in signal.extrema(series(spark, x)).collect()}
    edges = [i for i in range(len(x)) if i == 0 or x[i] != x[i - 1]]
    want = set()
    for before, at, after in zip(edges, edges[1:], edges[2:]):
        if (x[before] < x[at]) == (x[after] < x[at]):
            want.add((at, after - 1, float(x[at]), "peak" if x[before] < x[at] else "valley"))
    assert got == want and any(b - a > 8 for a, b, _, _ in got)


def test_features_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=100), 1)
    size, step = 20, 10
    got = {r.win: r for r in signal.window_features(series(spark, x), size, step, 20.0).collect()}
    assert sorted(got) == list(range((100 - size) // step + 1))
    for w, r in got.items():
        y = x[w * step : w * step + size]
        d = np.diff(y)
        peaks, valleys = [], 0
        i = 1
        while i < size - 1:
            j = i
            while j + 1 < size and y[j + 1] == y[i]:
                j += 1
            if j + 1 < size and y[i - 1] != y[i]:
                up, down = y[i - 1] < y[i] and y[j + 1] < y[i], y[i - 1] > y[i] and y[j + 1] > y[i]
                if up and y[i] >= y.mean() + 0.5 * y.std():
                    peaks.append(y[i])
                valleys += down and y[i] <= y.mean()
            i = j + 1
        want = [y.min(), y.max(), np.sum(np.diff(np.signbit(y))), np.sum(y**2), np.sqrt(np.mean(y**2)), d.std(), d.var(), len(peaks), len(peaks) / (valleys + 1), np.std(peaks) if peaks else 0.0]
        assert [r[f] for f in signal.TIME_FEATURES] == pytest.approx(want, abs=1e-9)


def test_sine_power_is_in_its_band():
    t = np.arange(5000) / 2500
    out = dict(zip(signal.SPECTRAL_FEATURES, signal.band_powers(np.sin(2 * np.pi * 10 * t)[None], 2500.0)[0]))
    assert out["alpha_rel"] > 0.99 and out["beta_rel"] < 0.01
    assert sum(v for k, v in out.items() if k.endswith("_rel")) <= 1 + 1e-9


def test_flat_series_has_no_power():
    assert not signal.band_powers(np.ones((2, 5000)), 2500.0).any()


def test_zscore_of_a_constant_is_null(spark):
    assert {r.v for r in signal.zscore(series(spark, [2, 2, 2])).collect()} == {None}


def test_finite(spark):
    assert signal.finite(series(spark, [1, float("nan"), float("inf"), -2])).count() == 2
