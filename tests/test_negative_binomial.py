"""The iterative fit against scalar arithmetic, gene by gene, and against planted values."""

import math

import numpy as np
import pytest

from ridgeline.operators import negative_binomial as nb


def drawn(seed, genes, samples, second, noise=0.3, changed=0.2):
    rng = np.random.default_rng(seed)
    mean = np.exp(rng.normal(5, 1.2, genes))
    alpha = (0.1 + 4 / mean) * np.exp(rng.normal(0, noise, genes))
    factor = np.exp(rng.normal(0, 0.2, samples))
    x = (np.arange(samples) < second).astype(float)
    change = np.where(rng.random(genes) < changed, rng.normal(0, 1.5, genes), 0)
    mu = mean[:, None] * factor * 2 ** (change[:, None] * x)
    y = rng.poisson(rng.gamma(1 / alpha[:, None], mu * alpha[:, None])).astype(float)
    return y, factor, x, alpha, change


def tables(spark, y, x, category="c"):
    bulk = spark.createDataFrame([(category, s, g, int(y[g, s])) for g in range(len(y)) for s in range(y.shape[1]) if y[g, s]], "category string, sample long, gene long, n long")
    groups = spark.createDataFrame([("all", s, int(x[s])) for s in range(len(x))], "scenario string, sample long, grp int")
    return bulk, groups


# --- scalar versions


def loglik(y, mu, alpha):
    r = 1 / alpha
    return sum(math.lgamma(a + r) - math.lgamma(r) - a * math.log(m + r) - r * math.log1p(m * alpha) for a, m in zip(y, mu))


def adjusted(y, mu, x, alpha):
    w = [1 / (1 / m + alpha) for m in mu]
    return loglik(y, mu, alpha) - 0.5 * math.log(sum(a for a, b in zip(w, x) if b) * sum(a for a, b in zip(w, x) if not b))


def fitted(y, sf, x):
    q = [a / b for a, b in zip(y, sf)]
    means = [np.mean([v for v, g in zip(q, x) if g == k]) for k in (0, 1)]
    return [max(b * means[int(g)], 0.5) for b, g in zip(sf, x)]


def best(f, low, high):
    grid = np.linspace(low, high, 400)
    at = grid[int(np.argmax([f(t) for t in grid]))]
    a, b = max(low, at - 0.1), min(high, at + 0.1)
    for _ in range(80):
        c, d = a + (b - a) / 3, b - (b - a) / 3
        a, b = (c, b) if f(c) < f(d) else (a, d)
    return math.exp((a + b) / 2)


def own(y, sf, x):
    mu = fitted(y, sf, x)
    return min(max(best(lambda t: adjusted(y, mu, x, math.exp(t)), math.log(1e-9), math.log(10)), 1e-8), 10.0)


def coefficients(y, sf, x, alpha):
    """Newton steps on both groups' means, which is what the regression is for one two-valued term."""
    out, errors = [], 0.0
    for k in (0, 1):
        at = [i for i, g in enumerate(x) if g == k]
        b = math.log(max(np.mean([y[i] / sf[i] for i in at]), 1e-3))
        for _ in range(200):
            mu = [sf[i] * math.exp(b) for i in at]
            b += sum((y[i] - m) / (1 + alpha * m) for i, m in zip(at, mu)) / sum(m / (1 + alpha * m) for m in mu)
        out.append(b)
        errors += 1 / sum(sf[i] * math.exp(b) / (1 + alpha * sf[i] * math.exp(b)) for i in at)
    return (out[1] - out[0]) / math.log(2), math.sqrt(errors) / math.log(2)


def bh(p):
    order, out, least = np.argsort(p), np.empty(len(p)), 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        out[order[rank - 1]] = least
    return out


def gamma_trend(mean, disp):
    coefs = np.array([0.1, 1.0])
    while True:
        ratio = disp / (coefs[0] + coefs[1] / mean)
        good = (ratio > 1e-4) & (ratio < 15)
        x, y, new = np.column_stack([np.ones(good.sum()), 1 / mean[good]]), disp[good], coefs
        for _ in range(200):
            w = 1 / (x @ new) ** 2
            new = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        if (np.log(new / coefs) ** 2).sum() < 1e-6:
            return new
        coefs = new


# --- tests


def test_log_gamma():
    x = np.array([1e-9, 0.3, 1, 2.5, 10, 1e4, 1e8, 3e9])
    assert nb.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    assert nb.trigamma(1.5) == pytest.approx(math.pi**2 / 2 - 4, abs=1e-10)


def test_steps_on_fifty_genes():
    y, sf, x, _, _ = drawn(1, 50, 5, 2)
    many = (y, np.tile(sf, (50, 1)), np.tile(x, (50, 1)))
    found = nb.own_dispersion(*many)
    plain = [own(y[g], sf, x) for g in range(50)]
    assert np.log(found) == pytest.approx(np.log(plain), abs=2e-3)
    trend, prior, spread = np.full(50, 0.2), np.full(50, 0.7), np.full(50, 2.0)
    shared = nb.shared_dispersion(*many, found, trend, prior, spread)
    for g in range(50):
        mu = fitted(y[g], sf, x)
        want = best(lambda t: adjusted(y[g], mu, x, math.exp(t)) - (t - math.log(0.2)) ** 2 / 1.4, math.log(1e-9), math.log(10))
        want = found[g] if math.log(found[g]) > math.log(0.2) + 2 * math.sqrt(2) else want
        assert math.log(shared[g]) == pytest.approx(math.log(want), abs=2e-3)
    change, error, converged, _, _ = nb.regression(*many, shared)
    assert converged.all()
    for g in range(50):
        a, b = coefficients(y[g], sf, x, shared[g])
        if min(fitted(y[g], sf, x)) > 1:
            assert change[g] == pytest.approx(a, abs=1e-4) and error[g] == pytest.approx(b, rel=1e-4)


def test_planted_dispersions_are_recovered():
    y, sf, x, alpha, change = drawn(2, 2000, 24, 12)
    many = (y, np.tile(sf, (2000, 1)), np.tile(x, (2000, 1)))
    found = nb.own_dispersion(*many)
    # stated error: the median within 5 %, a gene within a factor of exp(0.4) on the mean
    assert 0.95 < np.median(found / alpha) < 1.05 and np.std(np.log(found / alpha)) < 0.4
    lfc, error, converged, _, _ = nb.regression(*many, alpha)
    z = (lfc - change) / error
    assert converged.mean() > 0.99 and abs(z.mean()) < 0.1 and 0.9 < z.std() < 1.1


def test_whole_fit(spark):
    y, sf, x, alpha, change = drawn(3, 600, 12, 6, noise=0.4)
    y[5, 0] = 50 * y[5].max()  # an outlier in a group of six
    bulk, groups = tables(spark, y, x)
    rows = {r.gene: r for r in nb.wald(bulk, groups, 5, 2).collect()}
    kept = [g for g in range(600) if (y[g] >= 5).sum() >= 2]
    assert set(rows) == set(kept)
    # size factors and the trend by plain arithmetic
    whole = [g for g in kept if (y[g] > 0).all()]
    logs = np.log(y[whole])
    factor = np.exp(np.median(logs - logs.mean(1, keepdims=True), axis=0))
    mean = (y / factor).mean(1)
    assert all(rows[g].baseMean == pytest.approx(mean[g], rel=1e-9) for g in kept)
    many = (y[kept], np.tile(factor, (len(kept), 1)), np.tile(x, (len(kept), 1)))
    disp = nb.own_dispersion(*many)
    used = disp > nb.USED
    a0, a1 = gamma_trend(mean[kept][used], disp[used])
    trend = a0 + a1 / mean[kept]
    table = spark.createDataFrame([("all", "c", float(m), float(d)) for m, d in zip(mean[kept], disp)], "scenario string, category string, base_mean double, own double")
    assert nb.trends(table)["all", "c"]["a"] == pytest.approx((a0, a1), rel=1e-5)
    residual = np.log(disp[used]) - np.log(trend[used])
    spread = (1.4826 * np.median(np.abs(residual - np.median(residual)))) ** 2
    prior = max(spread - nb.trigamma(5.0), 0.25)
    n = len(kept)
    shared = nb.shared_dispersion(*many, disp, trend, np.full(n, prior), np.full(n, spread))
    assert [rows[g].dispersion for g in kept] == pytest.approx(shared, rel=1e-4)
    lfc, error, _, _, _ = nb.regression(*many, shared)
    assert [rows[g].log2FoldChange for g in kept] == pytest.approx(lfc, abs=1e-5) and [rows[g].lfcSE for g in kept] == pytest.approx(error, rel=1e-4)
    assert all(rows[g].converged for g in kept) and rows[5].pvalue is None and rows[5].padj is None
    p = {g: rows[g].pvalue for g in kept if rows[g].pvalue is not None}
    assert all(p[g] == pytest.approx(math.erfc(abs(rows[g].stat) / math.sqrt(2)), abs=1e-12) for g in p)
    tested = [g for g in p if rows[g].padj is not None]
    assert min(mean[tested]) > max([m for g, m in enumerate(mean) if g in p and g not in tested], default=0)  # a filter on the mean
    assert [rows[g].padj for g in tested] == pytest.approx(bh(np.array([p[g] for g in tested])), abs=1e-9)
    hits = [g for g in tested if rows[g].padj < 0.05]
    assert np.mean([change[g] != 0 for g in hits]) > 0.9 and len(hits) > 30


def test_filter_counts(spark):
    rng = np.random.default_rng(4)
    mean = np.exp(rng.normal(3, 2, 800))
    p = np.where((mean > 20) & (rng.random(800) < 0.5), rng.random(800) ** 6, rng.random(800))
    df = spark.createDataFrame([("s", "c", i, float(m), float(v)) for i, (m, v) in enumerate(zip(mean, p))], "scenario string, category string, gene long, baseMean double, pvalue double")
    got = {r.gene: r.padj for r in nb.filtered_padj(df).collect()}
    shares = np.linspace(0, 0.95, nb.FILTERS)
    cuts = np.quantile(mean, shares, method="inverted_cdf")
    rejected = np.array([(bh(p[mean >= c]) < nb.ALPHA).sum() for c in cuts])
    cut = cuts[nb.chosen_filter(shares, rejected)]
    assert cut > cuts[0]
    want = dict(zip(np.flatnonzero(mean >= cut), bh(p[mean >= cut])))
    assert {g for g, v in got.items() if v is not None} == set(want) and all(got[g] == pytest.approx(v, abs=1e-9) for g, v in want.items())


def test_lowess_of_a_line():
    x = np.linspace(0, 1, 50)
    y = 3 + 2 * x
    y[10] = 50
    assert nb.lowess(x, y)[[0, 5, 25, 49]] == pytest.approx(3 + 2 * x[[0, 5, 25, 49]], abs=1e-3)


@pytest.mark.parametrize("width", [0.25, 1.0, 3.0])
def test_prior_of_few_samples(width):
    rng = np.random.default_rng(5)
    residual = np.log(rng.chisquare(3, 40_000) / 3) + rng.normal(0, math.sqrt(width), 40_000)
    histogram = np.histogram(residual, np.arange(-10, 10.5, 0.5))[0]
    assert nb.prior_variance(histogram, 3, 0.0) == pytest.approx(width, abs=0.25 * max(width, 1))
    assert nb.prior_variance(histogram, 20, 1.0) == pytest.approx(max(1 - nb.trigamma(10.0), 0.25))


def test_local_trend_where_the_line_fails(spark):
    rng = np.random.default_rng(6)
    mean = np.exp(rng.normal(4, 1.5, 500))
    disp = 0.01 * mean**0.5  # rises, so a1 would be negative
    df = spark.createDataFrame([("s", "c", float(m), float(d)) for m, d in zip(mean, disp)], "scenario string, category string, base_mean double, own double")
    found = nb.trends(df)["s", "c"]
    us, vs = map(np.array, found["points"])
    inner = (us > np.quantile(np.log(mean), 0.1)) & (us < np.quantile(np.log(mean), 0.9))
    assert vs[inner] == pytest.approx(math.log(0.01) + 0.5 * us[inner], abs=0.1)


def test_status(spark):
    y, _, x, _, _ = drawn(7, 60, 5, 2)
    bulk, _ = tables(spark, y, x)
    low = spark.createDataFrame([("low", s, g, 6) for s in range(5) for g in range(4)], "category string, sample long, gene long, n long")
    flat = spark.createDataFrame([("flat", s, g, 1000) for s in range(5) for g in range(40)], "category string, sample long, gene long, n long")
    every = bulk.unionByName(low).unionByName(flat)
    groups = spark.createDataFrame([("all", s, int(s < 2)) for s in range(5)] + [("pair", s, int(s < 1)) for s in range(2)], "scenario string, sample long, grp int")
    table = nb.wald(every, groups, 5, 2)
    got = {(r.scenario, r.category): r for r in nb.status_table(table, every, groups, 5, 2, 1000).collect()}
    assert got["all", "c"].status == "analysed" and got["all", "c"].genes_tested > 40 and got["all", "c"].n_padj_005 is not None
    assert {got[k].status for k in (("all", "low"), ("pair", "low"))} == {"skipped_low_depth"} and got["all", "low"].genes_tested is None
    # no spread at all, or no replicates: no trend
    assert {got[k].status for k in (("all", "flat"), ("pair", "c"), ("pair", "flat"))} == {"skipped_fit_failed"} and got["all", "flat"].n_padj_005 is None
    empty = nb.wald(every.where("n < 0"), groups, 5, 2)
    assert empty.collect() == []
