"""Queries over long series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ordered import numbered
from ..operators import ml, scenarios, signal
from ..sources import tables
from .common import FOLDED, LEAST, SERIES, SIZE, STEP, WINDOWS, r, rounded, windows

SEVEN = ("min", "max", "zero_crossings", "energy", "rms", "signal_variability", "diff_variance")
KEYS = ["animal", "label", "win"]

#: Windows of twice the sampling rate, so that their spectra are means of three segments.
LONG = 64


def series(spark: SparkSession, sf: str) -> DataFrame:
    return tables.series(spark, sf)


def included(spark: SparkSession, sf: str) -> DataFrame:
    """The series with enough windows."""
    s = series(spark, sf)
    enough = signal.window_counts(s, SIZE, STEP).where(F.col("windows") >= LEAST).select("animal")
    return s.join(enough, "animal", "left_semi")


def folded(spark: SparkSession, sf: str) -> DataFrame:
    """The series as those of 16 animals: users with one remainder, one after the other."""
    events = tables.read(spark, sf, "events")
    animal = F.col("user_id") % 16
    centred = events.select(animal.alias("animal"), (animal % 2).alias("label"), "user_id", "ts", "event_id", (F.col("value") - F.avg("value").over(Window.partitionBy("user_id"))).alias("v"))
    placed = numbered(centred, ["animal"], ["user_id", "ts", "event_id"], "pos")
    return placed.select("animal", "label", (F.col("pos") - 1).alias("pos"), "v")


def means(spark: SparkSession, sf: str) -> DataFrame:
    return signal.long(signal.time_features(included(spark, sf), SIZE, STEP), SEVEN)


def share_of_total(spark, sf):
    n = series(spark, sf).groupBy("animal").agg(F.count(F.lit(1)).alias("points"))
    total = n.agg(F.sum("points").alias("all"))
    return rounded(n.crossJoin(F.broadcast(total)).select("animal", "points", (100.0 * F.col("points") / F.col("all")).alias("percent")))


def union_groups(spark, sf):
    n = signal.finite(series(spark, sf)).groupBy("animal", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    number = F.row_number().over(Window.partitionBy("label").orderBy("animal")) - 1
    parts = [n.where(F.col("label") == k).withColumn("grp", F.lit(g)) for k, g in ((0, "control"), (1, "exercised"))]
    return rounded(parts[0].unionByName(parts[1]).withColumn("idx", number).select("grp", "idx", "animal", "n", "total"), 3)


def segments_per_animal(spark, sf):
    return signal.min_windows(signal.window_counts(series(spark, sf), SIZE, STEP), LEAST).select("animal", F.col("windows").alias("n_segments"), F.when(F.col("label") == 1, "exercised").otherwise("control").alias("grp"), "included")


def group_difference(spark, sf):
    table = stats.feature_table(means(spark, sf).where(F.col("feature").isin("energy", "rms", "zero_crossings")))
    return rounded(table.select("feature", "control_mean", "exercised_mean", "cohens_d", "mannwhitney_U", "p_bh_corrected"))


def bh(spark, sf):
    tests = stats.mann_whitney(means(spark, sf), "feature")
    table = stats.bonferroni(stats.bh_adjust(tests.withColumn("p", stats.u_normal_p(tests)), "p", "p_bh"), "p", "p_bonferroni")
    return rounded(table.select("feature", "p", "p_bh", "p_bonferroni"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(animal, true_label, prob): a stand-in score from the events table."""
    e = tables.read(spark, sf, "events")
    return e.select((F.col("user_id") % 16).alias("animal"), (F.col("user_id") % 2).alias("true_label"), (F.col("value") - F.floor("value")).alias("prob"))


def animal_predictions(spark, sf):
    return predictions(spark, sf).groupBy("animal", "true_label").agg(F.avg("prob").alias("p"), F.count(F.lit(1)).alias("instances")).select(
        "animal", "true_label", F.col("p").alias("mean_pred_prob"), (F.round("p", 9) > 0.5).cast("int").alias("predicted_label"), ((F.round("p", 9) > 0.5).cast("int") == F.col("true_label")).cast("int").alias("correct"), "instances"
    )


def animal_accuracy_wilson(spark, sf):
    row = animal_predictions(spark, sf).agg(F.sum("correct").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return rounded(row.select("k", "n", (F.col("k") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high")))


def auc_by_rank(spark, sf):
    scored = tables.read(spark, sf, "labels").join(tables.read(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rounded(stats.auc(scored.withColumn("toxic", F.col("toxic").cast("long")), "toxic", "n_chars", "lang").select("lang", "n1", "n0", "auc"))


def outer_folds(spark, sf):
    counts = signal.window_counts(folded(spark, sf), SIZE, STEP)
    return scenarios.fold_sizes(scenarios.outer_folds(counts), counts)


def fold_interval(spark, sf):
    """Mean and t interval over folds of the share of test windows."""
    sizes = outer_folds(spark, sf).withColumn("share", F.col("n_test") / (F.col("n_train") + F.col("n_test")))
    return rounded(stats.t_interval(sizes, "share"), 4)


def feature_matrix(spark, sf):
    return signal.window_features(folded(spark, sf), SIZE, STEP, float(SIZE))


QUERIES = {
    "group_difference": group_difference,
    "center_crop": lambda s, d: rounded(signal.centre_crop(series(s, d), 40), 9),
    "zscore_series": lambda s, d: rounded(signal.zscore(series(s, d))),
    "share_of_total": share_of_total,
    "union_groups": union_groups,
    "sliding_windows": lambda s, d: rounded(signal.sliding_windows(series(s, d), SIZE, STEP).select(*KEYS, "k", "v"), 9),
    "window_time_features": lambda s, d: rounded(signal.time_features(series(s, d), SIZE, STEP)),
    "zero_crossings": lambda s, d: signal.time_features(series(s, d), SIZE, STEP).groupBy("animal").agg(F.sum("zero_crossings").alias("zero_crossings")),
    "peak_features": lambda s, d: rounded(signal.peak_features(series(s, d), SIZE, STEP)),
    "welch_band_power": lambda s, d: rounded(signal.spectral_features(series(s, d), SIZE, STEP, float(SIZE)).select(*KEYS, *[f"{b}_power" for b in ("delta", "theta", "alpha")], "delta_rel", "theta_rel"), 3),
    "min_windows_filter": lambda s, d: included(s, d).groupBy("animal").agg(F.count(F.lit(1)).alias("n")),
    "segments_per_animal": segments_per_animal,
    "animal_feature_means": lambda s, d: rounded(means(s, d)),
    "cohens_d_table": lambda s, d: rounded(stats.group_summary(means(s, d))),
    "mannwhitney_u": lambda s, d: rounded(stats.mann_whitney(means(s, d), "feature").select("feature", "n1", "n0", "u")),
    "bh_bonferroni_adjust": bh,
    "animal_predictions": lambda s, d: rounded(animal_predictions(s, d)),
    "animal_accuracy_wilson": animal_accuracy_wilson,
    "auc_by_rank": auc_by_rank,
    "outer_folds": outer_folds,
    "fold_interval": fold_interval,
    "welch_segments": lambda s, d: rounded(signal.spectral_features(folded(s, d), LONG, LONG // 2, LONG / 2), 3),
    "dead_features": lambda s, d: signal.dead_features(feature_matrix(s, d)),
    "window_features": lambda s, d: rounded(feature_matrix(s, d)),
    "vif_diagnostic": lambda s, d: rounded(ml.vif(feature_matrix(s, d), signal.FEATURES), 3),
    "vif_filter": lambda s, d: ml.vif_filter(feature_matrix(s, d), signal.FEATURES),
    "gbm_nested_cv": lambda s, d: rounded(ml.nested_cv(feature_matrix(s, d), signal.FEATURES)),
    "gbm_permutation": lambda s, d: rounded(ml.permutation_test(ml.permutation_null(feature_matrix(s, d), signal.FEATURES))),
    "gbm_feature_importance": lambda s, d: rounded(ml.importance(feature_matrix(s, d), signal.FEATURES)),
}

_SEVEN = """time_features AS (SELECT animal, label, win, min(v) AS "min", max(v) AS "max", sum(CASE WHEN k > 0 AND (v < 0) <> (before < 0) THEN 1 ELSE 0 END)::BIGINT AS zero_crossings,
  sum(v * v) AS energy, sqrt(avg(v * v)) AS rms, stddev_pop(CASE WHEN k > 0 THEN v - before END) AS signal_variability, var_pop(CASE WHEN k > 0 THEN v - before END) AS diff_variance
  FROM windowed GROUP BY animal, label, win)"""
_MEANS = f"""{WINDOWS}, {_SEVEN}, enough AS (SELECT animal FROM time_features GROUP BY animal HAVING count(*) >= {LEAST}),
wide AS (SELECT animal, label, {", ".join(f'avg("{f}") AS "{f}"' for f in SEVEN)} FROM time_features WHERE animal IN (SELECT animal FROM enough) GROUP BY animal, label),
means AS ({" UNION ALL ".join(f"SELECT animal, label, '{f}' AS feature, " + f'"{f}"' + " AS value FROM wide" for f in SEVEN)})"""
_SUMMARY = """summary AS (SELECT feature, avg(value) FILTER (WHERE label = 0) AS m0, stddev_samp(value) FILTER (WHERE label = 0) AS s0, avg(value) FILTER (WHERE label = 1) AS m1, stddev_samp(value) FILTER (WHERE label = 1) AS s1,
  count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM means GROUP BY feature),
cohen AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * s1 * s1 + (n0 - 1) * s0 * s0) / (n0 + n1 - 2)) AS d FROM summary)"""
_RANKS = """ranks AS (SELECT feature, label, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY feature, value) AS ties FROM means),
tests AS (SELECT feature, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, sum(rk) FILTER (WHERE label = 1) AS r1, sum(ties * ties - 1) AS tie_term FROM ranks GROUP BY feature),
us AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n0 AS n FROM tests),
zs AS (SELECT *, greatest((abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n0 / 12.0::DOUBLE * (n + 1 - tie_term / (n * (n - 1))::DOUBLE)), 0) AS z FROM us),
ps AS (SELECT *, least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))) AS p
  FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM zs)),
bh AS (SELECT *, least(min(p * m / rk) OVER (ORDER BY p DESC, p * m / rk ROWS UNBOUNDED PRECEDING), 1) AS p_bh FROM (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM {source}))"""
_FOLDS = f"""centred AS (SELECT user_id % 16 AS animal, user_id, ts, event_id FROM events), sizes AS (SELECT animal, animal % 2 AS label, greatest((count(*) - {SIZE}) // {STEP} + 1, 0) AS windows FROM centred GROUP BY animal),
folds AS (SELECT row_number() OVER (ORDER BY a.animal::VARCHAR, b.animal::VARCHAR) - 1 AS fold, a.animal::VARCHAR AS control, b.animal::VARCHAR AS exercised, a.windows + b.windows AS n_test, (SELECT sum(windows) FROM sizes)::BIGINT - a.windows - b.windows AS n_train
  FROM sizes a CROSS JOIN sizes b WHERE a.label = 0 AND b.label = 1)"""
_CALLS = """calls AS (SELECT user_id % 16 AS animal, user_id % 2 AS true_label, avg(value - floor(value)) AS p, count(*) AS instances FROM events GROUP BY 1, 2),
called AS (SELECT *, (round(p, 9) > 0.5)::INT AS predicted_label, ((round(p, 9) > 0.5)::INT = true_label)::INT AS correct FROM calls)"""
_WELCH = f"""mean AS (SELECT animal, label, win, avg(v) AS m FROM windowed GROUP BY ALL),
tapered AS (SELECT w.animal, w.label, w.win, w.k, (w.v - m.m) * (0.5 - 0.5 * cos(2 * pi() * w.k / {SIZE})) AS x FROM windowed w JOIN mean m USING (animal, label, win)),
psd AS (SELECT animal, label, win, f.f, CASE WHEN f.f IN (0, {SIZE // 2}) THEN 1 ELSE 2 END * (power(sum(x * cos(2 * pi() * f.f * k / {SIZE})), 2) + power(sum(x * sin(2 * pi() * f.f * k / {SIZE})), 2)) / ({SIZE} * {3 * SIZE / 8}::DOUBLE) AS p
  FROM tapered CROSS JOIN (SELECT unnest(range(0, {SIZE // 2 + 1})) AS f) f GROUP BY animal, label, win, f.f),
area AS (SELECT animal, label, win, f, (p + lead(p) OVER (PARTITION BY animal, win ORDER BY f)) / 2 AS a FROM psd)"""
_PEAKS = f"""runs AS (SELECT animal, run, min(pos) AS a, max(pos) AS b, any_value(v) AS h FROM (SELECT *, sum(CASE WHEN before IS NULL OR v <> before THEN 1 ELSE 0 END) OVER (PARTITION BY animal ORDER BY pos) AS run FROM numbered) GROUP BY animal, run),
sides AS (SELECT *, lag(h) OVER (PARTITION BY animal ORDER BY run) AS lo, lead(h) OVER (PARTITION BY animal ORDER BY run) AS hi FROM runs),
tops AS (SELECT animal, a, b, h, lo < h AS peak FROM sides WHERE (lo < h AND hi < h) OR (lo > h AND hi > h)),
level AS (SELECT animal, label, win, avg(v) AS m, stddev_pop(v) AS sd FROM windowed GROUP BY ALL),
hits AS (SELECT l.animal, l.label, l.win, t.h, coalesce(t.peak AND t.h >= l.m + 0.5 * l.sd, false) AS is_peak, coalesce(NOT t.peak AND t.h <= l.m, false) AS is_valley
  FROM level l LEFT JOIN tops t ON t.animal = l.animal AND t.a - 1 >= l.win * {STEP} AND t.b + 1 <= l.win * {STEP} + {SIZE - 1})"""

_MATRIX = f"""{windows(FOLDED)}, {_SEVEN}, {_PEAKS}, {_WELCH},
peaks AS (SELECT animal, win, sum(is_peak::INT)::DOUBLE AS num_peaks, sum(is_peak::INT)::DOUBLE / (sum(is_valley::INT) + 1) AS peak_valley_ratio, coalesce(stddev_pop(CASE WHEN is_peak THEN h END), 0) AS std_peak_height FROM hits GROUP BY animal, win),
power AS (SELECT animal, win, sum(a) FILTER (WHERE f >= 1 AND f < 4) AS delta_power, sum(a) FILTER (WHERE f >= 4 AND f < 8) AS theta_power, sum(a) AS total FROM area GROUP BY animal, win),
matrix AS (SELECT t.* REPLACE (zero_crossings::DOUBLE AS zero_crossings), p.num_peaks, p.peak_valley_ratio, p.std_peak_height, w.delta_power, w.theta_power, coalesce(w.delta_power / nullif(w.total, 0), 0) AS delta_rel, coalesce(w.theta_power / nullif(w.total, 0), 0) AS theta_rel,
  {", ".join(f"0.0::DOUBLE AS {f}" for f in signal.SPECTRAL_FEATURES if f.split("_")[0] not in ("delta", "theta"))} FROM time_features t JOIN peaks p USING (animal, win) JOIN power w USING (animal, win))"""
_LONG = f"""{windows(FOLDED, LONG, LONG // 2)},
parts AS (SELECT animal, label, win, s, k - s AS j, v - avg(v) OVER (PARTITION BY animal, win, s) AS x FROM windowed JOIN (SELECT unnest([0, {LONG // 4}, {LONG // 2}]) AS s) ON k >= s AND k < s + {LONG // 2}),
one AS (SELECT animal, label, win, s, f, power(sum(x * t * cos(2 * pi() * f * j / {LONG // 2})), 2) + power(sum(x * t * sin(2 * pi() * f * j / {LONG // 2})), 2) AS p
  FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {LONG // 2}) AS t FROM parts) CROSS JOIN (SELECT unnest(range(0, {LONG // 4 + 1})) AS f) GROUP BY ALL),
psd AS (SELECT animal, label, win, f, CASE WHEN f IN (0, {LONG // 4}) THEN 1 ELSE 2 END * avg(p) / ({LONG // 2} * {3 * LONG // 16}::DOUBLE) AS p FROM one GROUP BY animal, label, win, f),
area AS (SELECT animal, label, win, f, (p + lead(p) OVER (PARTITION BY animal, win ORDER BY f)) / 2 AS a FROM psd),
bands AS (SELECT animal, label, win, sum(a) FILTER (WHERE f >= 1 AND f < 4) AS delta, sum(a) FILTER (WHERE f >= 4 AND f < 8) AS theta, sum(a) FILTER (WHERE f >= 8 AND f < 13) AS alpha, sum(a) FILTER (WHERE f >= 13 AND f < 16) AS beta, sum(a) AS total FROM area GROUP BY ALL)"""

_FLOATS = [f for f in SEVEN if f != "zero_crossings"]
ORACLES = {
    "welch_segments": f"WITH {_LONG} SELECT animal, label, win, {', '.join(r(b, b + '_power', 3) + ', ' + r(f'{b} / total', b + '_rel', 3) for b in ('delta', 'theta', 'alpha', 'beta'))}, {', '.join(f'0.0::DOUBLE AS {f}' for f in signal.SPECTRAL_FEATURES if f.split('_')[0] not in ('delta', 'theta', 'alpha', 'beta'))} FROM bands",
    "window_features": f"WITH {_MATRIX} SELECT animal, label, win, {', '.join(r(chr(34) + f + chr(34), chr(34) + f + chr(34)) for f in signal.FEATURES)} FROM matrix",
    "dead_features": f"WITH {_MATRIX} SELECT * FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{f}{chr(39)} AS feature, stddev_pop({chr(34)}{f}{chr(34)}) AS sd FROM matrix' for f in signal.FEATURES)}) WHERE sd < 1e-12",
    "group_difference": f"WITH {_MEANS}, {_SUMMARY}, {_RANKS.replace('{source}', '''(SELECT * FROM ps WHERE feature IN ('energy', 'rms', 'zero_crossings'))''')} SELECT c.feature, {r('m0', 'control_mean')}, {r('m1', 'exercised_mean')}, {r('d', 'cohens_d')}, {r('u', '''"mannwhitney_U"''')}, {r('p_bh', 'p_bh_corrected')} FROM cohen c JOIN bh USING (feature)",
    "center_crop": f"WITH {SERIES}, c AS (SELECT *, greatest((count(*) OVER (PARTITION BY animal) - 40) // 2, 0) AS s FROM series) SELECT animal, label, pos - s AS pos, {r('v', 'v', 9)} FROM c WHERE pos >= s AND pos < s + 40",
    "zscore_series": f"WITH {SERIES} SELECT animal, label, pos, {r('(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)', 'v')} FROM series WINDOW w AS (PARTITION BY animal)",
    "share_of_total": f"SELECT user_id AS animal, count(*) AS points, {r('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()', 'percent')} FROM events GROUP BY user_id",
    "union_groups": f"WITH {SERIES}, g AS (SELECT animal, label, count(*) AS n, sum(v) AS total FROM series GROUP BY ALL) SELECT CASE label WHEN 0 THEN 'control' ELSE 'exercised' END AS grp, row_number() OVER (PARTITION BY label ORDER BY animal) - 1 AS idx, animal, n, {r('total', 'total', 3)} FROM g",
    "sliding_windows": f"WITH {WINDOWS} SELECT animal, label, win, k, {r('v', 'v', 9)} FROM windowed",
    "window_time_features": f"WITH {WINDOWS}, {_SEVEN} SELECT animal, label, win, zero_crossings, {', '.join(r(chr(34) + f + chr(34), chr(34) + f + chr(34)) for f in _FLOATS)} FROM time_features",
    "zero_crossings": f"WITH {WINDOWS}, {_SEVEN} SELECT animal, sum(zero_crossings)::BIGINT AS zero_crossings FROM time_features GROUP BY animal",
    "peak_features": f"WITH {WINDOWS}, {_PEAKS} SELECT animal, label, win, sum(is_peak::INT)::BIGINT AS num_peaks, {r('sum(is_peak::INT)::DOUBLE / (sum(is_valley::INT) + 1)', 'peak_valley_ratio')}, {r('coalesce(stddev_pop(CASE WHEN is_peak THEN h END), 0)', 'std_peak_height')} FROM hits GROUP BY animal, label, win",
    "welch_band_power": f"WITH {WINDOWS}, {_WELCH} SELECT animal, label, win, {r('sum(a) FILTER (WHERE f >= 1 AND f < 4)', 'delta_power', 3)}, {r('sum(a) FILTER (WHERE f >= 4 AND f < 8)', 'theta_power', 3)}, 0.0::DOUBLE AS alpha_power, {r('sum(a) FILTER (WHERE f >= 1 AND f < 4) / sum(a)', 'delta_rel', 3)}, {r('sum(a) FILTER (WHERE f >= 4 AND f < 8) / sum(a)', 'theta_rel', 3)} FROM area GROUP BY animal, label, win",
    "min_windows_filter": f"SELECT user_id AS animal, count(*) AS n FROM events GROUP BY user_id HAVING (count(*) - {SIZE}) // {STEP} + 1 >= {LEAST}",
    "segments_per_animal": f"SELECT user_id AS animal, greatest((count(*) - {SIZE}) // {STEP} + 1, 0) AS n_segments, CASE user_id % 2 WHEN 1 THEN 'exercised' ELSE 'control' END AS grp, greatest((count(*) - {SIZE}) // {STEP} + 1, 0) >= {LEAST} AS included FROM events GROUP BY user_id",
    "animal_feature_means": f"WITH {_MEANS} SELECT animal, label, feature, {r('value', 'value')} FROM means",
    "cohens_d_table": f"WITH {_MEANS}, {_SUMMARY} SELECT feature, {r('m0', 'control_mean')}, {r('s0', 'control_sd')}, {r('m1', 'exercised_mean')}, {r('s1', 'exercised_sd')}, {r('d', 'cohens_d')} FROM cohen",
    "mannwhitney_u": f"WITH {_MEANS}, {_RANKS.replace('{source}', 'ps')} SELECT feature, n1, n0, {r('u', 'u')} FROM us",
    "bh_bonferroni_adjust": f"WITH {_MEANS}, {_RANKS.replace('{source}', 'ps')} SELECT feature, {r('p', 'p')}, {r('p_bh', 'p_bh')}, {r('least(p * m, 1)', 'p_bonferroni')} FROM bh",
    "animal_predictions": f"WITH {_CALLS} SELECT animal, true_label, {r('p', 'mean_pred_prob')}, predicted_label, correct, instances FROM called",
    "animal_accuracy_wilson": f"WITH {_CALLS}, s AS (SELECT sum(correct)::BIGINT AS k, count(*) AS n, sum(correct)::DOUBLE / count(*) AS p, {stats.Z_975!r}::DOUBLE AS z FROM called), c AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) AS half FROM s) SELECT k, n, {r('p', 'accuracy')}, {r('greatest(mid - half, 0)', 'low')}, {r('least(mid + half, 1)', 'high')} FROM c",
    "auc_by_rank": f"WITH s AS (SELECT d.lang, l.toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0, sum(rk) FILTER (WHERE toxic = 1) AS r1 FROM s GROUP BY lang) SELECT lang, n1, n0, {r('CASE WHEN n1 > 0 AND n0 > 0 THEN (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END', 'auc')} FROM t",
    "outer_folds": f"WITH {_FOLDS} SELECT fold, control, exercised, n_train, n_test FROM folds",
    "fold_interval": f"WITH {_FOLDS}, s AS (SELECT avg(n_test::DOUBLE / (n_train + n_test)) AS m, stddev_samp(n_test::DOUBLE / (n_train + n_test)) AS sd, count(*) AS n FROM folds) SELECT {r('m', 'mean')}, {r(f'm - sd / sqrt(n) * {stats.t_quantile(0.975, 63)!r}', 'low')}, {r(f'm + sd / sqrt(n) * {stats.t_quantile(0.975, 63)!r}', 'high')} FROM s",
}
