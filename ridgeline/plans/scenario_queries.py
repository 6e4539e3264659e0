"""Tests of beads, expression over scenarios, leading edges, and sets of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, counts, enrichment, expression, negative_binomial, scenarios, spatial
from ..operators.shuffles import checkpoint
from ..sources import tables
from .common import BULK, COUNTS, r, rounded
from .count_queries import _DE, _RANKED, _SPLITS, IN_SAMPLES, LEAST, SAMPLES, THRESHOLDS, bulk, confident, de_table, gene_sets, genes, ranked, sham, split_groups

#: Least total of a sample for a category to be analysed, and least beads of a sample in a category.
MIN_TOTAL, MIN_BEADS = 100_000, 3


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, gene, flag, status, n): counts with two variables to group by."""
    rows = tables.read(spark, sf, "lineitem")
    return rows.select((F.col("l_suppkey") % 5).alias("sample"), F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("n"))


def bead_level_test(spark, sf):
    """Beads of samples 0 and 1 against the others, by category."""
    c = tables.counts(spark, sf)
    beads = c.select("category", "sample", "bead").distinct().withColumn("grp", (F.col("sample") < 2).cast("int"))
    return rounded(counts.bead_level_test(c, beads, MIN_BEADS))


def de_status(spark, sf):
    return rounded(expression.status_table(de_table(spark, sf), bulk(spark, sf), MIN_TOTAL, len(SAMPLES)), 9)


def left_out(spark: SparkSession, sf: str) -> DataFrame:
    """(scenario, sample, grp): all samples, and all but each of the larger group."""
    items = checkpoint(tables.places(spark, sf).select(F.col("sample").alias("item")).distinct())
    plan = scenarios.leave_one_out(items, items.where("item >= 2"))
    return plan.select("scenario", F.col("item").alias("sample"), (F.col("item") < 2).cast("int").alias("grp"))


def nb_wald(spark, sf):
    """The iterative fit of the true design and of a sham one, per category."""
    return rounded(negative_binomial.wald(bulk(spark, sf), sham(spark), LEAST, IN_SAMPLES), 6)


def nb_leave_one_out(spark, sf):
    """Status and summary of the iterative fit per category, with all samples and without each of the larger group."""
    groups = left_out(spark, sf)
    table = negative_binomial.wald(bulk(spark, sf), groups, LEAST, IN_SAMPLES)
    return rounded(negative_binomial.status_table(table, bulk(spark, sf), groups, LEAST, IN_SAMPLES, MIN_TOTAL))


def leave_one_out_de(spark, sf):
    """Expression with all samples and without each of the larger group, all in one plan; a scenario has its own filter and factors."""
    groups = left_out(spark, sf)
    return rounded(expression.summary(expression.wald(bulk(spark, sf), groups, LEAST, IN_SAMPLES), "scenario", "category"))


#: Sets that are reported for every scenario.
TRACKED = {"first": "Brand#1", "second": "Brand#2"}


def scenario_enrichment(spark: SparkSession, sf: str, table: DataFrame, groups: DataFrame) -> DataFrame:
    """Per scenario and category of ``table`` (see :func:`expression.wald`): samples, genes tested and significant, sets significant, NES and padj of the tracked sets.

    Each scenario and category has a list of its own: identifiers are mapped and made unique, ranked, and tested against nulls of that list.
    """
    table = checkpoint(table.select("scenario", "category", "gene", "log2FoldChange", "stat", "padj"))
    lists = enrichment.map_genes(table.select("scenario", "category", "gene", "stat"), tables.gene_map(spark, sf), "scenario", "category")
    # only lists with a set to test are put in order
    chosen = enrichment.sized(lists, gene_sets(spark, sf), "scenario", "category")
    listed = enrichment.ranked(enrichment.with_sets(lists, chosen, "scenario", "category"), "scenario", "category")
    found = enrichment.permuted_enrichment(listed, gene_sets(spark, sf), "scenario", "category")
    summary = expression.summary(table, "scenario", "category").select("scenario", "category", "genes_tested", F.col("n_padj_005").alias("n_genes_padj005"))
    many = groups.groupBy("scenario").agg(F.countDistinct("sample").alias("n_samples"))
    return summary.join(F.broadcast(many), "scenario").join(enrichment.tracked(found, TRACKED, "scenario", "category"), ["scenario", "category"], "left")


def leave_one_out_gsea(spark, sf):
    """Enrichment with all samples and without each of the larger group, per category."""
    groups = left_out(spark, sf)
    return rounded(scenario_enrichment(spark, sf, expression.wald(bulk(spark, sf), groups, LEAST, IN_SAMPLES), groups))


def split_gsea(spark, sf):
    """Enrichment in all ways to choose two of the five samples, per category, with each value's rank among the splits."""
    groups = split_groups(spark)
    found = checkpoint(scenario_enrichment(spark, sf, expression.wald(bulk(spark, sf), groups, LEAST, IN_SAMPLES), groups))
    ranks = scenarios.observed_rank(found.withColumn("is_true", F.col("scenario") == "0"), "n_sets_padj005", "category").select("category", "reached", "splits", "p")
    return rounded(found.join(F.broadcast(ranks), "category"))


def threshold_gsea(spark, sf):
    """Enrichment of the true design at each confidence threshold, with the least counted places (rows) and depth of a sample."""
    groups = split_groups(spark).where("scenario = '0'")
    cells = confident(spark, sf).withColumn("category", F.col("threshold").cast("string"))
    rows = tables.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") % 5).alias("sample"), F.round("l_discount", 2).alias("confidence"))
    places = rows.crossJoin(F.broadcast(spark.createDataFrame([(float(t),) for t in THRESHOLDS], "threshold double"))).where("confidence >= threshold")  # five thresholds
    least = places.groupBy("threshold", "sample").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("threshold").cast("string").alias("category")).agg(F.min("n").alias("min_beads"))
    depth = counts.totals(cells).groupBy("category").agg(F.min("total").alias("min_depth"))
    found = scenario_enrichment(spark, sf, expression.wald(cells, groups, LEAST, IN_SAMPLES), groups).drop("scenario", "n_samples")
    return rounded(least.join(depth, "category").join(found, "category", "left").withColumnRenamed("category", "threshold"))


def threshold_split_de(spark, sf):
    """Per confidence threshold: genes significant in the true design and its rank among all splits (50 fits in one plan)."""
    cells = confident(spark, sf).withColumn("category", F.col("threshold").cast("string"))
    found = expression.summary(expression.wald(cells, split_groups(spark), LEAST, IN_SAMPLES), "scenario", "category")
    return rounded(scenarios.observed_rank(found.withColumn("is_true", F.col("scenario") == "0"), "n_padj_005", "category"))


def top_significant(spark, sf):
    """The eight most significant genes of all categories; eight is what the report shows."""
    return rounded(de_table(spark, sf).where("padj < 0.9").orderBy("padj", "pvalue", "category", "gene").limit(8).select("category", "gene", "padj"))


def bead_positions(spark, sf):
    beads = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return rounded(spatial.positioned(beads, tables.points(spark, sf)), 6)


QUERIES = {
    "bead_level_test": bead_level_test,
    "pseudobulk_variables": lambda s, d: counts.pseudobulk_by(raw(s, d), ["flag", "status"]),
    "de_status": de_status,
    "leave_one_out_de": leave_one_out_de,
    "threshold_split_de": threshold_split_de,
    "leave_one_out_gsea": leave_one_out_gsea,
    "split_gsea": split_gsea,
    "threshold_gsea": threshold_gsea,
    "nb_wald": nb_wald,
    "nb_leave_one_out": nb_leave_one_out,
    "leading_edge": lambda s, d: enrichment.leading_edge(ranked(s, d), tables.gene_sets(s, d)),
    "top_significant": top_significant,
    "value_counts": lambda s, d: checks.value_counts(tables.read(s, d, "part").where(F.col("p_name").contains("ring")), "p_type"),
    "genes_in_all": lambda s, d: checks.in_all(bulk(s, d).where("n > 0").withColumn("cell", F.concat_ws(":", "category", F.col("sample").cast("string"))), "gene", "cell"),
    "genes_uncounted": lambda s, d: checks.only_in(genes(s, d), bulk(s, d).where("n > 100"), "gene"),
    "bead_positions": bead_positions,
}


def _wald(source: str, groups: str) -> str:
    return f"""{source}, grp AS ({groups}),
own AS (SELECT scenario, grp, bulk.* FROM bulk JOIN grp USING (sample)), sizes AS (SELECT scenario, count(*) AS samples FROM grp GROUP BY scenario),
kept AS (SELECT scenario, category, gene FROM own GROUP BY ALL HAVING count(*) FILTER (WHERE n >= {LEAST}) >= {IN_SAMPLES}),
lg AS (SELECT b.scenario, b.category, b.sample, b.gene, ln(b.n::DOUBLE) AS lg, count(*) OVER g AS seen, avg(ln(b.n::DOUBLE)) OVER g AS centre FROM own b JOIN kept k ON k.scenario = b.scenario AND k.category = b.category AND k.gene = b.gene WHERE b.n > 0 WINDOW g AS (PARTITION BY b.scenario, b.category, b.gene)),
fac AS (SELECT scenario, category, sample, exp(quantile_cont(lg - centre, 0.5)) AS f FROM lg JOIN sizes USING (scenario) WHERE seen = samples GROUP BY ALL),
wcells AS (SELECT k.scenario, k.category, k.gene, f.sample, coalesce(b.n, 0) / f.f AS q, f.f AS f FROM kept k JOIN fac f ON f.scenario = k.scenario AND f.category = k.category LEFT JOIN own b ON b.scenario = k.scenario AND b.category = k.category AND b.gene = k.gene AND b.sample = f.sample),
wt AS (SELECT scenario, category, gene, avg(q) AS bm, avg(1 / f) AS inv, avg(q) FILTER (WHERE grp = 0) AS m0, avg(q) FILTER (WHERE grp = 1) AS m1, var_samp(q) FILTER (WHERE grp = 0) AS v0, var_samp(q) FILTER (WHERE grp = 1) AS v1,
  count(*) FILTER (WHERE grp = 0) AS c0, count(*) FILTER (WHERE grp = 1) AS c1 FROM wcells JOIN grp USING (scenario, sample) GROUP BY scenario, category, gene),
wd AS (SELECT *, 1 / bm AS x, greatest(((coalesce(v0, 0) * (c0 - 1) + coalesce(v1, 0) * (c1 - 1)) / greatest(c0 + c1 - 2, 1) - inv * bm) / (bm * bm), 1e-8::DOUBLE) AS own FROM wt WHERE bm > 0 AND c0 > 0 AND c1 > 0),
we AS (SELECT *, greatest(avg(own) OVER c + coalesce(covar_pop(own, x) OVER c / nullif(var_pop(x) OVER c, 0), 0) * (x - avg(x) OVER c), 1e-8::DOUBLE) AS trend FROM wd WINDOW c AS (PARTITION BY scenario, category)),
wf AS (SELECT *, exp(0.5::DOUBLE * ln(trend) + 0.5::DOUBLE * ln(own)) AS disp, greatest(m0, 0.5::DOUBLE * inv) AS a0, greatest(m1, 0.5::DOUBLE * inv) AS a1 FROM we),
wg AS (SELECT *, log2(a1 / a0) AS lfc, sqrt((inv / a0 + disp) / c0 + (inv / a1 + disp) / c1) / ln(2) AS se FROM wf),
wh AS (SELECT *, lfc / se AS stat, abs(lfc / se) AS z, 1 / (1 + 0.2316419::DOUBLE * abs(lfc / se)) AS t FROM wg),
wp AS (SELECT *, least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))) AS p FROM wh),
wq AS (SELECT *, row_number() OVER (PARTITION BY scenario, category ORDER BY p) AS rk, count(*) OVER (PARTITION BY scenario, category) AS m FROM wp),
wald AS (SELECT *, least(min(p * m / rk) OVER (PARTITION BY scenario, category ORDER BY p DESC, p * m / rk ROWS UNBOUNDED PRECEDING), 1) AS padj FROM wq)"""


_SHAM = "SELECT s AS scenario, unnest(range(0, 5)) AS sample, unnest(CASE s WHEN 'design' THEN [1, 1, 0, 0, 0] ELSE [1, 0, 1, 0, 0] END) AS grp FROM (VALUES ('design'), ('sham')) v(s)"
_SPLIT_GROUPS = "SELECT split::VARCHAR AS scenario, item AS sample, small::INT AS grp FROM splits"
_LOO = "SELECT scenario, sample, (sample < 2)::INT AS grp FROM (SELECT unnest(range(0, 5)) AS sample) i JOIN (SELECT 'all' AS scenario, -1 AS gone UNION ALL SELECT 'without_' || x, x FROM (SELECT unnest(range(2, 5)) AS x)) s ON sample <> gone"
_FOUND = "found AS (SELECT scenario, category, count(*) AS genes_tested, count(*) FILTER (WHERE padj < 0.05) AS value, min(padj) AS min_padj, count(*) FILTER (WHERE abs(lfc) > 1) AS n_lfc_gt1 FROM wald GROUP BY scenario, category)"
_RANK = f"""{_FOUND}, seen AS (SELECT *, max(value) FILTER (WHERE scenario = '0') OVER (PARTITION BY category) AS obs FROM found)
SELECT category, max(obs) AS observed, count(*) FILTER (WHERE value >= obs) AS reached, count(*) AS splits, {r('count(*) FILTER (WHERE value >= obs)::DOUBLE / count(*)', 'p')} FROM seen GROUP BY category"""
_THRESHOLD_BULK = f"""th AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), bulk AS (SELECT threshold::VARCHAR AS category, l_suppkey % 5 AS sample, l_partkey AS gene, sum(l_quantity)::BIGINT AS n
  FROM lineitem JOIN th ON round(l_discount, 2) >= threshold WHERE l_returnflag = 'R' GROUP BY ALL)"""
_BEADS = f"""{COUNTS}, b AS (SELECT DISTINCT category, sample, bead FROM counts), bb AS (SELECT category, sample, bead, (sample < 2)::INT AS grp FROM b JOIN (SELECT category, sample FROM b GROUP BY ALL HAVING count(*) >= {MIN_BEADS}) USING (category, sample)),
size AS (SELECT category, count(*) FILTER (WHERE grp = 1)::DOUBLE AS n1, count(*) FILTER (WHERE grp = 0)::DOUBLE AS n0 FROM bb GROUP BY category),
c AS (SELECT category, gene, grp, n FROM counts JOIN bb USING (category, sample, bead) WHERE n > 0),
k AS (SELECT category, gene, count(*) AS k, count(*) FILTER (WHERE grp = 1) AS k1 FROM c GROUP BY ALL),
v AS (SELECT category, gene, n, count(*)::DOUBLE AS c, count(*) FILTER (WHERE grp = 1)::DOUBLE AS c1 FROM c GROUP BY ALL UNION ALL SELECT category, gene, 0, n1 + n0 - k, n1 - k1 FROM k JOIN size USING (category)),
rk AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY category, gene ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rk FROM v),
g AS (SELECT category, gene, sum(c1 * rk) AS r1, sum(c * c * c - c) AS ties, sum(n * c1) AS s1, sum(n * (c - c1)) AS s0, sum(c1) FILTER (WHERE n > 0) AS k1, sum(c - c1) FILTER (WHERE n > 0) AS k0 FROM rk GROUP BY ALL),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n0 AS n FROM g JOIN size USING (category)),
z AS (SELECT *, greatest((abs(u - n1 * n0 / 2) - 0.5::DOUBLE) / nullif(sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 0), 0) AS z FROM u),
p AS (SELECT *, least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))) AS p FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z))"""
_EDGE = f"""{_RANKED}, sets AS (SELECT p_brand AS set_id, p_partkey AS gene FROM part), hits AS (SELECT set_id, sum(abs(stat)) AS weight, count(*) AS hits FROM sets JOIN ranked USING (gene) GROUP BY set_id),
walk AS (SELECT h.set_id, k.rank, k.gene, s.gene IS NOT NULL AS hit, sum(CASE WHEN s.gene IS NOT NULL THEN abs(k.stat) / h.weight ELSE -1.0::DOUBLE / ((SELECT count(*) FROM ranked) - h.hits) END) OVER (PARTITION BY h.set_id ORDER BY k.rank) AS running
  FROM ranked k CROSS JOIN hits h LEFT JOIN sets s ON s.set_id = h.set_id AND s.gene = k.gene),
ends AS (SELECT set_id, max(running) AS high, least(min(running), 0) AS low, arg_max(rank, running) AS peak, arg_min(rank, running) AS valley FROM walk GROUP BY set_id)"""
_SIGNIF = "round_even(min_padj * power(10::DOUBLE, 2 - floor(log10(min_padj))), 0) / power(10::DOUBLE, 2 - floor(log10(min_padj)))"

ORACLES = {
    "bead_level_test": f"WITH {_BEADS} SELECT category, gene, {r('u', 'u')}, {r('p', 'p')}, {r('least(p * count(*) OVER (PARTITION BY category), 1)', 'p_adjusted')}, {r('log2((s1 / n1 + 1) / (s0 / n0 + 1))', 'log2_fc')}, {r('k1 / n1', 'pct_1')}, {r('k0 / n0', 'pct_2')} FROM p",
    "pseudobulk_variables": "SELECT variable, category, sample, gene, sum(n)::BIGINT AS n FROM (SELECT 'flag' AS variable, l_returnflag AS category, l_suppkey % 5 AS sample, l_partkey AS gene, l_quantity AS n FROM lineitem UNION ALL SELECT 'status', l_linestatus, l_suppkey % 5, l_partkey, l_quantity FROM lineitem) GROUP BY ALL",
    "de_status": f"WITH {_DE}, depth AS (SELECT category, CASE WHEN count(*) < 5 THEN 0 ELSE min(total) END AS min_depth FROM (SELECT category, sample, sum(n)::BIGINT AS total FROM bulk GROUP BY ALL) GROUP BY category), s AS (SELECT category, count(*) AS genes_tested, count(*) FILTER (WHERE padj < 0.05) AS n_padj_005, min(padj) AS min_padj, count(*) FILTER (WHERE abs(lfc) > 1) AS n_lfc_gt1 FROM de GROUP BY category), j AS (SELECT *, min_depth >= {MIN_TOTAL} AS ok FROM depth LEFT JOIN s USING (category)) SELECT category, CASE WHEN ok THEN 'analysed' ELSE 'skipped_low_depth' END AS status, min_depth, CASE WHEN ok THEN genes_tested END AS genes_tested, CASE WHEN ok THEN n_padj_005 END AS n_padj_005, {r(f'CASE WHEN ok THEN {_SIGNIF} END', 'min_padj', 9)}, CASE WHEN ok THEN n_lfc_gt1 END AS n_lfc_gt1 FROM j",
    "de_wald": f"WITH {_wald(BULK, _SHAM)} SELECT scenario, category, gene, {r('bm', chr(34) + 'baseMean' + chr(34), 6)}, {r('lfc', chr(34) + 'log2FoldChange' + chr(34), 6)}, {r('se', chr(34) + 'lfcSE' + chr(34), 6)}, {r('stat', 'stat', 6)}, {r('p', 'pvalue', 6)}, {r('padj', 'padj', 6)} FROM wald",
    "split_de": f"WITH {_SPLITS}, {_wald(BULK, _SPLIT_GROUPS)}, {_RANK}",
    "leave_one_out_de": f"WITH {_wald(BULK, _LOO)}, {_FOUND} SELECT scenario, category, genes_tested, value AS n_padj_005, {r('min_padj', 'min_padj')}, n_lfc_gt1 FROM found",
    "threshold_split_de": f"WITH {_SPLITS}, {_wald(_THRESHOLD_BULK, _SPLIT_GROUPS)}, {_RANK}",
    "leading_edge": f"WITH {_EDGE} SELECT w.set_id, w.gene, w.rank FROM walk w JOIN ends e USING (set_id) WHERE w.hit AND CASE WHEN e.high >= -e.low THEN w.rank <= e.peak ELSE w.rank > e.valley END",
    "top_significant": f"WITH {_DE} SELECT category, gene, {r('padj', 'padj')} FROM (SELECT * FROM de WHERE padj < 0.9 ORDER BY padj, p, category, gene LIMIT 8)",
    "value_counts": "SELECT p_type AS value, count(*) AS n FROM part WHERE p_name LIKE '%ring%' GROUP BY 1",
    "genes_in_all": f"WITH {BULK}, p AS (SELECT DISTINCT gene, category, sample FROM bulk WHERE n > 0) SELECT gene AS member FROM p GROUP BY gene HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT category, sample FROM p))",
    "genes_uncounted": f"WITH {BULK} SELECT p_partkey AS gene FROM part WHERE p_partkey NOT IN (SELECT gene FROM bulk WHERE n > 100)",
    "bead_positions": f"SELECT o_orderkey AS id, o_orderstatus, {r('embedding[1]::DOUBLE', 'x', 6)}, {r('embedding[2]::DOUBLE', 'y', 6)} FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey",
}
