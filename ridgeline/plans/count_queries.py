"""Queries over sparse counts, annotations, expression and enrichment."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import annotate, counts, enrichment, expression, scenarios
from ..sources import tables
from .common import BULK, COUNTS, r, rounded

SAMPLES = [0, 1, 2, 3, 4]
#: Gene filter, depth filter and confidence thresholds for the driver's tables.
LEAST, IN_SAMPLES, DEPTH_SHARE = 40, 2, 0.97
THRESHOLDS = [0.0, 0.02, 0.04, 0.06, 0.08]
KEY_SQL = "l_suppkey % 5"


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    return counts.pseudobulk(tables.places(spark, sf))


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("gene"))


def contrast(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, stat): mean count of the small group of samples less that of the others, by the standard error of both."""
    c = tables.counts(spark, sf).groupBy("sample", "bead", "gene").agg(F.sum("n").alias("n"))
    # whole sums are the same in any order, so equal genes get equal statistics
    sums = []
    for k, own in ((1, F.col("sample") < 2), (0, F.col("sample") >= 2)):
        n = F.when(own, F.col("n"))
        sums += [F.sum(n).alias(f"s{k}"), F.sum(n * n).alias(f"q{k}"), F.count(n).alias(f"c{k}")]
    t = c.groupBy("gene").agg(*sums)
    mean = lambda k: F.try_divide(F.col(f"s{k}").cast("double"), F.col(f"c{k}").cast("double"))
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    squared = lambda k: F.try_divide((wide(f"c{k}") * wide(f"q{k}") - wide(f"s{k}") * wide(f"s{k}")).cast("double"), F.col(f"c{k}").cast("double") * F.col(f"c{k}") * (F.col(f"c{k}") - 1))  # noqa: E731  variance of the mean
    se = F.sqrt(squared(1) + squared(0))
    return t.select("gene", F.round(F.try_divide(mean(1) - mean(0), se), 6).alias("stat"))


_CONTRAST = f"""{COUNTS}, merged AS (SELECT sample, bead, gene, sum(n) AS n FROM counts GROUP BY ALL),
t AS (SELECT gene, avg(n) FILTER (WHERE sample < 2) AS m1, avg(n) FILTER (WHERE sample >= 2) AS m0, var_samp(n) FILTER (WHERE sample < 2) AS v1, var_samp(n) FILTER (WHERE sample >= 2) AS v0, count(*) FILTER (WHERE sample < 2) AS c1, count(*) FILTER (WHERE sample >= 2) AS c0 FROM merged GROUP BY gene),
contrast AS (SELECT gene, round((m1 - m0) / nullif(sqrt(v1 / nullif(c1, 0) + v0 / nullif(c0, 0)), 0), 6) AS stat FROM t)"""


def bead_qc(spark, sf):
    c = tables.counts(spark, sf)
    listed = c.select("sample", "gene").distinct()
    marked = tables.read(spark, sf, "part").where(F.col("p_name").rlike("^red")).select(F.col("p_partkey").alias("gene"))
    return rounded(counts.quality(c, marked, listed))


def zero_count_filter(spark, sf):
    beads = tables.read(spark, sf, "orders").select(F.explode(F.array(*[F.lit(s).cast("long") for s in SAMPLES])).alias("sample"), F.col("o_orderkey").alias("bead"))
    return counts.nonzero_beads(beads, tables.counts(spark, sf))


def recoded(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a category: a code by type, then ordered rules on the name."""
    codes = spark.createDataFrame([("ECONOMY", "low"), ("SMALL", "low"), ("PROMO", "offer")], "key string, value string")
    rules = annotate.by_rules("p_name", [("ring", "ring"), ("(bolt|gear)$", "drive"), ("^red", "red")])
    return annotate.recode(tables.read(spark, sf, "part"), "p_type", codes, "category", F.coalesce(rules, F.lit("Other")))


_RECODED = """SELECT p_partkey, p_type, p_size, p_retailprice, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type = 'PROMO' THEN 'offer' WHEN regexp_matches(p_name, 'ring') THEN 'ring' WHEN regexp_matches(p_name, '(bolt|gear)$') THEN 'drive' WHEN regexp_matches(p_name, '^red') THEN 'red' ELSE 'Other' END AS category FROM part"""


def id_split(spark, sf):
    ids = tables.read(spark, sf, "lineitem").select(F.concat_ws("_", F.concat(F.lit("J"), F.col("l_suppkey") % 5), "l_orderkey", "l_linenumber").alias("cell_id"))
    return annotate.split_id(ids, "cell_id").groupBy("sample").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("barcode").alias("barcodes"), F.min("barcode").alias("first_barcode"))


def median_by_group(spark, sf):
    return rounded(stats.medians(recoded(spark, sf), ["p_size", "p_retailprice"], "category").withColumnsRenamed({"median_p_size": "median_size", "median_p_retailprice": "median_price"}))


def bead_counts(spark, sf):
    beads = tables.counts(spark, sf).select("category", "sample", "bead").distinct()
    return counts.contingency(beads, "category", "sample", SAMPLES)


def sham(spark: SparkSession) -> DataFrame:
    rows = [("design", s, int(s in (0, 1))) for s in SAMPLES] + [("sham", s, int(s in (0, 2))) for s in SAMPLES]
    return spark.createDataFrame(rows, "scenario string, sample long, grp int")


def split_groups(spark: SparkSession) -> DataFrame:
    """All choices of two of the five samples; the first is the true design."""
    splits = scenarios.exact_splits(spark, SAMPLES, 2)
    return splits.select(F.col("split").cast("string").alias("scenario"), F.col("item").alias("sample"), F.col("small").cast("int").alias("grp"))


def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """(category, split, value, is_true): absolute difference of mean totals between the groups of each split."""
    totals = counts.totals(bulk(spark, sf))
    joined = totals.join(F.broadcast(scenarios.exact_splits(spark, SAMPLES, 2)), F.col("sample") == F.col("item"))
    value = F.abs(F.avg(F.when(F.col("small"), F.col("total"))) - F.avg(F.when(~F.col("small"), F.col("total"))))
    return joined.groupBy("category", "split").agg(F.round(value, 6).alias("value")).withColumn("is_true", F.col("split") == 0)


def permutation_pvalue(spark, sf):
    t = split_statistics(spark, sf).withColumn("observed", F.max(F.when(F.col("is_true"), F.col("value"))).over(Window.partitionBy("category")))
    return rounded(t.groupBy("category").agg(*[stats.permutation_p(F.col("value"), F.col("observed"), m).alias(m) for m in ("plus_one", "plain", "lower")]))


def leave_one_out(spark, sf):
    items = bulk(spark, sf).select(F.col("sample").alias("item")).distinct()
    plan = scenarios.leave_one_out(items, items.where("item >= 2"))
    return counts.totals(bulk(spark, sf)).join(F.broadcast(plan), F.col("sample") == F.col("item")).groupBy("scenario", "category").agg(F.sum("total").alias("total"), F.countDistinct("sample").alias("samples"))


def confident(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") % 5).alias("sample"), F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("long").alias("n"), F.col("l_discount").alias("confidence"))
    return counts.threshold_sums(rows, "confidence", THRESHOLDS)


def threshold_sweep(spark, sf):
    return confident(spark, sf).groupBy("threshold", "sample").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("genes"))


def threshold_rank_summary(spark, sf):
    totals = threshold_sweep(spark, sf).join(F.broadcast(scenarios.exact_splits(spark, SAMPLES, 2)), F.col("sample") == F.col("item"))
    value = F.abs(F.avg(F.when(F.col("small"), F.col("total"))) - F.avg(F.when(~F.col("small"), F.col("total"))))
    values = totals.groupBy("threshold", "split").agg(F.round(value, 6).alias("value")).withColumn("is_true", F.col("split") == 0)
    return rounded(scenarios.observed_rank(values, "value", "threshold"))


def grouped_beads(spark: SparkSession, sf: str) -> DataFrame:
    return tables.counts(spark, sf).select("sample", "bead").distinct().withColumn("grp", (F.col("sample") < 2).cast("int"))


def expression_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """(category, gene, value): counts per million added over samples, by their number, for the first brand's parts (the markers); absent counts are 0."""
    wanted = tables.read(spark, sf, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("gene"))
    cells = counts.cpm(bulk(spark, sf)).join(F.broadcast(wanted) if wanted.count() < 100_000 else wanted, "gene", "left_semi")
    return cells.groupBy("category", "gene").agg((F.sum("cpm") / len(SAMPLES)).alias("value"))


def expected_markers(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("gene"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("expected"))


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.map_genes(contrast(spark, sf), tables.gene_map(spark, sf))


def flagged(spark, sf):
    table = enrichment.ranked(contrast(spark, sf).where("stat IS NOT NULL"))
    return rounded(enrichment.flag_sets(table, tables.gene_sets(spark, sf), {"in_first": "Brand#1", "in_second": "Brand#2"}), 6)


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.ranked(contrast(spark, sf).where("stat IS NOT NULL"))


def gene_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of two grains, by brand and by type, so that some have 15 to 500 genes at any size of the tables."""
    types = tables.read(spark, sf, "part").select(F.col("p_type").alias("set_id"), F.col("p_partkey").alias("gene"))
    return tables.gene_sets(spark, sf).unionByName(types)


def with_q(found: DataFrame) -> DataFrame:
    """Enrichment with q values; the error of a p value depends on how it was found and is left out."""
    return stats.q_values(found, "pvalue", "qvalue").drop("log2err")


def running_es(spark, sf):
    few = tables.gene_sets(spark, sf).where(F.col("set_id").isin("Brand#1", "Brand#2"))
    return rounded(enrichment.running_scores(ranked(spark, sf), few), 6)


def tracked_pathways(spark, sf):
    scores = enrichment.enrichment(ranked(spark, sf), tables.gene_sets(spark, sf))
    return rounded(scores.where(F.col("set_id").isin("Brand#1", "Brand#2") | (F.col("set_id").rlike("(?i)brand#1[0-9]$") & (F.abs("es") > 0.1))), 4)


def de_table(spark: SparkSession, sf: str) -> DataFrame:
    """Per category and gene a fold change and a p from the two groups' totals, for summaries."""
    g = tables.places(spark, sf).groupBy("category", "gene").agg(F.sum(F.when(F.col("sample") < 2, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("sample") >= 2, F.col("n")).otherwise(0)).alias("b"))
    z = (F.col("a") - 0.4 * (F.col("a") + F.col("b"))) / F.sqrt(0.24 * (F.col("a") + F.col("b")) * 25)
    g = g.withColumn("log2FoldChange", F.log2((F.col("a") + 0.5) / 2 / ((F.col("b") + 0.5) / 3))).withColumn("pvalue", F.least(F.lit(1.0), 2 * stats.normal_tail(F.abs(z))))
    return stats.bh_adjust(g, "pvalue", "padj", "category")


_DE = f"""{BULK}, g AS (SELECT category, gene, sum(CASE WHEN sample < 2 THEN n ELSE 0 END) AS a, sum(CASE WHEN sample >= 2 THEN n ELSE 0 END) AS b FROM bulk GROUP BY ALL),
z AS (SELECT *, log2((a + 0.5) / 2 / ((b + 0.5) / 3)) AS lfc, abs(a - 0.4 * (a + b)) / sqrt(0.24 * (a + b) * 25) AS z FROM g),
p AS (SELECT *, least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))))) AS p FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z)),
q AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p) AS rk, count(*) OVER (PARTITION BY category) AS m FROM p),
de AS (SELECT *, least(min(p * m / rk) OVER (PARTITION BY category ORDER BY p DESC, p * m / rk ROWS UNBOUNDED PRECEDING), 1) AS padj FROM q)"""


def enrichment_table(spark, sf):
    """Scores by category with the set's family and number taken from its name, ordered and with the columns there are."""
    scores = enrichment.enrichment(ranked(spark, sf), tables.gene_sets(spark, sf))
    named = scores.withColumn("source", F.regexp_extract("set_id", r"^([A-Za-z]+)#(\d+)$", 1)).withColumn("number", F.regexp_extract("set_id", r"^([A-Za-z]+)#(\d+)$", 2).cast("int"))
    wanted = ["source", "number", "set_id", "set_size", "es", "absent_column"]
    return rounded(named.select(*[c for c in wanted if c in named.columns]))


def significant_pivot(spark, sf):
    table = de_table(spark, sf).where("padj < 0.9").join(tables.read(spark, sf, "part").select(F.col("p_partkey").alias("gene"), "p_type"), "gene")
    wide = table.groupBy("p_type").pivot("category", ["A", "N", "R"]).count()
    return wide.select("p_type", *[F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}") for c in "ANR"])


def de_wald(spark, sf):
    return rounded(expression.wald(bulk(spark, sf), sham(spark), LEAST, IN_SAMPLES), 6)


def split_de(spark, sf):
    """Genes significant in each exact split, and the rank of the true design among them."""
    found = expression.summary(expression.wald(bulk(spark, sf), split_groups(spark), LEAST, IN_SAMPLES), "scenario", "category")
    return rounded(scenarios.observed_rank(found.withColumn("is_true", F.col("scenario") == "0"), "n_padj_005", "category"))


def whole_counts(spark, sf):
    """Half the summed counts, as whole numbers: half of all odd sums are ties between two."""
    halves = bulk(spark, sf).withColumn("n", F.col("n") / F.lit(2.0))
    return counts.whole(halves).select("category", "sample", "gene", "n")


def merged_beads(spark, sf):
    """Beads of the five samples, each under its sample's name."""
    table = tables.counts(spark, sf)
    beads = table.groupBy("sample", "bead").agg(F.sum("n").alias("umi"))
    return annotate.merged({f"J{s}": beads.where(F.col("sample") == s).select("bead", "umi") for s in SAMPLES}, "bead")


QUERIES = {
    "whole_counts": whole_counts,
    "merged_beads": merged_beads,
    "bead_qc": bead_qc,
    "zero_count_filter": zero_count_filter,
    "recode_category": lambda s, d: recoded(s, d).select("p_partkey", "p_type", "category"),
    "id_split": id_split,
    "contingency": lambda s, d: counts.contingency(recoded(s, d).withColumn("sample", F.col("p_size") % 5), "category", "sample", SAMPLES),
    "median_by_group": median_by_group,
    "pseudobulk_long": bulk,
    "pseudobulk_pivot": lambda s, d: counts.pseudobulk_pivot(bulk(s, d), genes(s, d), SAMPLES),
    "pseudobulk_totals": lambda s, d: counts.totals(bulk(s, d)),
    "bead_counts_pivot": bead_counts,
    "gene_filter": lambda s, d: counts.gene_filter(bulk(s, d), LEAST, IN_SAMPLES),
    "depth_status": lambda s, d: rounded(counts.depth_status(bulk(s, d), DEPTH_SHARE, len(SAMPLES))),
    "size_factors": lambda s, d: rounded(counts.size_factors(bulk(s, d), len(SAMPLES)), 6),
    "de_summary": lambda s, d: rounded(expression.summary(de_table(s, d), "category")),
    "de_wald": de_wald,
    "split_de": split_de,
    "id_map_dedup": lambda s, d: rounded(mapped(s, d).select("gene", "entrez", "stat"), 6),
    "ranked_list_flags": flagged,
    "running_es": running_es,
    "enrichment_scores": lambda s, d: rounded(enrichment.enrichment(ranked(s, d), tables.gene_sets(s, d))),
    "gsea_nes": lambda s, d: rounded(with_q(enrichment.permuted_enrichment(ranked(s, d), gene_sets(s, d)))),
    "tracked_pathways": tracked_pathways,
    "wilcoxon_sparse": lambda s, d: counts.wilcoxon_sparse(tables.counts(s, d), grouped_beads(s, d)),
    "sham_split": lambda s, d: rounded(counts.totals(bulk(s, d)).join(F.broadcast(sham(s)), "sample").groupBy("scenario", "category", "grp").agg(F.avg("total").alias("mean_total"), F.count(F.lit(1)).alias("samples"))),
    "marker_zscore": lambda s, d: rounded(annotate.marker_zscore(expression_by_category(s, d))),
    "marker_validation": lambda s, d: rounded(annotate.marker_validation(annotate.marker_zscore(expression_by_category(s, d)), expected_markers(s, d))),
    "enrichment_table": enrichment_table,
    "significant_pivot": significant_pivot,
    "exact_splits": lambda s, d: split_statistics(s, d).drop("is_true"),
    "split_rank": lambda s, d: rounded(scenarios.observed_rank(split_statistics(s, d), "value", "category")),
    "permutation_pvalue": permutation_pvalue,
    "leave_one_out": leave_one_out,
    "threshold_sweep": threshold_sweep,
    "threshold_rank_summary": threshold_rank_summary,
}

_SPLITS = "splits AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {s}, {str(s in c).lower()})" for i, c in enumerate(combinations(SAMPLES, 2)) for s in SAMPLES) + ") AS s(split, item, small))"
_TOTALS = f"{BULK}, totals AS (SELECT category, sample, sum(n)::BIGINT AS total, count(*) FILTER (WHERE n > 0) AS detected FROM bulk GROUP BY ALL)"
_VALUES = f"{_TOTALS}, {_SPLITS}, vals AS (SELECT category, split, round(abs(avg(total) FILTER (WHERE small) - avg(total) FILTER (WHERE NOT small)), 6) AS value FROM totals JOIN splits ON sample = item GROUP BY ALL)"
_OBSERVED = "o AS (SELECT *, max(value) FILTER (WHERE split = 0) OVER (PARTITION BY {k}) AS obs FROM vals)"
_SWEEP = "th AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08])::DOUBLE AS threshold), cells AS (SELECT threshold, l_suppkey % 5 AS sample, l_partkey AS gene, sum(CASE WHEN round(l_discount, 2) >= threshold THEN l_quantity ELSE 0 END)::BIGINT AS n FROM lineitem CROSS JOIN th WHERE l_returnflag = 'R' GROUP BY ALL), sweep AS (SELECT threshold, sample, sum(n)::BIGINT AS total, count(*) AS genes FROM cells WHERE n > 0 GROUP BY ALL)"
_RANKED = f"{_CONTRAST}, ranked AS (SELECT gene, stat, row_number() OVER (ORDER BY stat DESC, gene) AS rank FROM contrast WHERE stat IS NOT NULL)"
_WALK = f"""{_RANKED}, sets AS (SELECT p_brand AS set_id, p_partkey AS gene FROM part), hits AS (SELECT set_id, sum(abs(stat)) AS weight, count(*) AS hits FROM sets JOIN ranked USING (gene) GROUP BY set_id),
walk AS (SELECT h.set_id, k.rank, k.gene, s.gene IS NOT NULL AS hit, sum(CASE WHEN s.gene IS NOT NULL THEN abs(k.stat) / h.weight ELSE -1.0::DOUBLE / ((SELECT count(*) FROM ranked) - h.hits) END) OVER (PARTITION BY h.set_id ORDER BY k.rank) AS running
  FROM ranked k CROSS JOIN hits h LEFT JOIN sets s ON s.set_id = h.set_id AND s.gene = k.gene),
scores AS (SELECT w.set_id, any_value(h.hits) AS set_size, CASE WHEN max(running) >= -least(min(running), 0) THEN max(running) ELSE min(running) END AS es FROM walk w JOIN hits h USING (set_id) GROUP BY w.set_id)"""
_CPM = f"{BULK}, expr AS (SELECT category, gene, sum(cpm) / 5 AS value FROM (SELECT category, gene, 1e6::DOUBLE * n / sum(n) OVER (PARTITION BY category, sample) AS cpm FROM bulk) WHERE gene IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') GROUP BY ALL), scored AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM expr WINDOW w AS (PARTITION BY gene))"

ORACLES = {
    "whole_counts": f"WITH {BULK} SELECT category, sample, gene, round_even(n / 2.0, 0)::BIGINT AS n FROM bulk",
    "merged_beads": f"WITH {COUNTS} SELECT 'J' || sample AS sample, 'J' || sample || '_' || bead AS bead, sum(n)::BIGINT AS umi FROM counts GROUP BY 1, 2",
    "bead_qc": f"WITH {COUNTS}, b AS (SELECT sample, bead, sum(n) AS umi, count(DISTINCT gene) FILTER (WHERE n > 0) AS genes, coalesce(sum(n) FILTER (WHERE gene IN (SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^red'))), 0) AS mt FROM counts GROUP BY ALL HAVING sum(n) > 0) SELECT sample, count(*) AS beads_retained, {r('quantile_cont(umi::DOUBLE, 0.5)', 'median_umi')}, {r('quantile_cont(genes::DOUBLE, 0.5)', 'median_genes')}, {r('quantile_cont(100.0::DOUBLE * mt / umi, 0.5)', 'median_percent_mt')}, {r('avg(100.0::DOUBLE * mt / umi)', 'mean_percent_mt')}, sum(umi)::BIGINT AS total_umi, (SELECT count(DISTINCT gene) FROM counts c WHERE c.sample = b.sample) AS genes_detected FROM b GROUP BY sample",
    "zero_count_filter": f"WITH {COUNTS} SELECT s.sample::BIGINT AS sample, o_orderkey AS bead FROM orders CROSS JOIN (SELECT unnest(range(0, 5)) AS sample) s WHERE EXISTS (SELECT 1 FROM counts c WHERE c.sample = s.sample AND c.bead = o_orderkey AND c.n > 0)",
    "recode_category": f"SELECT p_partkey, p_type, category FROM ({_RECODED})",
    "id_split": "SELECT 'J' || (l_suppkey % 5) AS sample, count(*) AS cells, count(DISTINCT l_orderkey || '_' || l_linenumber) AS barcodes, min(l_orderkey || '_' || l_linenumber) AS first_barcode FROM lineitem GROUP BY 1",
    "contingency": f"SELECT category, {', '.join(f'count(*) FILTER (WHERE p_size % 5 = {s}) AS s{s}' for s in SAMPLES)} FROM ({_RECODED}) GROUP BY category",
    "median_by_group": f"SELECT category, {r('quantile_cont(p_size::DOUBLE, 0.5)', 'median_size')}, {r('quantile_cont(p_retailprice, 0.5)', 'median_price')}, count(*) AS n FROM ({_RECODED}) GROUP BY category",
    "pseudobulk_long": f"WITH {BULK} SELECT * FROM bulk",
    "pseudobulk_pivot": f"WITH {BULK} SELECT c.category, p.p_partkey AS gene, {', '.join(f'coalesce(sum(n) FILTER (WHERE sample = {s}), 0)::BIGINT AS s{s}' for s in SAMPLES)} FROM (SELECT DISTINCT category FROM bulk) c CROSS JOIN part p LEFT JOIN bulk b ON b.category = c.category AND b.gene = p.p_partkey GROUP BY ALL",
    "pseudobulk_totals": f"WITH {_TOTALS} SELECT * FROM totals",
    "bead_counts_pivot": f"SELECT l_returnflag AS category, {', '.join(f'count(DISTINCT CASE WHEN {KEY_SQL} = {s} THEN l_orderkey END) AS s{s}' for s in SAMPLES)} FROM lineitem GROUP BY 1",
    "gene_filter": f"WITH {BULK} SELECT category, gene FROM bulk GROUP BY ALL HAVING count(*) FILTER (WHERE n >= {LEAST}) >= {IN_SAMPLES}",
    "depth_status": f"WITH {_TOTALS}, d AS (SELECT category, CASE WHEN count(*) < 5 THEN 0 ELSE min(total) END AS min_depth, sum(total) / 5.0::DOUBLE AS mean_depth FROM totals GROUP BY category) SELECT category, min_depth, {r('mean_depth', 'mean_depth')}, CASE WHEN min_depth < {DEPTH_SHARE}::DOUBLE * mean_depth THEN 'skipped_low_depth' ELSE 'ok' END AS status FROM d",
    "size_factors": f"WITH {BULK}, l AS (SELECT *, ln(n::DOUBLE) AS lg, count(*) OVER g AS seen, avg(ln(n::DOUBLE)) OVER g AS centre FROM bulk WHERE n > 0 WINDOW g AS (PARTITION BY category, gene)) SELECT category, sample, {r('exp(quantile_cont(lg - centre, 0.5))', 'size_factor', 6)} FROM l WHERE seen = 5 GROUP BY ALL",
    "de_summary": f"WITH {_DE} SELECT category, count(*) AS genes_tested, count(*) FILTER (WHERE padj < 0.05) AS n_padj_005, {r('min(padj)', 'min_padj')}, count(*) FILTER (WHERE abs(lfc) > 1) AS n_lfc_gt1 FROM de GROUP BY category",
    "id_map_dedup": f"WITH {_CONTRAST}, m AS (SELECT p_partkey AS gene, p_partkey % (SELECT greatest(1, count(*) * 9 // 10) FROM part) AS entrez FROM part), j AS (SELECT c.gene, m.entrez, c.stat, row_number() OVER (PARTITION BY entrez ORDER BY c.gene) AS n FROM contrast c JOIN m USING (gene) WHERE stat IS NOT NULL) SELECT gene, entrez, {r('stat', 'stat', 6)} FROM j WHERE n = 1",
    "ranked_list_flags": f"WITH {_RANKED} SELECT gene, {r('stat', 'stat', 6)}, rank, gene IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') AS in_first, gene IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') AS in_second FROM ranked",
    "running_es": f"WITH {_WALK} SELECT set_id, rank, gene, hit, {r('running', 'running', 6)} FROM walk WHERE set_id IN ('Brand#1', 'Brand#2')",
    "enrichment_scores": f"WITH {_WALK} SELECT set_id, set_size, {r('es', 'es')} FROM scores",
    "tracked_pathways": f"WITH {_WALK} SELECT set_id, set_size, {r('es', 'es')} FROM scores WHERE set_id IN ('Brand#1', 'Brand#2') OR (regexp_matches(set_id, '(?i)brand#1[0-9]$') AND abs(es) > 0.1)",
    "wilcoxon_sparse": f"WITH {COUNTS}, b AS (SELECT DISTINCT sample, bead, (sample < 2)::INT AS grp FROM counts), gs AS (SELECT DISTINCT gene FROM counts), c AS (SELECT sample, bead, gene, sum(n) AS n FROM counts GROUP BY ALL), z AS (SELECT (SELECT count(*) FROM b) AS total, (SELECT sum(grp) FROM b) AS n1), rk AS (SELECT c.gene, b.grp, rank() OVER (PARTITION BY gene ORDER BY n) + (count(*) OVER (PARTITION BY gene, n) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY gene) AS seen FROM c JOIN b USING (sample, bead)), s AS (SELECT gene, any_value(seen) AS seen, sum(CASE WHEN grp = 1 THEN rk + total - seen ELSE 0 END) AS own, sum(grp) AS seen1 FROM rk CROSS JOIN z GROUP BY gene) SELECT gene, seen, own + (n1 - seen1) * (total - seen + 1) / 2.0::DOUBLE AS rank_sum, own + (n1 - seen1) * (total - seen + 1) / 2.0::DOUBLE - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s CROSS JOIN z",
    "sham_split": f"WITH {_TOTALS}, g AS (SELECT 'design' AS scenario, unnest(range(0, 5)) AS sample UNION ALL SELECT 'sham', unnest(range(0, 5))), h AS (SELECT *, (sample = 0 OR sample = CASE scenario WHEN 'design' THEN 1 ELSE 2 END)::INT AS grp FROM g) SELECT scenario, category, grp, {r('avg(total)', 'mean_total')}, count(*) AS samples FROM totals JOIN h USING (sample) GROUP BY ALL",
    "marker_zscore": f"WITH {_CPM} SELECT category, gene, {r('value', 'value')}, {r('z', 'z')} FROM scored",
    "marker_validation": f"WITH {_CPM}, top AS (SELECT gene, max(z) AS z_top FROM scored GROUP BY gene), best AS (SELECT t.gene, t.z_top, min(category) AS highest_in FROM top t JOIN scored s ON s.gene = t.gene AND s.z = t.z_top GROUP BY ALL), e AS (SELECT p_partkey AS gene, ['A', 'N', 'R'][p_partkey % 3 + 1] AS expected FROM part WHERE p_brand = 'Brand#1') SELECT e.gene, e.expected, highest_in, {r('z_top', 'z_top')}, {r('s.z', 'z_expected')}, CASE WHEN e.expected = highest_in THEN 'yes' ELSE 'no' END AS match FROM e JOIN best USING (gene) LEFT JOIN scored s ON s.gene = e.gene AND s.category = e.expected",
    "enrichment_table": f"WITH {_WALK} SELECT regexp_extract(set_id, '^([A-Za-z]+)#', 1) AS source, regexp_extract(set_id, '#([0-9]+)$', 1)::INT AS number, set_id, set_size, {r('es', 'es')} FROM scores",
    "significant_pivot": f"WITH {_DE} SELECT p_type, {', '.join(f'''count(*) FILTER (WHERE category = '{c}') AS n_{c}''' for c in 'ANR')} FROM de JOIN part ON gene = p_partkey WHERE padj < 0.9 GROUP BY p_type",
    "exact_splits": f"WITH {_VALUES} SELECT category, split, value FROM vals",
    "split_rank": f"WITH {_VALUES}, {_OBSERVED.format(k='category')} SELECT category, {r('max(obs)', 'observed')}, count(*) FILTER (WHERE value >= obs) AS reached, count(*) AS splits, {r('count(*) FILTER (WHERE value >= obs)::DOUBLE / count(*)', 'p')} FROM o GROUP BY category",
    "permutation_pvalue": f"WITH {_VALUES}, {_OBSERVED.format(k='category')} SELECT category, {r('(count(*) FILTER (WHERE value >= obs) + 1)::DOUBLE / (count(*) + 1)', 'plus_one')}, {r('count(*) FILTER (WHERE value >= obs)::DOUBLE / count(*)', 'plain')}, {r('count(*) FILTER (WHERE value <= obs)::DOUBLE / count(*)', 'lower')} FROM o GROUP BY category",
    "leave_one_out": f"WITH {_TOTALS}, s AS (SELECT 'all' AS scenario, -1 AS gone UNION ALL SELECT 'without_' || x, x FROM (SELECT unnest(range(2, 5)) AS x)) SELECT scenario, category, sum(total)::BIGINT AS total, count(DISTINCT sample) AS samples FROM totals CROSS JOIN s WHERE sample <> gone GROUP BY ALL",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "threshold_rank_summary": f"WITH {_SWEEP}, {_SPLITS}, vals AS (SELECT threshold, split, round(abs(avg(total) FILTER (WHERE small) - avg(total) FILTER (WHERE NOT small)), 6) AS value FROM sweep JOIN splits ON sample = item GROUP BY ALL), {_OBSERVED.format(k='threshold')} SELECT threshold, {r('max(obs)', 'observed')}, count(*) FILTER (WHERE value >= obs) AS reached, count(*) AS splits, {r('count(*) FILTER (WHERE value >= obs)::DOUBLE / count(*)', 'p')} FROM o GROUP BY threshold",
}
