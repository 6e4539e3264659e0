"""Sparse counts in coordinate form (sample, bead, gene, category, n): quality, sums, filters.

A missing coordinate is a zero, in sums, medians, ranks and filters alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bonferroni, medians, normal_tail
from .shuffles import checkpoint

BEAD = ("sample", "bead")


def bead_totals(counts: DataFrame) -> DataFrame:
    """Per bead: umi, genes detected."""
    per_gene = counts.groupBy(*BEAD, "gene").agg(F.sum("n").alias("n"))
    return per_gene.groupBy(*BEAD).agg(F.sum("n").alias("umi"), F.count_if(F.col("n") > 0).alias("genes"))


def nonzero_beads(beads: DataFrame, counts: DataFrame) -> DataFrame:
    """``beads`` (sample, bead) with any count."""
    return beads.join(bead_totals(counts).where("umi > 0").select(*BEAD), list(BEAD), "left_semi")


def quality(counts: DataFrame, marked: DataFrame, genes_listed: DataFrame) -> DataFrame:
    """Per sample: beads, exact medians of umi and genes, share of ``marked`` genes, total, listed genes.

    ``genes_detected`` is the number of genes in the sample's list, whether counted or not.
    """
    flagged = counts.join(marked.select("gene", F.lit(True).alias("marked")), "gene", "left")
    beads = flagged.groupBy(*BEAD).agg(F.sum("n").alias("umi"), F.countDistinct(F.when(F.col("n") > 0, F.col("gene"))).alias("genes"), F.coalesce(F.sum(F.when(F.col("marked"), F.col("n"))), F.lit(0)).alias("mt"))
    beads = beads.where("umi > 0").withColumn("pct", 100.0 * F.col("mt") / F.col("umi"))
    beads = checkpoint(beads)
    table = beads.groupBy("sample").agg(F.avg("pct").alias("mean_percent_mt"), F.sum("umi").alias("total_umi"))
    middle = medians(beads, ["umi", "genes", "pct"], "sample").withColumnsRenamed({"n": "beads_retained", "median_pct": "median_percent_mt"})
    table = middle.join(table, "sample")
    return table.join(genes_listed.groupBy("sample").agg(F.count(F.lit(1)).alias("genes_detected")), "sample", "left")


def pseudobulk(counts: DataFrame, variable: str = "category") -> DataFrame:
    """(category, sample, gene, n): counts summed over beads, the replicate being the sample."""
    return counts.groupBy(F.col(variable).alias("category"), "sample", "gene").agg(F.sum("n").alias("n"))


def pseudobulk_by(counts: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, category, sample, gene, n): counts summed over beads by each of several variables, in one pass."""
    sums = counts.groupingSets([[v, "sample", "gene"] for v in variables], *variables, "sample", "gene").agg(F.sum("n").alias("n"), *[F.grouping(v).alias(f"_{v}") for v in variables])
    which = F.coalesce(*[F.when(F.col(f"_{v}") == 0, F.lit(v)) for v in variables])
    value = F.coalesce(*[F.when(F.col(f"_{v}") == 0, F.col(v).cast("string")) for v in variables])
    return sums.select(which.alias("variable"), value.alias("category"), "sample", "gene", "n")


def pseudobulk_pivot(bulk: DataFrame, genes: DataFrame, samples: Sequence) -> DataFrame:
    """Genes of the union space by sample, zero where nothing was counted; categories are those of ``bulk``."""
    wide = bulk.groupBy("category", "gene").pivot("sample", list(samples)).sum("n")
    # every category has every gene, by definition; categories are the few
    grid = genes.select("gene").distinct().crossJoin(F.broadcast(bulk.select("category").distinct()))
    named = [F.coalesce(F.col(str(s)), F.lit(0)).alias(f"s{s}") for s in samples]
    return grid.join(wide, ["category", "gene"], "left").select("category", "gene", *named)


def whole(df: DataFrame, column: str = "n") -> DataFrame:
    """``df`` with ``column`` as a long, halves going to the even neighbour; null stays null."""
    return df.withColumn(column, F.bround(column).cast("long"))


def totals(bulk: DataFrame) -> DataFrame:
    """Per category and sample: total and detected genes."""
    return bulk.groupBy("category", "sample").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("detected"))


def contingency(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by ``column``; absent combinations are 0."""
    wide = df.groupBy(row).pivot(column, list(values)).count()
    return wide.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"s{v}") for v in values])


def gene_filter(bulk: DataFrame, least: int, samples: int, *keys: str) -> DataFrame:
    """(category, gene) with ``least`` counts in ``samples`` samples or more; by ``keys`` in place of the category, if any are given."""
    by = [*(keys or ("category",)), "gene"]
    return bulk.groupBy(*by).agg(F.count_if(F.col("n") >= least).alias("passing")).where(F.col("passing") >= samples).select(*by)


def depth_status(bulk: DataFrame, share: float, samples: int) -> DataFrame:
    """Per category: least and mean total of its samples (a missing sample has 0) and whether the least is enough."""
    table = totals(bulk).groupBy("category").agg(F.min("total").alias("least"), F.sum("total").alias("all"), F.count(F.lit(1)).alias("have"))
    table = table.withColumn("min_depth", F.when(F.col("have") < samples, F.lit(0)).otherwise(F.col("least"))).withColumn("mean_depth", F.col("all") / F.lit(float(samples)))
    return table.select("category", "min_depth", "mean_depth", F.when(F.col("min_depth") < share * F.col("mean_depth"), "skipped_low_depth").otherwise("ok").alias("status"))


def depth_minimum(bulk: DataFrame, least: int, samples: int) -> DataFrame:
    """(category, min_depth, status): ``skipped_low_depth`` where a sample's total is under ``least`` (a missing sample has 0), else ``analysed``."""
    table = totals(bulk).groupBy("category").agg(F.min("total").alias("lowest"), F.count(F.lit(1)).alias("have"))
    table = table.withColumn("min_depth", F.when(F.col("have") < samples, F.lit(0)).otherwise(F.col("lowest")))
    return table.select("category", "min_depth", F.when(F.col("min_depth") < least, "skipped_low_depth").otherwise("analysed").alias("status"))


def threshold_sums(counts: DataFrame, confidence: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, sample, gene, n): counts at or over each threshold, in one pass over the counts."""
    sums = [F.sum(F.when(F.round(confidence, 2) >= t, F.col("n")).otherwise(0)).alias(f"t{i}") for i, t in enumerate(thresholds)]
    wide = counts.groupBy("sample", "gene").agg(*sums)
    stacked = wide.select("sample", "gene", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("x"))
    return stacked.select("x.threshold", "sample", "gene", "x.n").where("n > 0")


def size_factors(bulk: DataFrame, samples: int | Column, *keys: str) -> DataFrame:
    """Per category (or ``keys``) and sample: the median over genes, counted in all ``samples``, of the ratio to their geometric mean."""
    by = keys or ("category",)
    logs = bulk.where("n > 0").withColumn("log", F.ln(F.col("n").cast("double")))
    gene = Window.partitionBy(*by, "gene")
    whole = logs.withColumn("seen", F.count(F.lit(1)).over(gene)).withColumn("centre", F.avg("log").over(gene)).where(F.col("seen") == samples)
    ratios = checkpoint(whole.select(*by, "sample", (F.col("log") - F.col("centre")).alias("ratio")))
    return medians(ratios, ["ratio"], *by, "sample").select(*by, "sample", F.exp("median_ratio").alias("size_factor"))


def cpm(bulk: DataFrame) -> DataFrame:
    """Counts per million of each category and sample."""
    cell = Window.partitionBy("category", "sample")
    return bulk.withColumn("cpm", 1e6 * F.col("n") / F.sum("n").over(cell))


def wilcoxon_sparse(counts: DataFrame, beads: DataFrame) -> DataFrame:
    """Per gene: rank sum of group 1 and U over all beads of ``beads`` (sample, bead, grp).

    Beads without the gene tie at zero: they share the mid-rank (zeros + 1) / 2, and counted beads come
    after them. Only counted beads are ranked; a gene's zeros are arithmetic.
    """
    sizes = beads.agg(F.count_if(F.col("grp") == 1).alias("n1"), F.count_if(F.col("grp") == 0).alias("n0"))
    seen = counts.where("n > 0").groupBy(*BEAD, "gene").agg(F.sum("n").alias("n")).join(beads, list(BEAD))
    # equal counts of a gene first, so a gene's ranks run over its distinct values
    by_value = seen.groupBy("gene", "n").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("grp") == 1).alias("c1"))
    upto = Window.partitionBy("gene").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("below", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    ranked = ranked.withColumn("own", F.col("c1") * (F.col("below") + (F.col("c") + 1) / F.lit(2.0)))
    table = ranked.groupBy("gene").agg(F.sum("c").alias("seen"), F.sum("c1").alias("seen1"), F.sum("own").alias("own")).crossJoin(F.broadcast(sizes))
    zeros, zeros1 = F.col("n1") + F.col("n0") - F.col("seen"), F.col("n1") - F.col("seen1")
    rank_sum = F.col("own") + F.col("seen1") * zeros + zeros1 * (zeros + 1) / F.lit(2.0)
    return table.select("gene", "seen", rank_sum.alias("rank_sum"), (rank_sum - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)).alias("u"))


def bead_level_test(counts: DataFrame, beads: DataFrame, least: int = 3) -> DataFrame:
    """Per category and gene, beads of group 1 against those of group 0 of ``beads`` (category, sample, bead, grp).

    (category, gene, u, p, p_adjusted, log2_fc, pct_1, pct_2): the rank-sum test in its normal approximation with ties
    and continuity corrected, Bonferroni over the category's genes, the difference of log2 of mean counts plus one, and
    the shares of beads with the gene. Samples with fewer than ``least`` beads of a category are left out of it. Only
    counted beads are ranked, as in :func:`wilcoxon_sparse`.
    """
    enough = beads.groupBy("category", "sample").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= least)
    kept = beads.join(enough.select("category", "sample"), ["category", "sample"], "left_semi")
    sizes = kept.groupBy("category").agg(F.count_if(F.col("grp") == 1).cast("double").alias("n1"), F.count_if(F.col("grp") == 0).cast("double").alias("n0"))
    seen = counts.where("n > 0").groupBy("category", *BEAD, "gene").agg(F.sum("n").alias("n")).join(kept, ["category", *BEAD])
    by_value = seen.groupBy("category", "gene", "n").agg(F.count(F.lit(1)).cast("double").alias("c"), F.count_if(F.col("grp") == 1).cast("double").alias("c1"))
    upto = Window.partitionBy("category", "gene").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    by_value = by_value.withColumn("below", F.coalesce(F.sum("c").over(upto), F.lit(0.0)))
    table = by_value.groupBy("category", "gene").agg(
        F.sum("c").alias("seen"), F.sum("c1").alias("seen1"), F.sum(F.col("c1") * (F.col("below") + (F.col("c") + 1) / 2)).alias("own"),
        F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"), F.sum(F.col("n") * F.col("c1")).alias("s1"), F.sum(F.col("n") * (F.col("c") - F.col("c1"))).alias("s0"),
    ).join(sizes, "category")
    n1, n0 = F.col("n1"), F.col("n0")
    n, zeros, zeros1 = n1 + n0, n1 + n0 - F.col("seen"), n1 - F.col("seen1")
    u = F.col("own") + F.col("seen1") * zeros + zeros1 * (zeros + 1) / 2 - n1 * (n1 + 1) / 2
    ties = F.col("ties") + F.pow(zeros, F.lit(3.0)) - zeros
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(ties, n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n0 / 2) - 0.5, sd)
    table = table.select(
        "category", "gene", u.alias("u"), F.least(F.lit(1.0), 2 * normal_tail(F.greatest(z, F.lit(0.0)))).alias("p"),
        F.log2(F.try_divide(F.try_divide(F.col("s1"), n1) + 1, F.try_divide(F.col("s0"), n0) + 1)).alias("log2_fc"),
        F.try_divide(F.col("seen1"), n1).alias("pct_1"), F.try_divide(F.col("seen") - F.col("seen1"), n0).alias("pct_2"),
    )
    return bonferroni(table, "p", "p_adjusted", "category")
