import numpy as np
import pytest

from ridgeline.operators import annotate, counts, enrichment, expression, scenarios


def table(spark, rows):
    return spark.createDataFrame(rows, "sample long, bead long, gene long, category string, n long")


def test_implicit_zeros_share_a_rank(spark):
    df = table(spark, [(0, 4, 1, "A", 2), (0, 5, 1, "A", 7)])
    beads = spark.createDataFrame([(0, b, int(b >= 4)) for b in range(1, 6)], "sample long, bead long, grp int")
    row = counts.wilcoxon_sparse(df, beads).first()
    assert row["rank_sum"] == 9 and row["u"] == 6  # zeros at 2, counted at 4 and 5


def test_wilcoxon_against_dense_ranks(spark):
    rng = np.random.default_rng(1)
    dense = rng.poisson(0.7, (60, 5))
    grp = rng.integers(0, 2, 60)
    df = table(spark, [(0, b, g, "A", int(dense[b, g])) for b in range(60) for g in range(5) if dense[b, g]])
    beads = spark.createDataFrame([(0, b, int(grp[b])) for b in range(60)], "sample long, bead long, grp int")
    for r in counts.wilcoxon_sparse(df, beads).collect():
        v = dense[:, r["gene"]]
        ranks = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert r["rank_sum"] == ranks[grp == 1].sum()


def test_pseudobulk_keeps_all_counts(spark):
    df = table(spark, [(s, b, g, "AB"[b % 2], b + g) for s in range(2) for b in range(1, 6) for g in range(3)])
    bulk = counts.pseudobulk(df)
    total = df.groupBy().sum("n").first()[0]
    assert bulk.groupBy().sum("n").first()[0] == total
    wide = counts.pseudobulk_pivot(bulk, spark.createDataFrame([(g,) for g in range(4)], "gene long"), [0, 1])
    assert wide.count() == 8 and wide.where("gene = 3").selectExpr("sum(s0 + s1)").first()[0] == 0
    assert wide.selectExpr("sum(s0 + s1)").first()[0] == total


def test_rules_and_ids(spark):
    df = spark.createDataFrame([("09 Glut-GABA",), ("01 X Glut",), ("02 Y Dopa",), ("none",)], "c string")
    got = [r.o for r in df.withColumn("o", annotate.by_rules("c", annotate.CLASS_RULES)).collect()]
    assert got == ["GABAergic_Neurons", "Glutamatergic_Neurons", "Other_Neurons", None]
    row = annotate.split_id(spark.createDataFrame([("J11_AC_GT",)], "id string"), "id").first()
    assert (row["sample"], row["barcode"]) == ("J11", "AC_GT")


def test_running_scores(spark):
    listed = spark.createDataFrame([(1, 3.0, 1), (2, 2.0, 2), (3, -1.0, 3), (4, -2.0, 4)], "gene long, stat double, rank int")
    sets = spark.createDataFrame([("s", 1), ("s", 3)], "set_id string, gene long")
    walk = [r.running for r in enrichment.running_scores(listed, sets).orderBy("rank").collect()]
    assert walk == pytest.approx([0.75, 0.25, 0.5, 0.0])
    assert enrichment.enrichment(listed, sets).first()["es"] == pytest.approx(0.75)


def test_scores_from_members_equal_the_walk(spark):
    rng = np.random.default_rng(5)
    stat = np.sort(rng.normal(size=60))[::-1]
    listed = spark.createDataFrame([(i, float(s), i + 1) for i, s in enumerate(stat)], "gene long, stat double, rank int")
    sets = spark.createDataFrame([(f"s{k}", int(g)) for k in range(6) for g in rng.choice(60, 3 + 4 * k, replace=False)], "set_id string, gene long")
    by_walk = {}
    for r in enrichment.running_scores(listed, sets).collect():
        by_walk.setdefault(r.set_id, []).append(r.running)
    for r in enrichment.enrichment(listed, sets).collect():
        w = by_walk[r.set_id]
        assert r.es == pytest.approx(max(w) if max(w) >= -min(min(w), 0) else min(w))


def test_dedup_keeps_the_first_name(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", None)], "gene string, stat double")
    m = spark.createDataFrame([("a", 7), ("b", 7), ("c", 8)], "symbol string, entrez int")
    assert [(r.gene, r.entrez) for r in enrichment.map_genes(t, m).collect()] == [("a", 7)]


def test_splits(spark):
    rows = scenarios.exact_splits(spark, [0, 1, 2, 3, 4], 2).where("small").collect()
    assert len({r.split for r in rows}) == 10 and sorted(r.item for r in rows if r.split == 0) == [0, 1]


def test_folds_hold_every_animal(spark):
    animals = spark.createDataFrame([(a, a % 2) for a in range(12)], "animal long, label int")
    folds = scenarios.outer_folds(animals).collect()
    assert len(folds) == 36 and {f.control for f in folds} | {f.exercised for f in folds} == {str(a) for a in range(12)}
    assert [f.control for f in sorted(folds, key=lambda f: f.fold)][:6] == ["0"] * 6


def test_label_permutations_are_numpy_draws(spark):
    got = scenarios.label_permutations(spark, list("abcd"), [0, 0, 1, 1], 3).orderBy("permutation", "animal").collect()
    rng = np.random.default_rng(42)
    want = [int(y) for _ in range(3) for y in np.array([0, 0, 1, 1])[rng.permutation(4)]]
    assert [r.label for r in got] == want


def test_wald_finds_planted_genes(spark):
    rng = np.random.default_rng(7)
    means = rng.uniform(80, 400, 300)
    rows = []
    for s in range(6):
        mu = means * np.where((np.arange(300) < 20) & (s < 3), 4.0, 1.0)
        n = rng.negative_binomial(20, 20 / (20 + mu))
        rows += [("A", s, g, int(x)) for g, x in enumerate(n)]
    bulk = spark.createDataFrame(rows, "category string, sample long, gene long, n long")
    groups = spark.createDataFrame([("x", s, int(s < 3)) for s in range(6)], "scenario string, sample long, grp int")
    table_ = expression.wald(bulk, groups, 5, 2).collect()
    called = {r.gene for r in table_ if r.padj < 0.05}
    assert len(called & set(range(20))) >= 18 and len(called - set(range(20))) <= 6
    lfc = {r.gene: r.log2FoldChange for r in table_}
    assert np.median([lfc[g] for g in range(20)]) == pytest.approx(2, abs=0.3)


def test_halves_go_to_the_even_neighbour(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (3, -0.5), (4, -1.5), (5, 2.4999), (6, None), (7, 3e9 + 0.5)], "i int, n double")
    assert [r.n for r in counts.whole(df).orderBy("i").collect()] == [0, 2, 2, 0, -2, 2, None, 3_000_000_000]
    assert counts.whole(df).schema["n"].dataType.typeName() == "long"


def test_merged_parts_have_prefixed_ids(spark):
    one = spark.createDataFrame([("a", 1)], "cell string, x int")
    two = spark.createDataFrame([("a", 2.5)], "cell string, y double")
    df = annotate.merged({"J1": one, "J2": two}, "cell")
    assert sorted(map(str, (r.asDict() for r in df.collect()))) == sorted(map(str, [{"cell": "J1_a", "x": 1, "sample": "J1", "y": None}, {"cell": "J2_a", "x": None, "sample": "J2", "y": 2.5}]))
    assert [(r["sample"], r.barcode) for r in annotate.split_id(df.select("cell"), "cell").orderBy("cell").collect()] == [("J1", "a"), ("J2", "a")]
    with pytest.raises(ValueError):
        annotate.merged({}, "cell")


def test_dots_in_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, c int")
    assert annotate.plain_names(df).columns == ["a_b", "c"]
    with pytest.raises(ValueError, match="a_b"):
        annotate.plain_names(spark.createDataFrame([(1, 2)], "`a.b` int, a_b int"))
