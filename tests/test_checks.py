import pytest

from ridgeline.operators import checks, counts, expression, signal
from ridgeline.sources import files


def test_assertions_at_load(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "g string, x int")
    assert checks.require_columns(df, ["g"]) is df and checks.require_groups(df, "g", ["a", "b"]) is df and checks.require_complete(df, "g") is df
    with pytest.raises(ValueError, match="missing columns: y"):
        checks.require_columns(df, ["g", "y"])
    with pytest.raises(ValueError, match="groups without rows: c"):
        checks.require_groups(df, "g", ["a", "c"])
    with pytest.raises(ValueError, match="1 rows without x"):
        checks.require_complete(df, "x")


def test_sets_of_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y")], "v int, g string")
    assert [r.member for r in checks.in_all(a, "v", "g").collect()] == [2]
    assert [r.v for r in checks.only_in(a, a.where("v < 3"), "v").collect()] == [3]
    assert checks.same_values(a, a.where("v > 0"), "v") and not checks.same_values(a, a.where("v > 1"), "v")
    assert [tuple(r) for r in checks.value_counts(a, "v").collect()] == [(2, 2), (1, 1), (3, 1)]


def test_comparison_keeps_what_failed(spark):
    one = spark.createDataFrame([(0.5, 3)], "accuracy double, n int")
    rows = {r.name: (r.status, r.accuracy) for r in checks.comparison({"a": None, "b": one}).collect()}
    assert rows == {"a": ("failed", None), "b": ("ok", 0.5)}


def test_files(spark, tmp_path):
    for name in ("b.csv", "a.csv", "a_old.csv", "0.txt"):
        (tmp_path / name).write_text("x\n1\n")
    assert files.first_file(spark, str(tmp_path), "*.csv").endswith("/a.csv")
    assert files.first_file(spark, str(tmp_path), "a*.csv", r"^a\.").endswith("/a_old.csv")
    assert files.first_file(spark, str(tmp_path), "*.mtx") is None
    with pytest.raises(ValueError, match="over 1000"):
        files.summary_json({"t": spark.range(1001)})


def test_previous_sample_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(signal, "RANGE", 4)
    df = spark.createDataFrame([(a, 0, i, float(i * i)) for a in (1, 2) for i in range(11)], "animal int, label int, pos long, v double")
    rows = signal.with_previous(df).collect()
    assert len(rows) == 22 and all(r.before == (None if r.pos == 0 else float((r.pos - 1) ** 2)) for r in rows)


def test_depth_minimum_and_status(spark):
    bulk = spark.createDataFrame([("A", s, 1, 50) for s in range(2)] + [("B", 0, 1, 500)], "category string, sample int, gene int, n long")
    assert {r.category: (r.min_depth, r.status) for r in counts.depth_minimum(bulk, 40, 2).collect()} == {"A": (50, "analysed"), "B": (0, "skipped_low_depth")}
    table = spark.createDataFrame([("A", 0.012345, 1.5), ("B", 0.5, 0.0)], "category string, padj double, log2FoldChange double")
    rows = {r.category: r for r in expression.status_table(table, bulk, 40, 2).collect()}
    assert rows["A"].min_padj == 0.0123 and rows["A"].n_lfc_gt1 == 1 and rows["B"].genes_tested is None
