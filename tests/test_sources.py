import json

from pyspark.sql import functions as F

from ridgeline.sources import files


def test_matrix_market(spark, tmp_path):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate integer general\n% note\n3 4 3\n1 1 5\n3 4 3\n2 2 1\n")
    assert sorted(map(tuple, files.matrix_market(spark, str(path)).collect())) == [(1, 1, 5.0), (2, 2, 1.0), (3, 4, 3.0)]


def test_line_list(spark, tmp_path):
    path = tmp_path / "genes.tsv"
    path.write_text("a\nb\nc\n")
    assert [(r.position, r.name) for r in files.line_list(spark, str(path)).collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_annotation_and_names(spark, tmp_path):
    (tmp_path / "GO_DG.csv").write_text("# made by\ncell_id,score\nJ1_A,0.5\n")
    (tmp_path / "other.txt").write_text("cell_id,score\nx,1\n")
    df = files.named_files(files.annotation_csv(spark, str(tmp_path), "cell_id string, score double"), r"^(GO|KEGG)_(\w+)\.csv$", "source", "category")
    assert [tuple(r) for r in df.collect()] == [("J1_A", 0.5, "GO", "DG")]


def test_recordings_and_missing_rows(spark, tmp_path):
    spark.createDataFrame([("f", 0, [1.0]), ("f", 1, [2.0])], "file string, row int, samples array<double>").write.parquet(str(tmp_path / "r"))
    mapping = spark.createDataFrame([("f", 1, "run"), ("g", 0, "run")], "file string, row int, grp string")
    found, missing = files.recordings(spark, str(tmp_path / "r"), mapping)
    assert [r.samples for r in found.collect()] == [[2.0]] and [r.file for r in missing.collect()] == ["g"]


def test_sinks(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("x"))
    files.write_tables({"a b": df}, str(tmp_path), "g_")
    assert spark.read.csv(str(tmp_path / "g_a_b"), header=True).count() == 3
    assert json.loads(files.summary_json({"one": df.limit(1), "n": 2, "none": None})) == {"one": {"x": 0}, "n": 2, "none": None}


def test_positions_by_place(spark, tmp_path):
    (tmp_path / "J1_MatchedBeadLocation.csv").write_text('"","xcoord","ycoord"\n"AC-1",1.5,2\n"GT-1",NA,4\n')
    df = files.positions(spark, str(tmp_path / "J1_MatchedBeadLocation.csv"))
    assert df.columns == ["barcode", "x", "y"]
    assert sorted(map(tuple, df.collect())) == [("AC-1", 1.5, 2.0), ("GT-1", None, 4.0)]
