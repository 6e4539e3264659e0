import random

from pyspark.sql import functions as F

from ridgeline.operators import annotate


def test_highest_category_where_z_differs_in_its_last_bits(spark):
    scored = spark.createDataFrame([(c, g, float(i - 1)) for g in range(40) for i, c in enumerate("ANR")], "category string, gene long, z double")
    # sums over tasks come in any order, so a second reading of z isn't the first
    shaken = F.udf(lambda z: z * (1 + 1e-12 * random.SystemRandom().random()), "double").asNondeterministic()
    expected = spark.createDataFrame([(g, "ANR"[g % 3]) for g in range(40)], "gene long, expected string")
    got = annotate.marker_validation(scored.withColumn("z", shaken("z")), expected).collect()
    assert len(got) == 40 and all(r.highest_in == "R" and r.match == ("yes" if r.expected == "R" else "no") for r in got)
    assert all(abs(r.z_top - 1) < 1e-9 and abs(r.z_expected - ("ANR".index(r.expected) - 1)) < 1e-9 for r in got)
