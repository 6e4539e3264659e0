"""Small tables for the tests of this folder."""

import re

SF = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, repeated rows, equal ids and a long text.
ODD = [
    (1, "a b  c\n\td", "s1"), (2, "a b c d", None), (2, "a b c d", None), (3, None, "s2"), (4, "", "s1"), (5, " \n", "s2"),
    (None, "a b c d", "s1"), (None, None, None), (6, "é ß 日本 " * 900, "s3"), (7, "x" * 5000, "s3"), (6, "one", "s1"),
]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # extra columns with names that operators might use themselves
    return df.selectExpr("*", "'x' AS sha", "1 AS n", "array(1) AS `a.b`") if extra else df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
