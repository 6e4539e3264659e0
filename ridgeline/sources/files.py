"""File formats: sparse matrices, line lists, annotated CSV, recordings; and the sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Most rows of a table inside a summary.
SUMMARY_ROWS = 1000


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, n) of a MatrixMarket coordinate file, 1-based; absent entries are zeros.

    Comment lines start with ``%``. The line of dimensions is the only one whose
    three numbers are rows, columns and entries: it is the first other line, read apart.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(fields) == 3).select(fields[0].cast("long").alias("i"), fields[1].cast("long").alias("j"), fields[2].cast("double").alias("n"))
    if size is None:
        return rows.limit(0)
    m, n, count = (int(float(x)) for x in size[0].split())
    # an entry equal to the line of dimensions would be (rows, columns, entries): take just one such line away
    head = (F.col("i") == m) & (F.col("j") == n) & (F.col("n") == count)
    extra = rows.where(head).count() - 1
    kept = rows.where(~head)
    return kept if extra <= 0 else kept.unionByName(spark.createDataFrame([(m, n, float(count))] * extra, rows.schema))


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, name) of a small file of names, one a line, 1-based: the file is read whole, as its order counts."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", r"\r?\n$", "")), r"\r?\n")).alias("position", "name")).withColumn("position", F.col("position") + 1)


def annotation_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, a declared schema and ``#`` comment lines."""
    return spark.read.csv(path, schema=schema, header=True, comment="#", enforceSchema=False)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, x, y) of a CSV with a header whose first column names the bead: columns are told by place, whatever the header calls them."""
    return spark.read.csv(path, schema="barcode string, x double, y double", header=True, enforceSchema=True)


def named_files(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    """``df`` with the groups of ``pattern`` in its file's name as columns; rows of other files go."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    df = df.withColumn("_file", name).where(F.col("_file").rlike(pattern))
    for i, column in enumerate(names, 1):
        df = df.withColumn(column, F.regexp_extract("_file", pattern, i))
    return df.drop("_file")


def first_file(spark: SparkSession, folder: str, pattern: str, exclude: str | None = None) -> str | None:
    """The path of the first file by name that matches the glob ``pattern``, but for those whose name matches the expression ``exclude``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")  # names alone are read
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files if exclude is None else files.where(~name.rlike(exclude))
    row = files.orderBy(name, "path").first()
    return row["path"] if row else None


def recordings(spark: SparkSession, path: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (file, row, samples) of a parquet folder that ``mapping`` (file, row, group) names, and the rows of ``mapping`` that aren't there."""
    data = spark.read.schema("file string, row int, samples array<double>").parquet(path)
    return data.join(F.broadcast(mapping) if mapping.count() < 10_000 else mapping, ["file", "row"]), mapping.join(data.select("file", "row"), ["file", "row"], "left_anti")


def write_tables(tables: dict[str, DataFrame], folder: str, prefix: str = "") -> None:
    """One CSV folder per table, each read again after it is written: a RuntimeError if rows are missing."""
    for name, df in tables.items():
        path = f"{folder}/{re.sub(r'[^A-Za-z0-9_]+', '_', prefix + name)}"
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").csv(path, header=True)
        found = df.sparkSession.read.csv(path, header=True, multiLine=True, schema=", ".join(f"c{i} string" for i in range(len(df.columns)))).count()
        if found != rows.get["n"]:
            raise RuntimeError(f"{path} has {found} of {rows.get['n']} rows")


def summary_json(parts: dict[str, DataFrame | str | int | float | None]) -> str:
    """A nested summary: one-row tables become objects, others lists of objects; a table of over SUMMARY_ROWS rows raises."""
    out = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = [r.asDict(recursive=True) for r in part.limit(SUMMARY_ROWS + 1).collect()]
            if len(rows) > SUMMARY_ROWS:
                raise ValueError(f"{name} has over {SUMMARY_ROWS} rows; write it as a table")
            part = rows[0] if len(rows) == 1 else rows
        out[name] = part
    return json.dumps(out, default=str, sort_keys=True)
