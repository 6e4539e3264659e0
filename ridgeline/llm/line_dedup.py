"""Removing boilerplate lines by how many distinct sites they occur on.

A HyperLogLog sketch of sites per line hash merges by aggregation, so a line of
any frequency costs a task one sketch. Lines whose estimate is so near the
threshold that the sketch can't decide get an exact distinct count; no others do.
Lines on the threshold's number of sites or more are removed everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, join_frequent, table, text_column

#: A line on this many sites is boilerplate.
SITES = 10

#: Sketches have 2**LOG_SIZE cells, so a relative error of 1.04 / 2**(LOG_SIZE / 2); estimates within this many errors are counted exactly.
LOG_SIZE, ERRORS = 10, 6


#: So many line hashes, 8 bytes each, are broadcast.
BROADCAST_LINES = 1_000_000


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\f")))


def has_text(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\f")) != ""


def only_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose line is one of ``wanted`` (line, rows).

    Up to BROADCAST_LINES of these go to where the lines are, so that no line, however
    frequent, is shuffled; more are joined with frequent ones dealt over several tasks.
    """
    if wanted.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(wanted.select("line")), "line", "left_semi")
    return join_frequent(lines, wanted, ["line"], "rows", "left_semi")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line, rows): hashes of ``lines`` (line, site) on ``sites`` distinct sites or more, and how many rows each has."""
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LOG_SIZE / 2) * sites)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_SIZE)).alias("sketch"), F.count(F.lit(1)).alias("rows")).select("line", "rows", F.hll_sketch_estimate("sketch").alias("n"))
    spread = checkpoint(spread.where(F.col("n") >= sites - margin))
    near = spread.where(F.col("n") <= sites + margin).select("line", "rows")
    exact = only_lines(lines, near).distinct()
    exact = exact.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).join(near, "line")
    return spread.where(F.col("n") > sites + margin).select("line", "rows").unionByName(exact.select("line", "rows"))


def remove_boilerplate(df: DataFrame, id_column: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept (the text that stays).

    Lines are what line feeds separate; they are equal if they are after trimming
    blanks. Blank lines are never boilerplate. A null site is a site of its own; a
    null text is one empty line. Rows that repeat lose the same lines. A null id
    stays null, other columns are ignored, and an empty table gives no rows.
    """
    t = text_column(df, text)
    docs = df.select(column(df, id_column).alias("doc_id"), F.xxhash64(column(df, site)).alias("site"), t.alias("text"), F.xxhash64(t).alias("mark"))
    split = F.split("text", "\n", -1)
    lines = docs.select("doc_id", "mark", "site", F.explode(split).alias("line")).where(has_text(F.col("line"))).withColumn("line", line_hash(F.col("line")))
    common = checkpoint(boilerplate(lines.select("line", "site"), sites))
    hits = lines.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "line")
    hits = only_lines(hits, common).distinct()
    bad = hits.groupBy("d", "m").agg(F.collect_set("line").alias("bad"))
    joined = docs.join(bad, docs["doc_id"].eqNullSafe(bad["d"]) & (docs["mark"] == bad["m"]), "left")
    kept = F.when(F.col("bad").isNull(), split).otherwise(F.filter(split, lambda x: ~(has_text(x) & F.array_contains("bad", line_hash(x)))))
    rows = joined.select("doc_id", F.size(split).cast("long").alias("n_lines"), kept.alias("kept"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    rows = remove_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, source, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l),
b AS (SELECT t FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce(source, chr(1))) >= 10),
m AS (SELECT k.*, b.t IS NOT NULL AS gone FROM k LEFT JOIN b ON k.t = b.t)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
