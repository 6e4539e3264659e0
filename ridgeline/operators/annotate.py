"""Categories from labels: recoding, ordered rules, split identifiers, markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recode(df: DataFrame, column: str, codes: DataFrame, out: str, default: Column | str) -> DataFrame:
    """``column`` through ``codes`` (key, value); what isn't there gets ``default``."""
    default = default if isinstance(default, Column) else F.lit(default)
    keyed = codes.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return df.join(keyed, df[column] == keyed["_key"], "left").withColumn(out, F.coalesce("_value", default)).drop("_key", "_value")


def by_rules(column: str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first regular expression that ``column`` has a match for."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(F.col(column).rlike(pattern), F.lit(value)).otherwise(out)
    return out


#: What is left after recoding by subclass, in the order in which it holds (fixed values).
CLASS_RULES = [("GABA", "GABAergic_Neurons"), ("Glut$", "Glutamatergic_Neurons"), ("(Dopa|Sero|Chol|Nora|Hist)$", "Other_Neurons")]


def split_id(df: DataFrame, column: str) -> DataFrame:
    """``sample`` before and ``barcode`` after the first underscore; an id without one is both."""
    return df.withColumn("sample", F.substring_index(column, "_", 1)).withColumn("barcode", F.regexp_replace(column, r"^[^_]+_", ""))


def merged(parts: dict[str, DataFrame], column: str, name: str = "sample") -> DataFrame:
    """All of ``parts`` in one table, ``column`` prefixed with the part's name and an underscore, and that name in ``name``.

    Columns that a part lacks are null. :func:`split_id` undoes the prefix where names have no underscore.
    """
    if not parts:
        raise ValueError("no parts to merge")
    out = None
    for part, df in parts.items():
        rows = df.withColumns({name: F.lit(part), column: F.concat_ws("_", F.lit(part), F.col(column).cast("string"))})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with underscores for the dots in its columns' names; a ValueError if two would then be the same."""
    names = [c.replace(".", "_") for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"columns of one name: {', '.join(sorted(n for n in set(names) if names.count(n) > 1))}")
    return df.toDF(*names)


def unmatched(df: DataFrame, column: str) -> int:
    """Rows without a category, which should be none."""
    return df.where(F.col(column).isNull()).count()


def marker_zscore(expression: DataFrame) -> DataFrame:
    """(category, gene, value) with ``z``: of the gene over categories, by the sample deviation (null where that is 0)."""
    gene = Window.partitionBy("gene")
    return expression.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(gene), F.stddev_samp("value").over(gene)))


def marker_validation(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """Per marker of ``expected`` (gene, expected): the category where it is highest (first by name on ties), and whether that is the one expected."""
    # one reading of z: made twice, it may differ in its last bits and equal no greatest value
    gene = Window.partitionBy("gene")
    marked = scored.join(expected, "gene").withColumn("z_top", F.max("z").over(gene))
    first, own = F.min(F.when(F.col("z") == F.col("z_top"), F.col("category"))), F.max(F.when(F.col("category") == F.col("expected"), F.col("z")))
    table = marked.where("z_top IS NOT NULL").groupBy("gene", "expected", "z_top").agg(first.alias("highest_in"), own.alias("z_expected"))
    return table.select("gene", "expected", "highest_in", "z_top", "z_expected", F.when(F.col("expected") == F.col("highest_in"), "yes").otherwise("no").alias("match"))
