"""Rounding and SQL fragments that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window length, step and least number of windows for the series of the events table.
SIZE, STEP, LEAST = 16, 8, 7

SERIES = """series AS (SELECT user_id AS animal, user_id % 2 AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  value - avg(value) OVER (PARTITION BY user_id) AS v FROM events)"""

FOLDED = """series AS (SELECT user_id % 16 AS animal, user_id % 16 % 2 AS label, row_number() OVER (PARTITION BY user_id % 16 ORDER BY user_id, ts, event_id) - 1 AS pos,
  value - avg(value) OVER (PARTITION BY user_id) AS v FROM events)"""


def windows(series: str, size: int = SIZE, step: int = STEP) -> str:
    return f"""{series}, numbered AS (SELECT *, count(*) OVER (PARTITION BY animal) AS n, lag(v) OVER (PARTITION BY animal ORDER BY pos) AS before FROM series),
wins AS (SELECT animal, label, n, unnest(range(0, (n - {size}) // {step} + 1)) AS win FROM (SELECT DISTINCT animal, label, n FROM numbered) WHERE n >= {size}),
windowed AS (SELECT w.animal, w.label, w.win, s.pos - w.win * {step} AS k, s.v, s.before FROM wins w JOIN numbered s ON s.animal = w.animal AND s.pos >= w.win * {step} AND s.pos < w.win * {step} + {size})"""


WINDOWS = windows(SERIES)

COUNTS = """counts AS (SELECT l_suppkey % 5 AS sample, l_orderkey AS bead, l_partkey AS gene, l_returnflag AS category, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)"""
BULK = f"""{COUNTS}, bulk AS (SELECT category, sample, gene, sum(n)::BIGINT AS n FROM counts GROUP BY ALL)"""
POINTS = "points AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating columns to ``digits`` places, and no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str, digits: int = 4) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"
