"""What the operators of this folder share: tables, checkpoints and column names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.shuffles import checkpoint, frequent_limit, join_frequent, let_go  # noqa: F401

#: A word, as a regular expression of Spark and of RE2.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def text_column(df: DataFrame, name: str) -> Column:
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def marked(df: DataFrame, id_column: str, text: str, *more: str) -> Column:
    """A digest of a row's id and text, and of the columns ``more``."""
    own = [column(df, c).cast("string") for c in (id_column, *more)]
    named = [F.concat(F.coalesce(F.length(c).cast("string"), F.lit("")), F.lit(":"), F.coalesce(c, F.lit(""))) for c in own]
    return F.unhex(F.md5(F.concat(*named, text_column(df, text))))


def is_sortable(kind: DataType) -> bool:
    """Whether columns of this type are used to choose between rows that are equal otherwise."""
    return kind.typeName() in ("string", "long", "integer", "double", "boolean", "timestamp", "date")


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def give_back() -> None:
    """Return this process's free memory to the system: Python workers stay for later tasks, whose needs differ."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than the GNU one


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, after which a task gives its free memory back."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(held, schema)


def with_arrow_column(df: DataFrame, name: str, kind: DataType, make: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``df`` with the column ``name`` that ``make`` gives for each batch; columns are told by place, whatever they are called."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch)], names=[*batch.schema.names, name])

    return map_batches(numbered, run, StructType([*numbered.schema.fields, StructField(name, kind)])).toDF(*df.columns, name)
