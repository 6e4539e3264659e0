"""Exact deduplication with a two-pass Bloom filter.

Pass one hashes every normalised text and counts, in a filter of bounded size,
which cells are hit more than once. Pass two tests every hash against those
cells: a text that occurs twice hits only such cells, so a hash with any other
cell is unique and its row passes straight through. Only the rest shuffle.

Texts are equal when identical after each run of white space
(``\\x20``, ``\\x09-\\x0D``) has become one space. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from . import text as words
from .common import checkpoint, column, free_name, is_sortable, join_frequent, map_batches, text_column, with_arrow_column

#: The filter has 16 cells a row, rounded up to a power of two, and never more than this (32 MB).
MAX_CELL_BITS = 28
CELLS_A_HASH = 2
SEGMENTS = 64

_TO_SPACE = bytes.maketrans(words.SEPARATORS, b" " * len(words.SEPARATORS))
_SPACES = re.compile(b"  +")


def normalised(raw: bytes) -> bytes:
    raw = raw.translate(_TO_SPACE)
    return _SPACES.sub(b" ", raw) if b"  " in raw else raw


def digests(texts: pa.Array) -> pa.Array:
    """SHA-256 of each normalised text."""
    data, offsets = words.column_bytes(texts)
    view = memoryview(data)
    return pa.array([hashlib.sha256(normalised(bytes(view[a:b]))).digest() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def with_digest(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the digest of ``text`` as one more column."""
    at = df.columns.index(text)
    return with_arrow_column(df, name, BinaryType(), lambda batch: digests(batch.column(at)))


def _cells(digest: pa.Array, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(x[:8] for x in digest.to_pylist()), np.uint32).reshape(-1, CELLS_A_HASH)
    return raw >> np.uint32(32 - bits)


def repeated_cells(hashed: DataFrame, digest: str, rows: int) -> tuple[bytes, int]:
    """The filter's bits (those of cells hit twice or more) and its size as a power of two.

    Each task sends its distinct cells once, those it has hit twice apart, so a
    group of copies of any size costs a task a few cells.
    """
    bits = min(MAX_CELL_BITS, max(16, (16 * max(1, rows) - 1).bit_length()))
    shift = bits - SEGMENTS.bit_length() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch.column(0), bits)
            # the cells of one hash may coincide; that is one hit
            flat = np.concatenate([cells[:, 0], cells[cells[:, 0] != cells[:, 1], 1]])
            cells, hits = np.unique(flat, return_counts=True)
            ends = np.searchsorted(cells >> np.uint32(shift), np.arange(SEGMENTS + 1))
            parts = [(s, cells[a:b], hits[a:b]) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in parts], pa.int32()), pa.array([c.tobytes() for _, c, _ in parts], pa.binary()), pa.array([c[h > 1].tobytes() for _, c, h in parts], pa.binary())],
                names=["segment", "hit", "hit_again"],
            )

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << shift
        once, again = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            for hit, twice in zip(batch.column("hit").to_pylist(), batch.column("hit_again").to_pylist()):
                at = np.frombuffer(hit, np.uint32) & np.uint32(size - 1)
                again[at[once[at]]] = True
                once[at] = True
                again[np.frombuffer(twice, np.uint32) & np.uint32(size - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], names=["segment", "bits"])

    counted = map_batches(hashed.select(digest), count, "segment int, hit binary, hit_again binary")
    merged = counted.groupBy("segment").applyInArrow(merge, "segment int, bits binary").collect()
    filter_bits = bytearray(max(1, 1 << (bits - 3)))
    for row in merged:  # SEGMENTS rows at most, 32 MB in all at most
        at = row["segment"] << (shift - 3)
        filter_bits[at : at + len(row["bits"])] = row["bits"]
    return bytes(filter_bits), bits


def _suspect(digest: pa.Array, found: bytes, bits: int) -> np.ndarray:
    cells_twice, cells = np.frombuffer(found, np.uint8), _cells(digest, bits)
    return ((cells_twice[cells >> np.uint32(3)] >> (np.uint32(7) - (cells & np.uint32(7)))) & 1).all(axis=1)


def with_suspicion(hashed: DataFrame, digest: str, flag: str, stored: DataFrame | None = None) -> DataFrame:
    """``hashed`` with a boolean: false only where the digest is surely unique.

    ``stored`` has the digests of ``hashed`` alone, where making those again is dear.
    """
    stored = hashed if stored is None else stored
    found, bits = repeated_cells(stored, digest, stored.count())
    shared = hashed.sparkSession.sparkContext.broadcast(found)
    at = hashed.columns.index(digest)

    return with_arrow_column(hashed, flag, BooleanType(), lambda batch: pa.array(_suspect(batch.column(at), shared.value, bits)))


def duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; a null id comes after all
    others. Rows equal in text and id are one document written twice: exactly one
    of them has ``kept``. Other columns are ignored. An empty table gives none.
    """
    hashed = with_digest(df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text")), "text", "sha")
    hashed = checkpoint(hashed.select("doc_id", "sha"))
    marked = with_suspicion(hashed, "sha", "maybe")
    single = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    suspects = marked.where("maybe").select("doc_id", "sha")
    groups = checkpoint(suspects.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # rows equal in text and id are counted, then written out again by number
    numbered = suspects.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = numbered.select("sha", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    repeated = join_frequent(rows, groups, ["sha"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    return single.unionByName(repeated).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    As :func:`duplicates`; of rows equal in text and id, the one that sorts first
    by its other columns stays.
    """
    sha, maybe = free_name(df, "sha"), free_name(df, "maybe")
    hashed = with_digest(df, text, sha)
    marked = with_suspicion(hashed, sha, maybe, checkpoint(hashed.select(sha)))
    names = [column(marked, c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    sortable = [column(marked, f.name) for f in df.schema.fields if is_sortable(f.dataType)]
    order = F.struct(column(marked, id_column).isNull(), column(marked, id_column), *sortable)
    unique = marked.where(~F.col(maybe)).select(*names)
    first = marked.where(F.col(maybe)).groupBy(sha).agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*")
    return unique.unionByName(first).toDF(*df.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
