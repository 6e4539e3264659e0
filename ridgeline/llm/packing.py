"""Packing documents into sequences of fixed capacity with minimum bin slack.

A document's ids are cut into full sequences and one remainder. How many
remainders there are of each length is a table of ``capacity`` rows at most,
whatever the input; it is all that planning needs. A plan is a list of
patterns: a multiset of lengths and how many sequences repeat it. A pattern
starts from the longest length left; a bitset of reachable sums (dynamic
programming over lengths, each with its count) finds the multiset that fills the
sequence closest to capacity, and backtracking through the bitsets gives its
counts. A remainder of over half a sequence for which no exact filling is left
is cut at half, and both parts rejoin the lengths still to be packed.

Documents then find their place by rank within their length: ranks are
prefix sums over buckets of rows, and rank and length give sequence and offset
by a search in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as words
from .common import checkpoint, column, map_batches, table, text_column
from .tokens import Encoder

CAPACITY = 2048
END = 1

#: Rows of one length in a bucket, about.
BUCKET_ROWS = 10_000


@dataclass
class Plan:
    """``block_*``: for each stretch of ranks of a length, in order of (length, rank): the
    first rank, the first sequence, copies in a sequence and the offset there. ``whole``: how
    many of each length stay whole (the others are cut at half); ``base``: the first rank that
    the parts of a cut length have among those of their own length."""

    capacity: int
    sequences: int = 0
    blocks: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    whole: dict[int, int] = field(default_factory=dict)
    base: dict[int, tuple[int, int]] = field(default_factory=dict)
    padding: int = 0


def _is_power(n: int) -> bool:
    return n & (n - 1) == 0


def fill(counts: dict[int, int], room: int, goals: list[int]) -> tuple[dict[int, int], int]:
    """The multiset of lengths whose sum is the first reachable goal, else the largest up to ``room``.

    Lengths are tried in the order of ``counts``; a sum is made from the lengths that reach it first.
    """
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length, count in counts.items():
        if reach >> goals[0] & 1:
            break
        most, k = min(count, room // length), 1
        while most > 0:
            k = min(k, most)
            grown = (reach | reach << (k * length)) & mask
            if grown != reach:
                layers.append((length, k, reach))
                reach = grown
            most -= k
            k *= 2
    total = next((g for g in goals if reach >> g & 1), reach.bit_length() - 1)
    chosen, left = {}, total
    for length, k, before in reversed(layers):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + k
            left -= k * length
    return chosen, total


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns for ``histogram`` (length to count; no length over ``capacity``)."""
    out, half = Plan(capacity), capacity // 2
    left = {n: c for n, c in histogram.items() if c}
    cursor = dict.fromkeys(left, 0)
    powers = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if 1 << b != capacity]

    def use(pattern: dict[int, int], times: int) -> None:
        offset = 0
        for length, k in pattern.items():
            out.blocks.append((length, cursor[length], out.sequences, k, offset))
            cursor[length] += k * times
            left[length] -= k * times
            if not left[length]:
                del left[length]
            offset += k * length
        out.sequences += times
        out.padding += 0 if offset == capacity or _is_power(offset) else times * (capacity - offset)

    while left:
        seed = max(left)
        others = dict(sorted(((n, c - (n == seed)) for n, c in left.items() if c > (n == seed)), key=lambda x: -x[1]))
        room = capacity - seed
        goals = [room, *(p - seed for p in powers if p >= seed)]
        chosen, total = fill(others, room, goals) if room else ({}, 0)
        exact = seed + total == capacity or seed + total in powers
        if not exact and half < seed < capacity:
            cut = left.pop(seed)
            out.whole[seed] = cursor[seed]
            # appended after the ranks that those lengths have already
            out.base[seed] = (cursor.get(half, 0) + left.get(half, 0), cursor.get(seed - half, 0) + left.get(seed - half, 0))
            for part in (half, seed - half):
                left[part] = left.get(part, 0) + cut
                cursor.setdefault(part, 0)
            if seed - half == half:
                out.base[seed] = (out.base[seed][0], out.base[seed][0] + cut)
            continue
        chosen[seed] = chosen.get(seed, 0) + 1
        use(dict(sorted(chosen.items(), reverse=True)), min(left[n] // k for n, k in chosen.items()))
    out.blocks.sort()
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(df: DataFrame, tokenizer: str, capacity: int, end: int, id_column: str, text: str, keep_ids: bool) -> DataFrame:
    """Full sequences and remainders of all documents, with checksums of the halves a remainder may be cut into."""
    half = capacity // 2
    schema = "doc_id " + df.schema[id_column].dataType.simpleString() + ", start long, length int, crc long, crc_head long, crc_tail long, doc_tokens long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, end).encode
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                ids, at = encode(part.column(1))
                rows = []
                for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    for s in range(a, b, capacity):
                        x = ids[s : min(b, s + capacity)]
                        cut = half < len(x) < capacity
                        rows.append((row, s - a, len(x), crc(x), crc(x[:half]) if cut else 0, crc(x[half:]) if cut else 0, b - a, *([x.astype("<u4").tobytes()] if keep_ids else [])))
                cols = list(zip(*rows)) or [()] * (7 + keep_ids)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                arrays[0] = part.column(0).take(arrays[0])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "crc", "crc_head", "crc_tail", "doc_tokens", "ids"][: len(arrays)])

    return map_batches(df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text")), run, schema)


def _ranked(made: DataFrame, rows: int) -> DataFrame:
    """``made`` with each row's rank (from 0) among those of its length, no length in one task."""
    buckets = 1 + rows // BUCKET_ROWS
    order = [F.col(c) for c in ("doc_id", "start", "crc", "doc_tokens")]
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(buckets)))
    before = made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    numbered = made.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("number"))


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``, if kept).

    ``tokenizer`` is a tokenizers file, readable on every executor. A null or
    empty text is the single id ``end``. Rows that repeat are packed once each. A
    null id stays null. Columns other than the two named are ignored, whatever
    they are called. An empty table gives no rows. Sequences are numbered from 0
    without gaps and hold pieces without gaps from offset 0.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    half = capacity // 2
    made = checkpoint(pieces(df, tokenizer, capacity, end, id_column, text, keep_ids))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = sum(histogram.values())
    laid = plan(histogram, capacity)
    blocks = np.array(laid.blocks, np.int64).reshape(-1, 5)
    keys = (blocks[:, 0] << 44) + blocks[:, 1]
    whole = np.full(capacity + 1, np.iinfo(np.int64).max)
    base = np.zeros((capacity + 1, 2), np.int64)
    for n in laid.whole:
        whole[n], base[n] = laid.whole[n], laid.base[n]
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "crc", "crc_head", "crc_tail", "doc_tokens", "rank")}
            n, rank = get["length"].astype(np.int64), get["rank"].astype(np.int64)
            cut = rank >= whole[n]
            row = np.concatenate([np.flatnonzero(~cut), np.flatnonzero(cut), np.flatnonzero(cut)])
            part = np.repeat([0, 1, 2], [(~cut).sum(), cut.sum(), cut.sum()])
            length = np.select([part == 0, part == 1], [n[row], half], n[row] - half)
            at = np.where(part == 0, rank[row], rank[row] - whole[n[row]] * (part > 0) + base[n[row], np.maximum(part - 1, 0)])
            b = np.searchsorted(keys, (length << 44) + at, "right") - 1
            slot = at - blocks[b, 1]
            sums = np.select([part == 0, part == 1], [get["crc"][row], get["crc_head"][row]], get["crc_tail"][row])
            start = get["start"][row] + np.where(part == 2, half, 0)
            out = [batch.column("doc_id").take(pa.array(row)), start, length, sums, get["doc_tokens"][row], blocks[b, 2] + slot // blocks[b, 3], blocks[b, 4] + slot % blocks[b, 3] * length]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                raw = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()]
                out.append(pa.array([raw[r][h : h + k] for r, h, k in zip(row, np.where(part == 2, half, 0), length)], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out], names=names)

    return map_batches(_ranked(made, rows).select("doc_id", "start", "length", "crc", "crc_head", "crc_tail", "doc_tokens", "rank", *["ids"] * keep_ids), place, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
