"""Removing passages that occur earlier, by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words. A window of
``window`` words, at least twice a block less one, holds a whole block wherever
it lies, so two equal windows imply that a block of each is hit by a rolling
window of the other. Block hashes are the index; all rolling windows of block
length probe it. A block that nothing but itself hits is no anchor.

Anchors are extended to windows of full length: those whose blocks are all
anchors are compared by two independent hashes of 64 bits, inside a chunk and between
chunks, and every occurrence but the first is repeated. Neighbouring repeated windows join into maximal repeated spans.

Documents are dealt into chunks by id. A chunk sends sorted arrays of distinct
hashes to hash partitions, a few rows in all, and gets back what was hit, so a
passage of any frequency costs a chunk one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as words
from .common import column, partitions, table, text_column

WINDOW, BLOCK = 20, 10

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4_000_000

#: Bytes of text whose hashes make one hash partition, about; a task holds one.
PART_BYTES = 32_000_000


class _Chunk:
    """The documents of one chunk in order of id (rows without one last, by digest), then text."""

    def __init__(self, rows: pa.Table):
        ids, places, texts = rows.column("doc_id").to_pylist(), rows.column("place").to_pylist(), rows.column("text").combine_chunks()
        raw = texts.to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, places[i], raw[i]))
        self.ids, self.places = [ids[i] for i in order], [places[i] for i in order]
        self.words = words.Words(texts.take(pa.array(order, pa.int64())) if order else texts)

    def starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self.words.windows(size)

    def within(self, at: np.ndarray) -> np.ndarray:
        """Position in its document of each word of the chunk in ``at``."""
        w = self.words
        return at - np.repeat(w.offsets[:-1], w.counts)[at]


def _parts(hashes: np.ndarray, count: int) -> np.ndarray:
    """The hash partition of each hash, by its top bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _by_part(parts: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted ``parts``."""
    ends = np.searchsorted(parts, np.arange(count + 1))
    for p in range(count):
        if ends[p + 1] > ends[p]:
            yield p, slice(ends[p], ends[p + 1])


def _probes(chunk: _Chunk, block: int, count: int, number: int) -> Iterator[tuple]:
    """Rows (part, chunk, block hashes, their positions, block hashes hit twice here, other hashes)."""
    h, at = chunk.starts(block)
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    head = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(head)
    twice = np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h))))
    aligned = chunk.within(at) % block == 0
    others = h[first[~np.logical_or.reduceat(aligned, first)]]
    key, at, twice = h[aligned], at[aligned], twice[aligned]
    low = np.uint64(0xFFFFFFFF)
    index, rest = dict(_by_part(_parts(key, count), count)), dict(_by_part(_parts(others, count), count))
    for p in sorted({*index, *rest}):
        i, r = index.get(p, slice(0, 0)), rest.get(p, slice(0, 0))
        yield p, number, (key[i] & low).astype(np.uint32).tobytes(), at[i].astype(np.uint32).tobytes(), np.packbits(twice[i]).tobytes(), (others[r] & low).astype(np.uint32).tobytes()


def _hit(group: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Rows (chunk, positions of its blocks that some other position hits)."""
    raw = {c: group.column(c).to_pylist() for c in ("chunk", "blocks", "at", "twice", "others")}
    blocks = [np.frombuffer(x, np.uint32) for x in raw["blocks"]]
    # a chunk's distinct hashes; one that two chunks have is hit from elsewhere
    sent = [np.unique(np.concatenate([b, np.frombuffer(o, np.uint32)])) for b, o in zip(blocks, raw["others"])]
    hashes, times = np.unique(np.concatenate(sent), return_counts=True) if sent else (np.zeros(0, np.uint32), np.zeros(0, int))
    common = hashes[times > 1]
    for i, b in enumerate(blocks):
        if len(b):
            near = np.minimum(np.searchsorted(common, b), max(0, len(common) - 1))
            hit = common[near] == b if len(common) else np.zeros(len(b), bool)
            hit |= np.unpackbits(np.frombuffer(raw["twice"][i], np.uint8), count=len(b)).astype(bool)
            if hit.any():
                yield raw["chunk"][i], np.frombuffer(raw["at"][i], np.uint32)[hit].tobytes()


def _candidates(chunk: _Chunk, anchors: list[bytes], window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and first words of the windows whose blocks are all anchors, sorted by these, and which of them are the first of their kind."""
    h, at = chunk.starts(window)
    anchored = np.zeros(int(chunk.words.offsets[-1]) + 1, bool)
    for x in anchors:
        anchored[np.frombuffer(x, np.uint32)] = True
    inside = chunk.within(at)
    keep = np.ones(len(at), bool)
    # the blocks inside a window start at the first multiple of the block length, and so on
    first = at + (-inside) % block
    for k in range(0, window - block + 1, block):
        start = first + k
        keep &= (start + block > at + window) | anchored[np.minimum(start, len(anchored) - 1)]
    h, at = h[keep], at[keep]
    check = chunk.words.checks(window, at) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((check, h))  # stable, so places stay in order
    h, check, at = h[order], check[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    return h, check, at, first


def _occurrences(chunk: _Chunk, anchors: list[bytes], window: int, block: int, count: int, number: int) -> Iterator[tuple]:
    """Rows (part, chunk, window hashes, other hashes, their first positions here, null ids, places of ids): each distinct window once, at its first place."""
    h, checks, at, first = _candidates(chunk, anchors, window, block)
    h, checks, at = h[first], checks[first], at[first]
    row = np.searchsorted(chunk.words.offsets, at, "right") - 1
    null = np.array([x is None for x in chunk.ids], bool)[row] if len(row) else np.zeros(0, bool)
    ids = np.array(chunk.places, np.int64)[row] if len(row) else np.zeros(0, np.int64)
    for p, s in _by_part(_parts(h, count), count):
        yield p, number, h[s].tobytes(), checks[s].tobytes(), at[s].astype(np.uint32).tobytes(), np.packbits(null[s]).tobytes(), ids[s].tobytes()


def _later(group: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Rows (chunk, first positions there of windows that start earlier in another chunk)."""
    raw = {c: group.column(c).to_pylist() for c in ("chunk", "windows", "checks", "at", "nulls", "ids")}
    h = [np.frombuffer(x, np.uint64) for x in raw["windows"]]
    if not h:
        return
    owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
    h, check, at = np.concatenate(h), *(np.concatenate([np.frombuffer(x, kind) for x in raw[c]]) for c, kind in (("checks", np.uint64), ("at", np.uint32)))
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in raw["ids"]])
    null = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(i) // 8) for x, i in zip(raw["nulls"], raw["ids"])])
    # equal ids, and equal digests of rows without one, are in one chunk, so they decide between chunks
    order = np.lexsort((ids, null, check, h))
    late = np.zeros(len(h), bool)
    late[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    at, owner = at[late], owner[late]
    for i in np.unique(owner):
        yield raw["chunk"][i], at[owner == i].tobytes()


def _covered(chunk: _Chunk, anchors: list[bytes], late: list[bytes], window: int, block: int) -> np.ndarray:
    """Which words of the chunk a repeated window covers."""
    _, _, at, first = _candidates(chunk, anchors, window, block)
    total = int(chunk.words.offsets[-1])
    repeated = np.zeros(total + 1, bool)
    repeated[at] = True
    repeated[at[first]] = False  # earliest here ...
    for x in late:
        repeated[np.frombuffer(x, np.uint32)] = True  # ... but not everywhere
    starts = np.flatnonzero(repeated)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:total] > 0


def _table(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans (and ``kept``, the words that stay joined by one space).

    Removed is every word covered by a window of ``window`` words whose sequence
    also starts earlier: in a smaller id, or earlier in the same document. ``spans``
    are the maximal removed stretches as (first word, words). Ids are whole numbers
    (a string that is none raises). Rows that share an id come in order of their text;
    rows without one come after all others, in order of the text's xxhash64. A null text has
    no words, and a document of fewer than ``window`` words loses none. Other columns
    are ignored. An empty table gives no rows.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it lies")
    spark = df.sparkSession
    docs = df.select(column(df, id_column).cast("long").alias("doc_id"), text_column(df, text).alias("text"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.xxhash64("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions(spark)
    chunks, count = max(tasks, -(-size // CHUNK_BYTES)), max(tasks, -(-size // PART_BYTES))
    # the exchange below is the same in all three passes, so it runs once
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("place"), F.lit(chunks))).repartition(min(chunks, 4 * max(tasks, count)), "chunk")

    binary, i32, i64 = pa.binary(), pa.int32(), pa.int64()
    probe_names, probe_types = ["part", "chunk", "blocks", "at", "twice", "others"], [i64, i64, binary, binary, binary, binary]
    window_names, window_types = ["part", "chunk", "windows", "checks", "at", "nulls", "ids"], [i64, i64, binary, binary, binary, binary, binary]
    hit_names, hit_types = ["chunk", "at"], [i64, binary]

    def probe(group: pa.Table) -> pa.Table:
        return _table(_probes(_Chunk(group), block, count, group.column("chunk")[0].as_py()), probe_names, probe_types)

    def hit(group: pa.Table) -> pa.Table:
        return _table(_hit(group), hit_names, hit_types)

    def extend(group: pa.Table, anchors: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table(iter(()), window_names, window_types)
        return _table(_occurrences(_Chunk(group), anchors.column("at").to_pylist(), window, block, count, group.column("chunk")[0].as_py()), window_names, window_types)

    def later(group: pa.Table) -> pa.Table:
        return _table(_later(group), hit_names, hit_types)

    def cut(group: pa.Table, found: pa.Table) -> pa.Table:
        kinds = found.column("kind").to_pylist()
        places = found.column("at").to_pylist()
        chunk = _Chunk(group)
        w = chunk.words
        gone = _covered(chunk, [x for x, k in zip(places, kinds) if not k], [x for x, k in zip(places, kinds) if k], window, block)
        data = w.data.tobytes()
        out = []
        for i, doc in enumerate(chunk.ids):
            a, b = w.offsets[i], w.offsets[i + 1]
            lost = gone[a:b]
            kept = b" ".join([data[s:e] for s, e in zip(w.starts[a:b][~lost].tolist(), w.ends[a:b][~lost].tolist())])
            edges = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0))
            spans = [{"start": s, "words": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
            out.append((doc, int(b - a), int(lost.sum()), hashlib.sha256(kept).hexdigest(), spans, *([kept.decode()] if texts else [])))
        return _table(iter(out), ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 5 + texts], [i64, i64, i64, pa.string(), pa.list_(pa.struct([("start", i64), ("words", i64)])), pa.string()])

    blocks = dealt.groupBy("chunk").applyInArrow(probe, "part long, chunk long, blocks binary, at binary, twice binary, others binary")
    anchors = blocks.groupBy("part").applyInArrow(hit, "chunk long, at binary")
    windows = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, "part long, chunk long, windows binary, checks binary, at binary, nulls binary, ids binary")
    repeats = windows.groupBy("part").applyInArrow(later, "chunk long, at binary")
    found = anchors.withColumn("kind", F.lit(0)).unionByName(repeats.withColumn("kind", F.lit(1)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, words: long>>" + ", kept string" * texts
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("spans")
