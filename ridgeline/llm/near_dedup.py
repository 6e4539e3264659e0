"""Joining documents whose word n-gram sets have a Jaccard similarity over a threshold.

Signatures: the distinct n-gram hashes of a text give MinHash values, banded so
that pairs at the threshold share a band with the wanted recall. Texts with the
same n-gram set are one class from here on, so copies cost one row.

Band hashes are shuffled. A bucket is never compared with itself. Each class is
first compared, on full n-gram sets, with the most central class of a bucket it is
in: a star, so a group of any size costs a comparison per member. Verified links
make components, and only members of a bucket that are then in different ones are
compared with each other: inside the join, which lets nothing but links out.

A large bucket that holds many such members, as texts around one long passage do, isn't
compared pair by pair. Two sets with the similarity share one of the rarest n-grams of
each, the prefix that the threshold allows to differ and one more; so members of large
buckets meet on the n-grams of their prefixes, in which a common passage isn't. That
loses no pair, whatever the order of n-grams; a sketch of their counts gives the order.
Where sets are so alike that this meets no fewer pairs, buckets stay as they are.
Buckets, representatives and copies that are frequent are dealt over several tasks.

Links are counted whole: pairs that share no band meet on the rarest n-grams of all
texts if they are in different components still, and then all pairs of a component are
compared, a block of members with a block at a time. Only counts leave a block.
Edited copies of one text share n-grams with all others of them. Where many sets
meet on an n-gram, a sketch of each tells most pairs under the threshold inside the join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import text as words
from .common import checkpoint, column, frequent_limit, is_sortable, join_frequent, let_go, map_batches, marked, table, text_column

SIZE, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128

#: A bucket with more open members than this is joined on rare n-grams, if that meets fewer pairs by this factor.
LARGE, FEWER = 10_000, 4

#: How far below the threshold a pair may be to be verified on full sets, where half of each hash was compared.
SLACK = 0.01

#: Counters of the sketch of n-gram counts at most, 8 bytes each (a power of two).
SLOTS = 1 << 20

#: Members and n-grams of a block at most (one larger set is a block); two blocks of a component are compared at once.
BLOCK, BLOCK_GRAMS = 256, 1 << 18

#: Columns of a block's matrix at once, and counters in a row of the sketch of all texts.
COLUMNS, ROW = 2048, 4096

#: With more sets than this on an n-gram, pairs are told by sketches too. A sketch has 64-bit words by its set's size, these at least and at most (powers of two).
CROWD, LEAST_WORDS, MOST_WORDS = 32, 4, 64

#: So many classes, 40 bytes each, are broadcast to find their texts.
BROADCAST_ROWS = 100_000


def bands_for(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands that reach ``recall`` at ``threshold`` take ``most`` hashes or fewer."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def hash_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def min_hashes(grams: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    factor, flip = seeds
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        h = grams[i : i + 4096, None] ^ flip
        h *= factor
        np.minimum(least, h.min(axis=0), out=least)
    return least


def gram_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words has its words as one gram, one without words none."""
    w = words.Words(texts)
    hashes, at = w.windows(size)
    cuts = np.searchsorted(at, w.offsets)
    for i in range(len(w.counts)):
        if 0 < w.counts[i] < size:
            own = w.hashes[w.offsets[i] : w.offsets[i + 1]]
            yield words.window_hashes(own, len(own))
        else:
            yield np.unique(hashes[cuts[i] : cuts[i + 1]])


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    """Bits that say of how many n-grams each is the parity: two sketches differ in no more bits than their sets do in n-grams.

    Two bits or more for an n-gram, up to MOST_WORDS words. The halves of a sketch, xor-ed, are the sketch of half the width.
    """
    n = min(max(LEAST_WORDS, 1 << (2 * len(grams) - 1).bit_length() >> 6), MOST_WORDS) * 64
    parity = np.bincount((grams & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def sketches_allow(a: str, b: str, n: str, m: str, threshold: float) -> Column:
    """Whether two sets of ``n`` and ``m`` n-grams may have the similarity, by their sketches; true where their widths differ more than twofold."""

    def halved(c: str) -> Column:
        half = F.shiftright(F.size(c), 1)
        return F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    left = F.when(F.size(a) > F.size(b), halved(a)).otherwise(F.col(a))
    right = F.when(F.size(b) > F.size(a), halved(b)).otherwise(F.col(b))
    differ = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return F.coalesce(differ * (1 + threshold) <= (1 - threshold) * (F.col(n) + F.col(m)) + 1e-5, F.lit(True))


def signatures(docs: DataFrame, size: int, bands: int, rows: int, sketched: bool = False) -> DataFrame:
    """doc_id, mark, key (of the n-gram set), n and band hashes of (doc_id, mark, text), and a sketch of the set if ``sketched``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark binary, key binary, n int, bands array<long>" + ", sketch array<long>" * sketched
    salt = (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = hash_seeds(bands * rows)
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                keys, counts, banded, sketches = [], [], np.zeros((part.num_rows, bands), np.uint64), []
                for i, grams in enumerate(gram_sets(part.column(2), size)):
                    keys.append(set_key(grams))
                    counts.append(len(grams))
                    if sketched:
                        sketches.append(parity_sketch(grams))
                    if len(grams):
                        h = words.mix(min_hashes(grams, seeds).reshape(bands, rows) + salt)
                        banded[i] = words.window_hashes(h.ravel(), rows)[::rows]
                flat = pa.ListArray.from_arrays(np.arange(0, (part.num_rows + 1) * bands, bands, dtype=np.int32), pa.array(banded.view(np.int64).ravel()))
                columns = {"doc_id": part.column(0), "mark": part.column(1), "key": pa.array(keys, pa.binary()), "n": pa.array(counts, pa.int32()), "bands": flat}
                if sketched:
                    at = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
                    columns["sketch"] = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_batches(docs, run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, grams): the n-gram sets of the classes ``wanted`` (mark, key, copies), from the texts of ``docs`` (mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                found = list(gram_sets(part.column(0), size))
                same = [set_key(s) == k for s, k in zip(found, part.column(1).to_pylist())]  # marks are hashes
                found = [s for s, x in zip(found, same) if x]
                at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(same, pa.bool_())), pa.ListArray.from_arrays(at, pa.array(flat))], names=["key", "grams"])

    if wanted.count() <= BROADCAST_ROWS:
        texts = docs.join(F.broadcast(wanted.select("mark", "key")), "mark")
    else:
        texts = join_frequent(docs, wanted, ["mark"], "copies")
    # rows that repeat have one mark; they meet before they are shuffled
    return checkpoint(map_batches(texts.select("text", "key"), run, "key binary, grams array<long>").groupBy("key").agg(F.first("grams").alias("grams")))


def similar(a: str, b: str, threshold: float) -> Column:
    """Whether two arrays of distinct n-grams have the similarity."""
    common = F.size(F.array_intersect(a, b))
    return common >= threshold * (F.size(a) + F.size(b) - common) - 1e-6


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full n-gram sets are similar. Many pairs may have the same ``a``."""
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(sets.withColumnsRenamed({"key": "a", "grams": "ga"}), "a")
    members = pairs.join(sets.withColumnsRenamed({"key": "b", "grams": "gb"}), "b")
    met = join_frequent(members, checkpoint(heads), ["a"], "pairs")
    return checkpoint(met.where(similar("ga", "gb", threshold)).select("a", "b"))


def _size_allows(a: str, b: str, threshold: float) -> Column:
    """Sets of too different sizes can't be similar."""
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-6


def star_pairs(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The bucket rows (bucket, key) of buckets with more than one class, and pairs (a, b): each class with one other at most.

    Of the most central classes of the buckets that a class is in, ``a`` is the one that it shares most of these with.
    """
    members = classes.select("key", "n", F.explode("bands").alias("bucket"))
    sizes = checkpoint(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    shared = checkpoint(join_frequent(members, sizes, ["bucket"], "m"))
    # the class whose buckets are the largest is the most central one: more of the others are similar to it than to any at random
    scores = shared.groupBy("key").agg(F.sum("m").alias("score"))
    heads = shared.join(scores, "key").groupBy("bucket").agg(F.first("m").alias("m"), F.max(F.struct("score", "key", "n")).alias("head"))
    met = join_frequent(shared.drop("m"), checkpoint(heads), ["bucket"], "m")
    ends = met.where(F.col("key") != F.col("head.key")).groupBy("key", "n", "head").agg(F.count(F.lit(1)).alias("shared"))
    first = ends.groupBy("key", "n").agg(F.max(F.struct("shared", "head")).alias("best"))
    pairs = checkpoint(first.where(_size_allows("n", "best.head.n", threshold)).select(F.col("best.head.key").alias("a"), F.col("key").alias("b")))
    return shared.select("bucket", "key"), pairs


def rest_links(classes: DataFrame, buckets: DataFrame, pairs: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between classes in one bucket but in different components.

    Members outside a bucket's largest component meet all of other components. The join
    itself compares sets, each pair in the first bucket that it shares, so hardly more than
    links leave it; it does so with half of each hash and a little below the threshold, which halves what a
    bucket's rows take, and what passes is verified on full sets. A bucket of two classes
    that ``pairs`` has is done; large ones go through :func:`rare_pairs`.
    """
    named = checkpoint(buckets.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("label")))
    split = open_buckets(named, "bucket")
    done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.lit(2).cast("long").alias("m"))
    split = checkpoint(split.join(done, ["low", "high", "m"], "left_anti"))
    large, found = split.where(F.col("apart") > LARGE), []
    if meets := large.agg(F.sum(F.col("apart") * F.col("m"))).first()[0]:
        members = join_frequent(named, large.select("bucket", "m"), ["bucket"], "m").select("key", "label").distinct()
        rare = rare_pairs(checkpoint(members.join(sets, "key")), threshold, meets / FEWER)
        if rare is not None:
            found.append(verified(rare, sets, threshold))
            split = split.where(F.col("apart") <= LARGE)
    split = split.select("bucket", "m", "top")
    halves = F.array_distinct(F.transform("grams", lambda g: g.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    open_ = join_frequent(named, split, ["bucket"], "m").join(classes.select("key", "n", "bands"), "key").join(sets.select("key", halves.alias("grams")), "key")
    open_ = checkpoint(open_)
    del named
    let_go(open_.sparkSession)
    probes = open_.where("label <> top").select("bucket", "m", "top", *[F.col(c).alias(f"p_{c}") for c in ("key", "label", "n", "bands", "grams")])
    meet = join_frequent(open_.drop("m", "top"), probes, ["bucket"], "m", limit=frequent_limit(split, "m"))
    other = (F.col("label") != F.col("p_label")) & ((F.col("label") == F.col("top")) | (F.col("key") < F.col("p_key")))
    here = F.array_min(F.array_intersect("bands", "p_bands")) == F.col("bucket")
    close = meet.where(other & _size_allows("n", "p_n", threshold) & here & similar("grams", "p_grams", threshold - SLACK))
    found.append(verified(checkpoint(close.select(F.col("key").alias("a"), F.col("p_key").alias("b"))), sets, threshold))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def open_buckets(named: DataFrame, bucket: str) -> DataFrame:
    """(bucket, m, apart, top, low, high) of the buckets of ``named`` (bucket, key, label) with members in several components.

    ``top`` is the largest component, ``apart`` how many members are in others, low and high the least and greatest key.
    """
    by_label = named.groupBy(bucket, "label").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("low"), F.max("key").alias("high"))
    split = by_label.groupBy(bucket).agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"), F.min("low").alias("low"), F.max("high").alias("high"))
    return split.where("top.c < m").select(bucket, "m", (F.col("m") - F.col("top.c")).alias("apart"), F.col("top.label").alias("top"), "low", "high")


def gram_counts(sets: DataFrame) -> np.ndarray:
    """A sketch: counts of the n-grams of ``sets`` by their hash modulo its length, SLOTS at most."""
    total = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    slots = min(SLOTS, 1 << max(10, int(2 * total).bit_length()))
    counted = sets.select(F.explode("grams").alias("g")).groupBy(F.pmod("g", F.lit(slots)).alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return out


def text_gram_counts(docs: DataFrame, size: int) -> np.ndarray:
    """The same sketch, of the n-gram sets of all ``docs`` (text): each task counts what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                grams = np.concatenate([np.zeros(0, np.uint64), *gram_sets(part.column(0), size)])
                counts += np.bincount((grams % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        rows = counts.reshape(-1, min(ROW, SLOTS))
        for at in np.flatnonzero(rows.any(axis=1)):
            slots = np.flatnonzero(rows[at])
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([slots.astype(np.uint16).tobytes()]), pa.array([rows[at, slots].astype(np.uint32).tobytes()])], names=["at", "slots", "counts"])

    def total(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros(min(ROW, SLOTS), np.int64)
        for slots, counts in zip(group["slots"].to_pylist(), group["counts"].to_pylist()):
            out[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.uint32)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out.tobytes()])})

    summed = map_batches(docs.select("text"), run, "at int, slots binary, counts binary").groupBy("at").applyInArrow(total, "at int, counts binary").toArrow()
    out = np.zeros((SLOTS // min(ROW, SLOTS), min(ROW, SLOTS)), np.int64)
    for at, counts in zip(summed["at"].to_pylist(), summed["counts"].to_pylist()):
        out[at] = np.frombuffer(counts, np.int64)
    return out.ravel()


def rarest(grams: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The n-grams of a set, by rarity, of which any similar set has one."""
    first = len(grams) - math.ceil(threshold * len(grams) - 1e-6) + 1
    return grams[np.lexsort((grams, counts[grams % len(counts)]))[:first]]


def shared_grams(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(id, gram, place, n): the rarest n-grams of each set of ``docs`` (text), by place, that are among the rarest of another.

    An id is the first seven bytes of a set's key. Rows are sorted by n-gram and read as a stream, so a frequent one needs no memory.
    """
    counts = docs.sparkSession.sparkContext.broadcast(text_gram_counts(docs, size))
    names, schema = ["id", "gram", "place", "n"], "id long, gram long, place int, n int"

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                found: dict[int, tuple[np.ndarray, int]] = {}
                for own in gram_sets(part.column(0), size):
                    if len(own) and (i := int.from_bytes(set_key(own)[:7], "big")) not in found:
                        found[i] = rarest(own.view(np.int64), counts.value, threshold), len(own)
                lengths = [len(g) for g, _ in found.values()]
                grams = np.concatenate([np.zeros(0, np.int64), *[g for g, _ in found.values()]])
                places = np.concatenate([np.zeros(0, np.int32), *[np.arange(k, dtype=np.int32) for k in lengths]])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(found), np.int64), lengths)), pa.array(grams), pa.array(places), pa.array(np.repeat(np.array([n for _, n in found.values()], np.int32), lengths))], names=names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)], False  # the last row, and whether another set before it has its n-gram
        for batch in batches:
            rows = [np.concatenate([a, c.to_numpy()]) for a, c in zip(last, batch.columns)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [c[new] for c in rows]
            same = rows[1][1:] == rows[1][:-1]
            before = np.concatenate([[met], same])[: len(rows[0])]
            keep = before[:-1] | same
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in rows], names=names)
            last, met = [c[-1:] for c in rows], bool(before[-1:].any())
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)

    return checkpoint(map_batches(map_batches(docs.select("text"), rare, schema).repartition("gram").sortWithinPartitions("gram", "id"), shared, schema))


def rare_pairs(members: DataFrame, threshold: float, most: float = math.inf) -> DataFrame | None:
    """Distinct pairs (a, b) of ``members`` (key, label, grams) with different labels that may have the similarity.

    Each set's n-grams are ordered by rarity; one of n may differ from another set in n - ceil(threshold n) of them,
    so it shares one of the first of its own with any similar set. Members of an n-gram's largest
    component don't meet each other. None if more than ``most`` pairs would meet.
    """
    counts = members.sparkSession.sparkContext.broadcast(gram_counts(members))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels = batch.column(0), batch.column(1)
            rows, grams, places, sizes = [], [], [], []
            for i, own in enumerate(batch.column(2)):
                g = rarest(own.values.to_numpy(), counts.value, threshold)
                rows.append(np.full(len(g), i))
                grams.append(g)
                places.append(np.arange(len(g), dtype=np.int32))
                sizes.append(np.full(len(g), len(own), np.int32))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
            yield pa.RecordBatch.from_arrays([keys.take(at), labels.take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])), pa.array(np.concatenate([np.zeros(0, np.int32), *places])), pa.array(np.concatenate([np.zeros(0, np.int32), *sizes]))], names=["key", "label", "gram", "place", "n"])

    kind = members.schema["key"].dataType.simpleString()
    return meeting(checkpoint(map_batches(members.select("key", "label", "grams"), rare, f"key {kind}, label {kind}, gram long, place int, n int")), threshold, most)


def meeting(first: DataFrame, threshold: float, most: float = math.inf, sketches: DataFrame | None = None) -> DataFrame | None:
    """The pairs of :func:`rare_pairs`, of the rarest n-grams ``first`` (key, label, gram, place, n).

    With ``sketches`` (key, sketch) of all sets, those that meet on an n-gram of more than CROWD sets are compared by these as well.
    """
    split = checkpoint(open_buckets(first, "gram").select("gram", "m", "apart", "top"))
    if (split.agg(F.sum(F.col("apart") * F.col("m"))).first()[0] or 0) > most:
        return None
    split = split.drop("apart")
    if sketches is None:
        found = met_pairs(join_frequent(first, split, ["gram"], "m"), threshold, frequent_limit(split, "m"))
    else:
        found = met_pairs(first.join(split.where(F.col("m") <= CROWD), "gram"), threshold, None)
        crowds = split.where(F.col("m") > CROWD)
        if not crowds.isEmpty():
            open_ = checkpoint(join_frequent(first, crowds, ["gram"], "m"))
            own = checkpoint(open_.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(sketches, "key"))
            open_ = checkpoint(join_frequent(open_, own, ["key"], "rows").drop("rows"))
            found = found.unionByName(met_pairs(open_, threshold, frequent_limit(crowds, "m")))
    met = found.groupBy(F.least("key", "p_key").alias("a"), F.greatest("key", "p_key").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.first(F.col("n") + F.col("p_n")).alias("both"), F.first(F.greatest("n", "p_n")).alias("most"))
    # of what they share, all but the grams that they met on comes after the rarest of one of them
    shared = F.col("met") + F.ceil(threshold * F.col("most") - 1e-6) - 1
    return checkpoint(met.where(shared * (1 + threshold) >= threshold * F.col("both") - 1e-6).select("a", "b"))


def met_pairs(open_: DataFrame, threshold: float, limit: int | None) -> DataFrame:
    """(key, n, p_key, p_n): pairs of ``open_`` (key, label, gram, place, n, m, top and perhaps sketch) that meet on an n-gram and may be similar, once for each.

    ``limit`` is the number of rows over which an n-gram is frequent.
    """
    own = [c for c in ("key", "label", "place", "n", "sketch") if c in open_.columns]
    probes = open_.where("label <> top").select("gram", "m", "top", *[F.col(c).alias(f"p_{c}") for c in own])
    meet = join_frequent(open_.drop("m", "top"), probes, ["gram"], "m", limit=limit)
    other = (F.col("label") != F.col("p_label")) & ((F.col("label") == F.col("top")) | (F.col("key") < F.col("p_key")))
    # what they can share from here on
    shared = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place")) + F.least("place", "p_place")
    enough = shared * (1 + threshold) >= threshold * (F.col("n") + F.col("p_n")) - 1e-6
    close = other & _size_allows("n", "p_n", threshold) & enough
    if "sketch" in own:
        close &= sketches_allow("sketch", "p_sketch", "n", "p_n", threshold)
    return meet.where(close).select("key", "n", "p_key", "p_n")


def links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links (a, b), the components (node, component) that they make of ``classes`` (key, copies, n, mark, bands), and the sets read.

    These are enough links to make the components, not all. ``sets_of`` gives the sets (key, grams) of some (key, mark, copies). First comes
    a star around the central classes, then what is still in different
    components. At the end two classes with a bucket in common are in one
    component or have a similarity under the threshold.
    """
    buckets, pairs = star_pairs(classes, threshold)
    wanted = checkpoint(buckets.select("key").distinct().join(classes.select("key", "mark", "copies"), "key"))
    sets = sets_of(wanted)
    del wanted
    let_go(sets.sparkSession)
    star = verified(pairs, sets, threshold)
    labels = components(star, "a", "b")
    more = rest_links(classes, buckets, pairs, labels, sets, threshold)
    if more.isEmpty():
        return star, labels, sets
    edges = star.unionByName(more)
    return edges, components(edges, "a", "b"), sets


def unbanded_links(docs: DataFrame, classes: DataFrame, edges: DataFrame, labels: DataFrame, sets: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The components (node, component) and the sets of :func:`links`, with those of similar classes that share no band too.

    No pair is lost: all classes that are in different components meet on their rarest n-grams. Those of them
    that share a band were compared by :func:`links`, so the sets of the others alone are read.
    """
    first = shared_grams(docs, size, threshold)
    let_go(docs.sparkSession)
    named = classes.select(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long").alias("id"), "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    own = checkpoint(first.groupBy("id").agg(F.count(F.lit(1)).alias("m")).join(named.select("id", "key", F.coalesce("component", "key").alias("label")), "id"))
    pairs = meeting(checkpoint(join_frequent(first, own, ["id"], "m").select("key", "label", "gram", "place", "n")), threshold, sketches=classes.select("key", "sketch"))
    for end in ("a", "b"):
        met = checkpoint(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("m")).join(classes.select(F.col("key").alias(end), F.col("bands").alias(f"{end}_bands")), end))
        pairs = join_frequent(pairs, met, [end], "m").drop("m")
    pairs = checkpoint(pairs.where(~F.arrays_overlap("a_bands", "b_bands")).select("a", "b"))
    del first, own, met
    let_go(docs.sparkSession)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = checkpoint(ends.join(sets.select("key"), "key", "left_anti").join(classes.select("key", "mark", "copies"), "key"))
    sets = sets.unionByName(full_sets(docs, wanted, size))
    let_go(docs.sparkSession)
    more = verified(pairs, sets, threshold)
    return (labels if more.isEmpty() else components(edges.unionByName(more), "a", "b")), sets


def common_grams(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many n-grams each set of ``left`` has in common with each of ``right``, or of ``left`` itself."""
    sides = [left] if right is None else [left, right]
    parts = [np.concatenate(side) for side in sides]
    rows = [np.repeat(np.arange(len(side)), [len(g) for g in side]) for side in sides]
    values, at = np.unique(np.concatenate(parts), return_inverse=True)
    ats = np.split(at, [len(parts[0])])[: len(sides)]
    several = np.bincount(ats[0], minlength=len(values)) > (right is None)
    if right is not None:
        several &= np.bincount(ats[1], minlength=len(values)) > 0
    place = np.cumsum(several) - 1
    out = np.zeros((len(left), len(sides[-1])), np.float64)
    rows, ats = [r[several[a]] for r, a in zip(rows, ats)], [place[a[several[a]]] for a in ats]
    for start in range(0, int(several.sum()), COLUMNS):
        marks = []
        for side, r, a in zip(sides, rows, ats):
            here = (a >= start) & (a < start + COLUMNS)
            marks.append(np.zeros((len(side), COLUMNS), np.float32))
            marks[-1][r[here], a[here] - start] = 1
        out += marks[0] @ marks[-1].T
    return out


def link_counts(classes: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, links): how many rows the other classes have that are similar to a class, of ``classes`` (key, copies, n) in components ``labels``.

    All pairs of a component are compared. A component is cut into blocks, by size of set and by hash, of which two
    meet in one group, unless their sizes differ too much; small components share groups.
    """
    width = -math.log(threshold) + 1e-5  # sizes of similar sets are in one bin or in neighbouring ones
    members = checkpoint(labels.withColumnRenamed("node", "key").join(classes.select("key", "copies", "n"), "key").withColumn("bin", F.floor(F.log("n") / width)))
    bins = members.groupBy("component", "bin").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
    parts = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("long")
    shape = checkpoint(bins.groupBy("component").agg(F.sum("m").alias("m"), F.sum("grams").alias("grams"), F.collect_list(F.struct("bin", parts.alias("parts"))).alias("bins")).withColumn("large", F.expr(f"m > {BLOCK} OR grams > {BLOCK_GRAMS}")))
    small = shape.where("NOT large").agg(F.sum("grams")).first()[0] or 0
    number = lambda b, p: b * (1 << 32) + p
    near = F.filter("bins", lambda x: F.abs(x["bin"] - F.col("bin")) <= 1)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda p: number(x["bin"], p))))
    own_parts = F.filter("bins", lambda x: x["bin"] == F.col("bin"))[0]["parts"]
    own = F.when(F.col("large"), number(F.col("bin"), F.pmod(F.xxhash64("key"), own_parts))).otherwise(F.lit(0).cast("long"))
    placed = join_frequent(members, shape, ["component"], "m").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.when(F.col("large"), others).otherwise(F.array(F.lit(0).cast("long")))))
    unit = [F.when(F.col("large"), F.col("component")).alias("unit"), F.when(F.col("large"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("component"), F.lit(-(-int(small) // BLOCK_GRAMS) or 1))).alias("slot")]
    placed = placed.select(*unit, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "key", "copies")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys, grams = group["key"].combine_chunks(), group["grams"].combine_chunks()
        flat, ends, starts = grams.values.to_numpy(), grams.offsets.to_numpy()[1:], grams.offsets.to_numpy()[:-1]
        copies, block = group["copies"].to_numpy(), group["own"].to_numpy()
        inside = group["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(inside, kind="stable")
        found = np.zeros(len(keys), np.int64)
        one = key[2].as_py() == key[3].as_py()
        for rows in np.split(order, np.flatnonzero(np.diff(inside[order])) + 1):
            left = rows if one else rows[block[rows] == key[2].as_py()]
            right = rows if one else rows[block[rows] == key[3].as_py()]
            if not len(left) or not len(right):
                continue
            common = common_grams([flat[starts[i] : ends[i]] for i in left], None if one else [flat[starts[i] : ends[i]] for i in right])
            sizes = (ends - starts)[left][:, None] + (ends - starts)[right]
            alike = common >= threshold * (sizes - common) - 1e-6
            if one:
                np.fill_diagonal(alike, False)
            else:
                found[right] += copies[left] @ alike
            found[left] += alike @ copies[right]
        return pa.table({"key": keys, "links": pa.array(found)})

    kind = classes.schema["key"].dataType.simpleString()
    met = placed.join(sets, "key").groupBy("unit", "slot", "i", "j").applyInArrow(run, f"key {kind}, links long")
    return checkpoint(met.groupBy("key").agg(F.sum("links").alias("links")))


def near_classes(docs: DataFrame, size: int, threshold: float, recall: float, count: bool) -> DataFrame:
    """doc_id, mark, class_id, copy_of, keep (doc_id and mark of the row that stands for the class), n_links and worded (whether it has a word) of ``docs`` (doc_id, mark, text).

    With ``count``, links are all there are, those without a common band too; else n_links has only the copies.
    """
    bands, rows = bands_for(threshold, recall)
    signed = checkpoint(signatures(docs, size, bands, rows, sketched=count))
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")  # ids before none
    classes = signed.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first("sketch").alias("sketch")] * count)
    classes = checkpoint(classes.withColumn("mark", F.col("rep.mark")))
    let_go(docs.sparkSession)
    edges, labels, sets = links(classes, lambda wanted: full_sets(docs.select("mark", "text"), wanted, size), threshold)
    linked = None
    if count:
        let_go(docs.sparkSession)
        labels, sets = unbanded_links(docs.select("mark", "text"), classes, edges, labels, sets, size, threshold)
        let_go(docs.sparkSession)
        linked = link_counts(classes, labels, sets, threshold)
    del edges, sets
    let_go(docs.sparkSession)
    return classified(signed, classes, linked, labels)


def classified(signed: DataFrame, classes: DataFrame, linked: DataFrame | None, labels: DataFrame) -> DataFrame:
    """What :func:`near_classes` returns, from rows (doc_id, mark, key, n), classes (key, copies, rep), rows linked to a class (key, links) and components."""

    named = classes.select("key", "copies", "rep").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("links", F.lit(0).cast("long")) if linked is None else named.join(linked, "key", "left")
    named = checkpoint(named.withColumn("component", F.coalesce("component", "key")))
    least = checkpoint(named.groupBy("component").agg(F.min("rep").alias("keep"), F.count(F.lit(1)).alias("classes")))
    known = checkpoint(join_frequent(named, least, ["component"], "classes").select("key", "copies", "keep", F.col("rep.doc_id").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    found = join_frequent(signed.where("n > 0").select("doc_id", "mark", "key"), known, ["key"], "copies")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    alone = signed.where("n = 0").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), own.alias("keep"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("worded"))
    return found.select("doc_id", "mark", F.col("keep.doc_id").alias("class_id"), "copy_of", "keep", "n_links", F.lit(True).alias("worded")).unionByName(alone)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_of, n_links.

    Rows with the same n-gram set are copies: ``copy_of`` is the smallest id among
    them. Links are verified similarities of ``threshold`` or more between such
    classes of copies; ``class_id`` is the smallest id that the row reaches over
    links. ``n_links`` counts all rows that are similar to the row, its other copies
    among them: no pair at the threshold or over it is left out, and no pair under
    it is ever linked. ``recall`` is the share of pairs at the threshold that bands
    find; pairs without one are found by their rarest n-grams, so it changes the
    cost alone. Texts without words (null
    ones too) link to nothing. Rows equal in text are linked even if they share an
    id; a null id is greater than any other. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = df.select(column(df, id_column).alias("doc_id"), marked(df, id_column, text).alias("mark"), text_column(df, text).alias("text"))
    return near_classes(docs, size, threshold, recall, count=True).select("doc_id", "class_id", "copy_of", "n_links")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` that stay, with all columns: one row of each class of :func:`near_duplicates`.

    Here classes are made of the pairs that share a band, with probability ``recall`` at the threshold.
    It is the row with the smallest id, then by a digest of id and text; a null id
    comes last. A row is told by its id and text together, so rows that share only an
    id are judged apart. Rows equal in both stay once, the one that sorts first by
    its other columns. Texts without words have no class: all their rows stay. An
    empty table gives no rows; columns of any name and type pass through.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    own = df.select(*[column(df, c).alias(n) for c, n in zip(df.columns, names)], marked(df, id_column, text).alias("mark"))
    docs = df.select(column(df, id_column).alias("doc_id"), marked(df, id_column, text).alias("mark"), text_column(df, text).alias("text"))
    found = near_classes(docs, size, threshold, recall, count=False)
    stay = checkpoint(found.where(F.col("keep.mark") == F.col("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("rows"), F.max("worded").alias("worded")))
    del found
    let_go(df.sparkSession)
    again = (F.col("rows") > 1) & F.col("worded")
    kept = join_frequent(own, stay, ["mark"], "rows")
    if stay.where(again).isEmpty():
        return kept.select(*names).toDF(*df.columns)
    first = kept.where(again).groupBy("mark").agg(F.min_by(F.struct(*names), F.struct(*[n for n, f in zip(names, df.schema) if is_sortable(f.dataType)])).alias("row"))
    return kept.where(~again).select(*names).unionByName(first.select("row.*")).toDF(*df.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
