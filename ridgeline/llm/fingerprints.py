"""Fingerprints by a randomised edit embedding, and the near copies that they show.

All texts are walked with the same random walk: at step j the walk stands on a
character and, by a random bit for (j, character) that all texts share, stays or moves
on. The characters that it stands on are the embedding, about twice as long as the
text. After an edit two walks drift and soon meet again, so texts at a small edit
distance have embeddings at a small Hamming distance. A walk runs to the end of its
text, whatever its length.

The fingerprint samples the embedding: 256 steps, each reported as four bits of the
character there. A sample's step is the one of least random rank among all steps of
the walk, so that texts of different length mostly sample the same steps. Bands of
samples bring near copies into one bucket, and pairs are verified on whole fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import near_dedup
from .common import checkpoint, column, free_name, map_batches, marked, partitions, table, text_column, with_arrow_column

#: Samples of a fingerprint, a hexadecimal digit each.
SAMPLES = 256

#: Steps after which the walk's random bits repeat (a power of two), and classes of characters that share them.
PERIOD, CLASSES = 4096, 256

#: Likeness of near copies, and the probability that a pair at it shares a band.
THRESHOLD, RECALL = 0.8, 0.9999

#: Characters walked together, about, and texts under which they are walked one by one.
WALKED, FEW = 2_000_000, 48

#: Bytes of text of one range of the order, about.
RANGE_BYTES = 32_000_000

_SEED = 20250917
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Walks:
    """The random tables that all texts share."""

    def __init__(self, samples: int = SAMPLES, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        # a walk that comes to a character of a class at a step stays there for so many steps
        self.moves = rng.integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8).astype(bool)
        stay = np.zeros((2 * PERIOD, CLASSES), np.int32)
        stay[-1] = 1
        for j in range(2 * PERIOD - 2, -1, -1):
            stay[j] = np.where(self.moves[j % PERIOD], 1, stay[j + 1] + 1)
        self.stay = np.ascontiguousarray(stay[:PERIOD]).ravel()
        self.stay_lists = None
        self.factors = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        # of each sample: the steps whose rank is less than that of all before
        self.records = []
        for k in range(samples):
            own, at, steps = np.random.default_rng([seed, k]), 0, [0]
            least = own.random()
            while at < 1 << 40:
                at += int(own.geometric(least)) if least > 1e-15 else 1 << 41
                steps.append(at)
                least *= own.random()
            self.records.append(np.array(steps[:-1], np.int64))

    def one_by_one(self, classes: np.ndarray, step: int, out: np.ndarray) -> int:
        """Steps at which the walk comes to each of the characters; the step after the last."""
        if self.stay_lists is None:
            self.stay_lists = self.stay.reshape(PERIOD, CLASSES).tolist()
        table_, mask, steps = self.stay_lists, PERIOD - 1, []
        for c in classes.tolist():
            steps.append(step)
            step += table_[step & mask][c]
        out[:] = steps
        return step

    def steps(self, classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step at which the walk of each text comes to each of its characters, and the length of each walk."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        out, total = np.zeros(len(classes), np.int32), np.zeros(len(lengths), np.int64)
        at, step, i = offsets[:-1][order].copy(), np.zeros(len(order), np.int64), 0
        # active texts are the longest ones; how many are longer than i
        longer = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0)) + 1), "left")
        mask = np.int64(PERIOD - 1)
        n = int(longer[0]) if len(longer) else 0
        while n > FEW:
            a, s = at[:n], step[:n]
            out[a] = s
            s += self.stay[((s & mask) << 8) | classes[a]]
            a += 1
            i += 1
            n = int(longer[i]) if i < len(longer) else 0
        total[order] = step
        for d in order[:n]:
            low, high = int(offsets[d]) + i, int(offsets[d + 1])
            total[d] = self.one_by_one(classes[low:high], int(total[d]), out[low:high])
        return out, total

    def fingerprints(self, texts: list[str]) -> list[str]:
        """The fingerprint of each text; that of an empty one is all zeros."""
        out: list[str] = []
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= WALKED or i + 1 == len(texts):
                out += self._some(texts[first : i + 1])
                first, size = i + 1, 0
        return out

    def _some(self, texts: list[str]) -> list[str]:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        classes = ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        steps, total = self.steps(classes, offsets)
        digits = np.zeros((len(texts), len(self.records)), np.uint8)
        full = np.flatnonzero(total)
        wanted = np.stack([r[np.searchsorted(r, total[full], "left") - 1] for r in self.records], axis=1) if len(full) else None
        for row, d in enumerate(full):
            low = int(offsets[d])
            at = low + np.searchsorted(steps[low : int(offsets[d + 1])], wanted[row], "right") - 1
            digits[d] = (_mixed(points[at].astype(np.uint64) * self.factors) >> np.uint64(60)).astype(np.uint8)
        flat = _DIGITS[digits].tobytes().decode()
        n = len(self.records)
        return [flat[i * n : (i + 1) * n] for i in range(len(texts))]


def likeness(a: str, b: str) -> float:
    """The share of steps with equal characters, from 0 to 1, as two fingerprints show it: digits agree by chance in one of 16."""
    if not a:
        return 1.0
    agree = sum(map(str.__eq__, a, b)) / len(a)
    return max(0.0, (agree - 1 / 16) / (15 / 16))


def fingerprinted(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with one more column, the fingerprint of ``text`` (null: empty)."""
    place, walks = len(df.columns), Walks()
    full = df.withColumn(free_name(df, "text"), text_column(df, text))
    out = with_arrow_column(full, free_name(full, name), StringType(), lambda batch: pa.array(walks.fingerprints(batch.column(place).to_pylist()), pa.string()))
    return out.drop(full.columns[-1])


def _order(df: DataFrame, id_column: str, text: str) -> Column:
    """A string that sorts rows by descending id, null last, then by digest of the text."""
    number = column(df, id_column).cast("long")
    falling = F.lpad(F.hex(F.expr("-9223372036854775808L").bitwiseXOR(F.bitwise_not(number))), 16, "0")
    return F.concat(F.when(number.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), falling)), F.md5(text_column(df, text)))


def with_next(df: DataFrame, id_column: str, text: str, run, schema: str) -> DataFrame:
    """``run`` over pairs (id, text, next text) in the order of :func:`_order`, after whose last row the first is next.

    The order is cut into ranges of bounded size, of which only the first keys reach the driver.
    A row that is first in its range is copied to the end of the range before, so each range
    has all it needs and texts are shuffled once.
    """
    spark = df.sparkSession
    rows = df.select(column(df, id_column).cast("long").alias("doc_id"), text_column(df, text).alias("text"), _order(df, id_column, text).alias("key"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(partitions(spark), -(-size // RANGE_BYTES))
    ranges = rows.select("key").repartitionByRange(count, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first"))
    heads = sorted(r["first"] for r in ranges.collect())  # a key a range

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array) -> pa.Array:
        out = []
        for key in keys.to_pylist():
            at = bisect_right(heads, key) - 1
            out.append([at, (at - 1) % len(heads)] if key == heads[at] else [at])
        return pa.array(out, pa.list_(pa.int32()))

    placed = rows.withColumn("at", places("key")).select("doc_id", "text", "key", F.posexplode("at").alias("copy", "range"))
    sorted_ = placed.repartition(count, "range").sortWithinPartitions("range", "copy", "key").select("doc_id", "text", "range", "copy")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            before = None  # a row whose next one isn't known yet
            for batch in batches:
                for doc, t, at, copy in zip(*[c.to_pylist() for c in batch.columns]):
                    if before is not None and before[2] == at:
                        yield before[0], before[1], t
                    before = None if copy else (doc, t, at)

        yield from run(pairs())

    return map_batches(sorted_, each, schema)


def with_edited(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next row's text, by descending id (null last, ties by digest of
    the text); after the last row comes the first. ``near_edited`` and ``near_next`` are the likeness of
    the row's fingerprint to those of the edited and of the next text. Null texts are
    empty; a text of no characters has a fingerprint of zeros; a single row is next to
    itself. Ids are whole numbers. Other columns are ignored; an empty table gives no rows.
    """
    walks = Walks()

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        def written(rows: list[tuple]) -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in rows]
            # a row's next text is mostly the next row's own
            follows = [i + 1 < len(rows) and rows[i + 1][1] == after for i, (_, _, after) in enumerate(rows)]
            others = [i for i, x in enumerate(follows) if not x]
            made = walks.fingerprints([t for _, t, _ in rows] + edited + [rows[i][2] for i in others])
            n = len(rows)
            own, changed, rest = made[:n], made[n : 2 * n], dict(zip(others, made[2 * n :]))
            after = [own[i + 1] if x else rest[i] for i, x in enumerate(follows)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(own), pa.array(changed), pa.array(list(map(likeness, own, changed)), pa.float64()), pa.array(list(map(likeness, own, after)), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        rows, size = [], 0
        for x in pairs:
            rows.append(x)
            size += len(x[1])
            if size >= WALKED:
                yield written(rows)
                rows, size = [], 0
        if rows:
            yield written(rows)

    return with_next(df, id_column, text, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark, key (digest of the text), n, fingerprint and band hashes of (doc_id, mark, text)."""
    walks = Walks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found, keys = walks.fingerprints(texts), [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            banded = [[int.from_bytes(hashlib.blake2b(f"{b}:{f[b * rows : (b + 1) * rows]}".encode(), digest_size=8).digest(), "big", signed=True) for b in range(bands)] for f in found]
            sizes = pa.array([SAMPLES if t else 0 for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), sizes, pa.array(found, pa.string()), pa.array(banded, pa.list_(pa.int64()))], names=["doc_id", "mark", "key", "n", "fingerprint", "bands"])

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark binary, key binary, n int, fingerprint string, bands array<long>")


def near_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_of, n_links, as :func:`near_dedup.near_duplicates` has them, by likeness of fingerprints.

    Equal texts are copies. Links join texts whose fingerprints have a likeness of ``threshold``
    or more; a pair at it shares a band of samples with probability ``recall`` (for digits
    that agree independently). Empty and null texts link to nothing; rows that share an id
    are judged apart; other columns are ignored; an empty table gives no rows.
    """
    agree = threshold * 15 / 16 + 1 / 16
    bands, rows = near_dedup.bands_for(agree, recall, SAMPLES)
    docs = df.select(column(df, id_column).alias("doc_id"), marked(df, id_column, text).alias("mark"), text_column(df, text).alias("text"))
    signed = checkpoint(_signed(docs, bands, rows))
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    classes = signed.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(rep).alias("rep"), *[F.first(c).alias(c) for c in ("n", "fingerprint", "bands")])
    classes = checkpoint(classes.withColumn("mark", F.col("rep.mark")))
    # a sample and its digit as one element: agreement of fingerprints is similarity of sets
    digits = F.transform(F.sequence(F.lit(1), F.lit(SAMPLES)), lambda i: i.cast("long") * 16 + F.conv(F.substring(F.col("fingerprint"), i, F.lit(1)), 16, 10).cast("long"))
    sets = classes.select("key", digits.alias("grams"))
    jaccard = agree / (2 - agree)
    _, labels, read = near_dedup.links(classes.drop("fingerprint"), lambda wanted: checkpoint(sets.join(wanted.select("key"), "key")), jaccard)
    return near_dedup.classified(signed, classes, near_dedup.link_counts(classes, labels, read, jaccard), labels).select("doc_id", "class_id", "copy_of", "n_links")


def op13(spark, sf_dir: str) -> DataFrame:
    return with_edited(table(spark, sf_dir, "documents"))
