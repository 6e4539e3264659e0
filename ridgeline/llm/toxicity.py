"""Severity of toxic language by cumulative-link (proportional-odds) regression.

``P(grade >= k) = sigmoid(x . w + b_k)`` with one weight vector for all
thresholds and falling ``b_k``; the expected severity is the sum of these over
``k``. Features are sparse: each distinct lower-case word of a text and its first
4, 5 and 6 bytes (up to a whole character), which catch inflected forms that the
training rows lack.

Labels say 0 or 1 only. The grade of a toxic training row is 1, 2 or 3 by tercile
of the score that a binary model of the other half of the rows gives it: how surely
toxic the text looks to a model that hasn't seen it. The model is fitted on at most ``sample`` labelled rows, the first by a hash of the id
(repeated texts once); every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as words
from .common import checkpoint, column, free_name, map_batches, table, text_column, with_arrow_column

SAMPLE = 20_000
FEATURES = 4096
GRADES = 3

#: A feature is one that toxic rows have this many times as often as others, with a likelihood ratio over that of p = 0.0001.
TIMES, SIGNIFICANT = 10, 15.14

#: Least number of toxic rows with a feature, ridge penalty, steps of the fit, smallest probability of being toxic.
LEAST, RIDGE, STEPS, DECISION = 3, 1e-3, 400, 0.3

PREFIXES = (4, 5, 6)

# letters to lower case, other ASCII characters but digits to spaces; bytes of other characters stay
_FOLD = np.array([c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)
_FOLD[0x41:0x5B] += 0x20


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, the row of each, and the number of words of each row."""
    data, offsets = words.column_bytes(texts)
    data = _FOLD[data]
    starts, ends, at = words.word_spans(data, offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashes, rows = [words.span_hashes(data, starts, ends)], [row]
    for k in PREFIXES:
        long = ends - starts >= k
        cut = starts[long] + k
        for _ in range(3):  # a character has three more bytes at most
            cut += (cut < ends[long]) & ((data[np.minimum(cut, len(data) - 1)] & 0xC0) == 0x80)
        h = words.span_hashes(data, starts[long], cut)
        hashes.append(h ^ np.uint64(0xA24BAED4963EE407 * k & (1 << 64) - 1))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows), np.diff(at)


class Lookup:
    """Places of hashes in a sorted array; a small table of bits turns most others away first."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[keys >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the feature and row of all hits."""
        maybe = self.bits[hashes >> np.uint64(64 - self.BITS)]
        hashes, rows = hashes[maybe], rows[maybe]
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return at[hit], rows[hit]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 ... of each text."""
        h, rows, counts = occurrences(texts)
        at, rows = Lookup(self.keys).find(h, rows)
        once = np.unique(rows * max(1, len(self.keys)) + at)
        score = np.bincount(once // max(1, len(self.keys)), weights=self.weights[once % max(1, len(self.keys))], minlength=len(counts))
        return _sigmoid(score[:, None] + self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, features: int, grades: int = GRADES, ridge: float = RIDGE, steps: int = STEPS, rising: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and falling thresholds that maximise the penalised likelihood (Adam on all rows). ``rising``: no weight is negative."""
    n = len(grade)
    w, b = np.zeros(features), np.zeros(grades)
    share = [np.clip((grade >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, grades + 1)]
    b[0] = np.log(share[0] / (1 - share[0]))
    b[1:] = np.log(0.5)  # logarithms of the gaps
    size = features + grades
    m, v, rate = np.zeros(size), np.zeros(size), 0.1
    for step in range(1, steps + 1):
        cuts = b[0] - np.concatenate([[0], np.cumsum(np.exp(b[1:]))])
        score = np.bincount(row, weights=w[feature], minlength=n)
        s = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] + cuts), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        up, down = s[i, grade], s[i, grade + 1]
        p = np.maximum(up - down, 1e-12)
        slope = np.zeros((n, grades + 2))
        slope[i, grade] += up * (1 - up) / p
        slope[i, grade + 1] -= down * (1 - down) / p
        by_cut = slope[:, 1:-1].sum(axis=0) / n
        grad_b = np.empty(grades)
        grad_b[0] = by_cut.sum()
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad_b[1:] = -tail[1:] * np.exp(b[1:])
        grad_w = np.bincount(feature, weights=(1 - up - down)[row], minlength=features) / n - ridge * w / max(1, n / 1000)
        grad = np.concatenate([grad_w, grad_b])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w + move[:features], b + move[features:]
        if rising:
            w = np.maximum(w, 0)
    return w, b[0] - np.concatenate([[0], np.cumsum(np.exp(b[1:]))])


def held_out_scores(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, features: int) -> np.ndarray:
    """The score of each row by a binary model of the other half of the rows (every second one of either label)."""
    n = len(toxic)
    half = np.empty(n, np.int64)
    for label in (0, 1):
        half[toxic == label] = np.arange((toxic == label).sum()) % 2
    out = np.zeros(n)
    for k in (0, 1):
        own = np.flatnonzero(half != k)
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        inside = place[row] >= 0
        if not len(own):
            continue
        weights, _ = fit_ordinal(place[row[inside]], feature[inside], toxic[own].astype(np.int64), features, 1, rising=True)
        out += np.where(half == k, np.bincount(row, weights=weights[feature], minlength=n), 0)
    return out


def _likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How much more often toxic rows have a feature than others (G squared; 0 if not more often)."""
    share = (pos + neg) / (n_pos + n_neg)
    g = 2 * (pos * np.log(np.maximum(pos, 1e-9) / (share * n_pos)) + neg * np.log(np.maximum(neg, 1e-9) / (share * n_neg)))
    return np.where(pos / n_pos > neg / n_neg, g, 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, grades: int = GRADES) -> Model:
    """The model for ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); without rows of both kinds it calls nothing toxic."""
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades, -40.0))
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # bounded by ``sample``
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = checkpoint(rows.select("text", "toxic"))
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = count.get(1, 0), count.get(0, 0)
    if not n_pos or not n_neg:
        return nothing

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                h, row, _ = occurrences(part.column(0))
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                keep = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64))], names=["feature"])

    frequent = map_batches(rows.where("toxic = 1").select("text"), distinct, "feature long").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(LEAST, n_pos))
    found = frequent.toArrow()  # as many as the toxic rows of the sample have
    keys, pos = found.column("feature").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    keys, pos = keys[order], pos[order]
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        total = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                h, row, _ = occurrences(part.column(0))
                at, row = lookup.find(h, row)
                total += np.bincount(np.unique(row * len(total) + at) % max(1, len(total)), minlength=len(total)) if len(total) else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["at", "n"])

    held = map_batches(rows.where("toxic = 0").select("text"), clean, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    neg = np.zeros(len(keys), np.int64)
    neg[held.column("at").to_numpy()] = held.column("n").to_numpy()
    ratio = _likelihood_ratio(pos, neg, n_pos, n_neg)
    ratio[pos / n_pos < TIMES * neg / n_neg] = 0
    best = np.argsort(-ratio, kind="stable")[:features]
    keys = keys[np.sort(best[ratio[best] > SIGNIFICANT])]
    if not len(keys):
        return nothing
    selected = rows.sparkSession.sparkContext.broadcast(keys)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = selected.value
        lookup = Lookup(keys)
        for batch in batches:
            for part in words.by_bytes(batch, "text"):
                h, row, counts = occurrences(part.column(0))
                at, row = lookup.find(h, row)
                once = np.unique(row * len(keys) + at)
                cuts = np.searchsorted(once // len(keys), np.arange(len(counts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(cuts, pa.array(once % len(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(1), lists], names=["toxic", "features"])

    train = map_batches(rows, sparse, "toxic int, features array<long>").withColumn("place", F.xxhash64("features")).toArrow().sort_by([("toxic", "ascending"), ("place", "ascending")])
    toxic = train.column("toxic").to_numpy()
    lists = train.column("features").combine_chunks()
    feature, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(toxic)), length)
    held = held_out_scores(row, feature, toxic, len(keys))
    edges = np.quantile(held[toxic == 1], np.arange(1, grades) / grades)
    grade = np.where(toxic == 1, 1 + np.searchsorted(edges, held, "right"), 0)
    weights, thresholds = fit_ordinal(row, feature, grade, len(keys), grades, rising=True)
    return Model(keys, weights, thresholds)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "severity") -> DataFrame:
    """``df`` with a struct ``name`` (expected, grade, p_toxic) as one more column; a null text counts as empty."""
    fields = list(pa.struct([("expected", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64())]))
    at = df.columns.index(text)
    # arrays alone: a class would be looked up in the package, which workers may lack
    shared = df.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.thresholds))

    def severity(batch: pa.RecordBatch) -> pa.Array:
        fitted, parts = Model(*shared.value), []
        for part in words.by_bytes(batch, batch.schema.names[at]):
            p = fitted.probabilities(part.column(at))
            whole = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
            grade = np.argmax(whole[:, :-1] - whole[:, 1:], axis=1)
            parts.append(pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(p[:, 0])], fields=fields))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    return with_arrow_column(df, name, StructType().add("expected", "double").add("grade", "integer").add("p_toxic", "double"), severity)


def toxicity(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, expected_severity, grade, p_toxic, toxic.

    ``labels`` has doc_id and toxic (0 or 1); rows with nulls there are no training
    rows, and an id labelled both ways is toxic. A null or empty text has no
    features. Rows that repeat get equal results. Other columns are ignored, and an
    empty table gives no rows.
    """
    docs = df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text"))
    scored = score(docs, fit(docs, labels.select("doc_id", "toxic"), sample))
    return scored.select("doc_id", F.col("severity.expected").alias("expected_severity"), "severity.grade", "severity.p_toxic", (F.col("severity.p_toxic") >= DECISION).alias("toxic"))


def without_toxic(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df`` that aren't toxic, with all their columns.

    Null and empty texts have no features and stay. Rows that repeat share their fate;
    rows that share an id are judged by their own texts. An empty table gives no rows; without
    labelled rows of both kinds nothing is called toxic.
    """
    docs = df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text"))
    name = free_name(df, "severity")
    scored = score(df, fit(docs, labels.select("doc_id", "toxic"), sample), text, name)
    return scored.where(F.col(name)["p_toxic"] < DECISION).drop(name)


def op6(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
