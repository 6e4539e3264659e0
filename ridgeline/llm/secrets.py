"""Secret scanning with linking of multipart credentials.

Patterns that are telling by themselves (assignments, access ids, long hex) are
reported as they are. Weak parts - identifiers, unlabelled random strings and
endpoints - are common in clean text; they are reported only where a secret and
a complementary part (an identifier or an endpoint) lie within one scope of
each other. Parts of a text are rows, and an interval join over scope-wide
buckets links them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, map_batches, table, text_column

#: Kinds in the order in which spans at one place are listed; the first three stand alone.
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
STRONG = 3
SECRETS, COMPLEMENTS = (0, 2, 4), (1, 3, 5)

#: Two parts are in one scope if they start within this many characters of each other.
SCOPE = 200

_ASCII = re.IGNORECASE | re.ASCII
#: Patterns over UTF-8 bytes, all of them ASCII, and what a text must match to be searched at all.
PATTERNS = (
    re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ASCII),
    re.compile(rb"AKIA[A-Z0-9]+"),
    re.compile(rb"[0-9a-f]+(?<=[0-9a-f]{24})"),
    re.compile(rb"""(?:client|account|tenant|user|key)_?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{4,})""", _ASCII),
    re.compile(rb"[A-Za-z0-9+/_=-]{20,}"),
    # a host begins at the first of its labels, so that each run of labels is read once
    re.compile(rb"""https?://[^\x00-\x20"'<>\x7f-\xff]+|(?<![A-Za-z0-9-])(?<![A-Za-z0-9-]\.)(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}:[0-9]{2,5}"""),
)
NEEDED = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    r"AKIA[A-Z0-9]{16}",
    r"[0-9a-f]{24}",
    r"""(?i)(client|account|tenant|user|key)_?(id|name)["']?\x20*[:=]""",
    r"[A-Za-z0-9+/_=-]{20}",
    r"https?://|[A-Za-z]{2}:[0-9]{2}",
)


def looks_random(token: bytes) -> bool:
    """Upper and lower case, digits, and close to as many different characters as the length allows."""
    if sum(c in b"0123456789" for c in token) < 2 or token.lower() == token or token.upper() == token:
        return False
    n = len(token)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    return entropy >= min(3.5, 0.8 * math.log2(n))


def kept(kind: int, match: re.Match) -> bool:
    if kind == 0:
        return len(match[2]) >= 6
    if kind == 1:
        return match.end() - match.start() >= 20
    return kind != 4 or looks_random(match[0])


def parts_of(raw: bytes, kinds: list[int]) -> list[dict]:
    """All parts of a text as kind, start and end in code points; weak ones that overlap a strong one are left out."""
    strong = sorted((m.start(), k, m.end()) for k in kinds if k < STRONG for m in PATTERNS[k].finditer(raw) if kept(k, m))
    starts = [s for s, _, _ in strong]
    upto = list(accumulate((e for _, _, e in strong), max))  # the furthest end of all spans up to each

    def free(m: re.Match) -> bool:
        before = bisect_left(starts, m.end())  # spans that start before its end
        return not before or upto[before - 1] <= m.start()

    found = strong + [(m.start(), k, m.end()) for k in kinds if k >= STRONG for m in PATTERNS[k].finditer(raw) if kept(k, m) and free(m)]
    found.sort()
    out, at, points = [], 0, 0
    places = {}
    for byte in sorted({x for s, _, e in found for x in (s, e)}):
        points += len(raw[at:byte].decode())
        at = byte
        places[byte] = points
    for start, kind, end in found:
        out.append({"start": places[start], "kind": kind, "end": places[end]})
    return out


PART = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text) and parts of (doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            wanted = [pc.match_substring_regex(texts, p).to_pylist() for p in NEEDED]
            found = [[] for _ in range(batch.num_rows)]
            for i, needs in enumerate(zip(*wanted)):
                if any(needs):
                    found[i] = parts_of(texts[i].as_py().encode(), [k for k, x in enumerate(needs) if x])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(PART))], names=["doc_id", "mark", "parts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, mark long, parts array<struct<start: long, kind: int, end: long>>")


def linked(found: DataFrame) -> DataFrame:
    """(doc_id, mark, added): the weak parts of each text that a credential is made of. ``found``: doc_id, mark, parts."""
    rows = found.distinct().select("doc_id", "mark", F.explode("parts").alias("p")).select("doc_id", "mark", "p")
    bucket = F.floor(F.col("p.start") / F.lit(SCOPE))
    secrets = rows.where(F.col("p.kind").isin(*SECRETS)).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("p").alias("s"), bucket.alias("b"))
    others = rows.where(F.col("p.kind").isin(*COMPLEMENTS)).select("doc_id", "mark", F.col("p").alias("o"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    near = F.abs(F.col("s.start") - F.col("o.start")) <= SCOPE
    pairs = others.join(secrets, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("bucket") == F.col("b")) & near)
    ends = pairs.select("doc_id", "mark", F.explode(F.array("s", "o")).alias("p")).where(F.col("p.kind") >= STRONG)
    return ends.groupBy("doc_id", "mark").agg(F.collect_set("p").alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"], p["end"])), ",")


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``spans`` lists kind:start:end in code points, ends exclusive, by start and then
    kind; ``found`` has the same as structs. ``base_sha256`` is the digest of that list
    for the first three kinds alone. A null text counts as empty. Rows that repeat get equal
    results, rows that share an id but not a text their own. A null id stays null.
    Other columns are ignored, and an empty table gives no rows.
    """
    t = text_column(df, text)
    docs = df.select(column(df, id_column).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("mark"))
    found = checkpoint(parts(docs))
    has = lambda kinds: F.exists("parts", lambda p: p["kind"].isin(*kinds))
    open_ = has(SECRETS) & has(COMPLEMENTS) & F.exists("parts", lambda p: p["kind"] >= STRONG)
    suspects = found.where(open_)
    more = linked(suspects).withColumnsRenamed({"doc_id": "d", "mark": "m"})
    with_more = suspects.join(more, suspects["doc_id"].eqNullSafe(more["d"]) & (suspects["mark"] == more["m"]), "left").select("doc_id", "parts", "added")
    rows = found.where(~open_).select("doc_id", "parts", F.lit(None).cast(with_more.schema["added"].dataType).alias("added")).unionByName(with_more)
    rows = rows.withColumn("base", F.filter("parts", lambda p: p["kind"] < STRONG))
    rows = rows.withColumn("found", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(with_more.schema["added"].dataType)))))
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "found")


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
