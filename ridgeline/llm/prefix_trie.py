"""The trie of all prefixes of conversations, built by truncation peeling.

A conversation is a path of turns, and a node of the trie is a sequence of first
turns that some conversation has. Peeling starts at the greatest depth: in each
round the conversations that end there meet the nodes that survive from below,
rows of one node are merged, the node is emitted with its sums, its last turn is
stripped, and what remains waits one level up. So nodes are found and summed in
the same pass, copies merge before they are peeled, and a node that any number
of conversations share is an aggregate with partial sums.

A path that from some depth on is no other conversation's is stripped in one step:
path keys at depths 1, 2, 4, 8 ... are counted once, and below the first of these
that a single path has, all its nodes follow from the path itself. The number of
rounds is the depth that distinct conversations share, at most twice.

Nodes are named by chained 128-bit digests of their turns; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, column, join_frequent, map_batches, table, text_column

#: Depths at which paths are counted: powers of two.
MARKS = [1 << i for i in range(31)]

#: Ids of one piece of a list of members.
PIECE = 8192

_SUMS = ("n", "children", "leaves", "saved")


def steps(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, steps): each conversation's turns in order (null first), as a digest of role and text and a number of words.

    Null roles and texts are empty. Turns that share a number come by role, then by
    digest. Rows without a conversation id are in no conversation.
    """
    r, t = text_column(df, role), text_column(df, text)
    rows = df.select(
        column(df, conv).cast("long").alias("conv_id"), column(df, turn).cast("long").alias("turn"), r.alias("role"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("mark"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"),
    ).where("conv_id IS NOT NULL")
    own = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "mark", "words")
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("steps"))
    return ordered.select("conv_id", F.transform("steps", lambda x: F.struct(F.unhex(x["mark"]).alias("mark"), x["words"].alias("words"))).alias("steps"))


def chained(paths: DataFrame) -> DataFrame:
    """(conv_id, path) of (conv_id, steps): the key of the node at each depth, and the words up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, upto, offsets = [], [], [0]
            for path in batch.column(1).to_pylist():
                key, total = b"", 0
                for step in path:
                    key = hashlib.blake2b(key + step["mark"], digest_size=16).digest()
                    total += step["words"]
                    keys.append(key)
                    upto.append(total)
                offsets.append(len(keys))
            nodes = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(upto, pa.int64())], ["key", "upto"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)], names=["conv_id", "path"])

    return map_batches(paths.select("conv_id", "steps"), run, "conv_id long, path array<struct<key: binary, upto: long>>")


def _key(path: str, depth: Column) -> Column:
    return F.when(depth > 0, F.try_element_at(F.col(path), depth)["key"]).otherwise(F.lit("").cast("binary"))


def _upto(path: str, depth: Column) -> Column:
    return F.when(depth > 0, F.try_element_at(F.col(path), depth)["upto"]).otherwise(F.lit(0).cast("long"))


def members_digest(ids: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): SHA-256 of each key's ids in order, joined by commas.

    Ids are sorted by ranges of (key, id), so a frequent key is sorted by many tasks; each task
    joins its ids into pieces, and one task runs over a key's pieces as a stream.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": key, "first": own[0], "ids": ",".join(map(str, own))}], pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own and (k != key or len(own) == PIECE):
                    yield piece()
                    own = []
                key = k
                own.append(i)
        if own:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is None or k != key:
                    if sha is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    pieces = map_batches(ids.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), join, "key binary, first long, ids string")
    return map_batches(pieces.repartition("key").sortWithinPartitions("key", "first"), digest, "key binary, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, steps), the textless root first among them.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null for the
    root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (over the subtree: members but one, times the words of the node's last turn) and
    ends_sha256 (of the members that end here, in order of id). A conversation's steps
    are held by a task as a whole, some 30 bytes a turn. No paths give no rows.
    """
    every = checkpoint(chained(paths))
    ended = every.withColumn("depth", F.size("path")).withColumn("key", _key("path", F.col("depth")))
    ended = checkpoint(ended.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("path").alias("path")))

    # where a path is alone
    marks = F.filter(F.array(*map(F.lit, MARKS)), lambda m: m <= F.col("depth"))
    passed = ended.select("key", "path", F.explode(marks).alias("mark")).select("key", "mark", _key("path", F.col("mark")).alias("at"))
    alone = passed.groupBy("at").agg(F.count(F.lit(1)).alias("paths"), F.min("key").alias("key"), F.min("mark").alias("mark")).where("paths = 1")
    alone = alone.groupBy("key").agg(F.min("mark").alias("alone"))
    staged = checkpoint(ended.join(alone, "key", "left"))

    depth, first = F.col("depth"), F.col("alone")
    tail = staged.where("alone IS NOT NULL")
    end = _upto("path", depth)
    node = lambda d: F.struct(
        _key("path", d).alias("key"), _key("path", d - 1).alias("parent"), d.alias("depth"), "conv_id", "n", (d < depth).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("n") - 1) * (end - _upto("path", d - 1))).alias("saved"), (d == first).alias("head"),
    )
    lone = tail.select(F.explode(F.transform(F.sequence(first, depth), node)).alias("x")).select("x.*")

    def waiting(df: DataFrame, at: Column, children: Column, leaves: Column, saved: Column) -> DataFrame:
        return df.select(_key("path", at).alias("key"), at.alias("depth"), F.slice("path", 1, at).alias("path"), "conv_id", "n", children.cast("long").alias("children"), leaves.cast("long").alias("leaves"), saved.alias("saved"))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    entering = waiting(tail, first - 1, one, one, (F.col("n") - 1) * (end - _upto("path", first - 1)))
    entering = checkpoint(entering.unionByName(waiting(staged.where("alone IS NULL"), depth, zero, zero, zero)))

    levels, open_ = [], None
    deepest = entering.agg(F.max("depth")).first()[0]
    for d in range(-1 if deepest is None else deepest, -1, -1):
        here = entering.where(F.col("depth") == d)
        here = here if open_ is None else here.unionByName(open_)
        merged = here.groupBy("key").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("conv_id").alias("conv_id"), F.first("path").alias("path"))
        at = F.lit(d)
        merged = merged.withColumn("saved", F.col("saved") + (F.col("n") - 1) * (_upto("path", at) - _upto("path", at - 1)))
        merged = merged.withColumn("leaves", F.greatest("leaves", one)).withColumn("depth", at)
        level = checkpoint(merged)
        levels.append(level.select("key", _key("path", at - 1).alias("parent"), "depth", "conv_id", *_SUMS, F.lit(True).alias("head")))
        open_ = waiting(level, F.greatest(at - 1, F.lit(0)), one, F.col("leaves"), F.col("saved"))
    if not levels:
        levels = [lone]  # empty

    peeled = reduce(DataFrame.unionByName, levels)
    above = checkpoint(peeled.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "children"))
    heads = peeled.unionByName(lone.where("head"))
    inner = lone.where("NOT head").withColumn("parent_conv_id", F.col("conv_id"))
    root = heads.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    rest = join_frequent(heads.where("depth > 0"), above.withColumnRenamed("children", "rows"), ["parent"], "rows").drop("rows")
    nodes = root.unionByName(rest.select(root.columns)).unionByName(inner.select(root.columns))

    many = checkpoint(ended.where("n > 1").select("key", "n"))
    ids = every.select(_key("path", F.size("path")).alias("key"), "conv_id")
    ends = ended.where("n = 1").select("key", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    ends = ends.unionByName(members_digest(join_frequent(ids, many, ["key"], "n")))
    out = nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    names = {"n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *[F.col(a).alias(b) for a, b in names.items()], "ends_sha256")


def rebuilt(paths: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, steps) in which the first h turns are those of the conversation c - c % ``family``; h is CRC-32 of the decimal id modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = paths.select("conv_id", "steps", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = paths.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, most - 1).alias("lead"))
    empty = F.array().cast(paths.schema["steps"].dataType)
    lead = F.slice(F.coalesce("lead", empty), 1, F.col("h"))
    return own.join(bases, "base", "left").select("conv_id", F.concat(lead, F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps"), F.lit(1)))).alias("steps"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`trie` of the conversations of a table of turns, as they are.

    Rows without a conversation id are left out; null roles and texts are empty; a null
    turn comes first; rows that repeat are turns of their own; other columns are
    ignored; an empty table gives no rows.
    """
    return trie(steps(df, conv, turn, role, text))


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(checkpoint(steps(table(spark, sf_dir, "conversations")))))


#: CRC-32 of an ASCII string column by its 256-entry table, made by rule.
CRC_TABLE_SQL = "crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS t(i)))"


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of an ASCII string, over rows joined with ``crc_table``."""
    codes = f"list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE_SQL = rf"""
WITH {CRC_TABLE_SQL},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, list({{'m': mark, 'w': words}} ORDER BY turn NULLS FIRST, role, mark) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id, s, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM a, crc_table),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.s, 1, h.h), []), list_slice(h.s, h.h + 1, len(h.s))) AS s FROM h LEFT JOIN a b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(s) AS len, s, unnest(range(0, len(s) + 1)) AS d FROM r),
q AS (SELECT conv_id, len, d, array_to_string(list_transform(list_slice(s, 1, d), lambda x: x.m), '') AS key, CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w FROM p),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '') AS ends FROM q GROUP BY key, d),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND substring(m.key, 1, 32 * n.d) = n.key) AS n_children FROM n),
u AS (SELECT d, n_children, (n_convs - 1) * w AS own, key, unnest(range(0, d + 1)) AS up FROM c),
s AS (SELECT substring(key, 1, 32 * up) AS key, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM u GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, o.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM c JOIN s ON c.key = s.key AND c.d = s.d LEFT JOIN n o ON o.d = c.d - 1 AND o.key = substring(c.key, 1, 32 * (c.d - 1))
"""
