"""Repairing the turn structure of conversations at the least cost.

A conversation is a string over symbols: the kind of role and the fault of each row.
Its cheapest edits lead through an automaton of four states that accepts the role
initials (s?(ua)+)?. A symbol is a 4 x 4 matrix over (cost, audit): inserts before the
row, then what is done with the row; matrices are multiplied with (min, +) on costs
and concatenation of audits, ties going to the audit that is least in ASCII.

Symbols are compressed by a Re-Pair grammar that all conversations share: its rules are
made from pair counts over all of them, a batch of most frequent pairs a round, and the
matrix of a rule is the product of its two parts', so it is worked out once for all the
conversations that it stands in. The product is associative, so the grammar (its size is
bounded) changes what is computed twice, never a result. Audits in matrices are ropes:
letters, or pairs of shorter ropes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, map_batches, table
from .prefix_trie import CRC_TABLE_SQL, crc_sql

#: Costs of the edits (fixed values); an undeleted truncated row costs REWRITE more.
REROLE, DELETE, INSERT, REWRITE = 3, 4, 3, 3

#: Rules of the grammar, and rounds in which they are made, at most. A round takes pairs of which no two share a symbol.
RULES, ROUNDS = 240, 8

#: Kinds of role by initial; the rest is one more.
INITIALS = "sua"
OTHER = len(INITIALS)
#: Symbols: 2 * kind of role + truncated; one for all rows that must go.
GONE = 2 * (OTHER + 1)
TERMINALS = GONE + 1

#: Next state by role initial. 0: nothing yet, 1: after s, 2: after u, 3: after ua, where one may end, as in 0.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role of user and assistant that a state takes.
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
#: Inserts that lead from a state to an end.
CLOSING = ("", "II", "I", "")

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_FAULTS = ("blank", "duplicate", "truncated")


def rope(x) -> str:
    """The letters of an audit."""
    out, open_ = [], [x]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            open_ += (x[1], x[0])
    return "".join(out)


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper of two (cost, audit), or the one whose audit comes first.

    Both audits end in a row's letter and have as many of these, so neither begins the other.
    """
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or rope(a[1]) <= rope(b[1]) else b


def product(a: list, b: list) -> list:
    """The (min, +) product of two matrices."""
    out = []
    for row in a:
        line = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None:
                        line[j] = better(line[j], (x[0] + y[0], (x[1], y[1])))
        out.append(line)
    return out


def terminal(symbol: int) -> list:
    """The matrix of one row: up to two inserts, then keep, rerole or delete."""
    out = []
    for state in range(4):
        line, at, cost, letters = [None] * 4, state, 0, ""
        for _ in range(3):
            if symbol == GONE:
                line[at] = better(line[at], (cost + DELETE, letters + "D"))
            else:
                kind, extra = symbol // 2, REWRITE * (symbol % 2)
                line[at] = better(line[at], (cost + DELETE, letters + "D"))
                role = STEP[at][WANTED[at]]
                line[role] = better(line[role], (cost + REROLE + extra, letters + "R"))
                if kind != OTHER and INITIALS[kind] in STEP[at]:
                    to = STEP[at][INITIALS[kind]]
                    line[to] = better(line[to], (cost + extra, letters + "K"))
            at, cost, letters = STEP[at][WANTED[at]], cost + INSERT, letters + "I"
        out.append(line)
    return out


def replaced(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """Each pair of ``rules`` replaced from the left; no two of the pairs share a symbol."""
    out, i = [], 0
    while i < len(symbols):
        name = rules.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
        out.append(symbols[i] if name is None else name)
        i += 1 if name is None else 2
    return out


class Grammar:
    """Rules in rounds, and the matrix of every symbol, worked out bottom-up."""

    def __init__(self, rounds: list[dict[tuple[int, int], int]] = ()):
        self.rounds = list(rounds)
        self.matrices = [terminal(x) for x in range(TERMINALS)]
        for rules in self.rounds:
            for (a, b), name in sorted(rules.items(), key=lambda x: x[1]):
                assert name == len(self.matrices)
                self.matrices.append(product(self.matrices[a], self.matrices[b]))

    def compressed(self, symbols: list[int]) -> list[int]:
        for rules in self.rounds:
            symbols = replaced(symbols, rules)
        return symbols

    def repair(self, symbols: list[int]) -> tuple[int, str]:
        """Cost and audit of the cheapest edits of a conversation.

        States keep the rank of their audits among each other, which decides ties but where it is
        equal; so only audits of rules are compared, and a long conversation takes linear time.
        """
        states = {0: (0, 0, "")}  # cost, rank, audit
        for x in self.compressed(symbols):
            found = {}
            for k, (cost, rank, audit) in states.items():
                for j, y in enumerate(self.matrices[x][k]):
                    if y is not None:
                        found.setdefault(j, []).append((cost + y[0], rank, rope(y[1]), audit, y[1]))
            best = {j: min(of, key=lambda t: t[:3]) for j, of in found.items()}
            ranks = {t: i for i, t in enumerate(sorted({b[1:3] for b in best.values()}))}
            states = {j: (b[0], ranks[b[1:3]], (b[3], b[4])) for j, b in best.items()}
        return min((cost + INSERT * len(CLOSING[q]), rope(audit) + CLOSING[q]) for q, (cost, _, audit) in states.items())


def pair_counts(symbols: list[int]) -> Counter:
    """Pairs that don't overlap with themselves."""
    found, last = Counter(), None
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if pair[0] == pair[1] and last == i - 1 and symbols[i - 1] == pair[0]:
            last = None
            continue
        last = i
        found[pair] += 1
    return found


def grammar(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """The Re-Pair grammar of ``sequences`` (symbols array<int>), all of which are counted in each round.

    A task counts pairs of its own first; counts of at most (terminals + rules) squared pairs reach the driver.
    """
    made: list[dict] = []
    names = TERMINALS
    for n in range(rounds):
        known = Grammar(made)
        batch = max(1, (rules - (names - TERMINALS)) // (rounds - n))

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total = Counter()
            for x in batches:
                for symbols in x.column(0).to_pylist():
                    total += pair_counts(known.compressed(symbols))
            a, b = [p[0] for p in total], [p[1] for p in total]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])

        counts = map_batches(sequences.select("symbols"), count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        taken, used = {}, set()
        for row in sorted(counts.collect(), key=lambda r: (-r["n"], r["a"], r["b"])):
            if len(taken) < batch and not {row["a"], row["b"]} & used:
                used |= {row["a"], row["b"]}
                taken[row["a"], row["b"]] = names
                names += 1
        if not taken:
            break
        made.append(taken)
    return Grammar(made)


def read(rows: list[tuple[bool, int | None, str, str]]) -> dict:
    """Faults, symbols and counts of a conversation's rows in order: (there, turn, role, text or a digest with its two flags)."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "symbols": []}
    seen, before = set(), None
    for _, role, mark, blank, cut in rows:
        same = (role, mark) in seen
        seen.add((role, mark))
        fault = 0 if blank else 1 if same else 2 if cut else None
        if fault is not None:
            out[_FAULTS[fault]] += 1
        initial = role[:1]
        kind = INITIALS.find(initial) if initial else -1
        out["symbols"].append(GONE if fault in (0, 1) else 2 * (OTHER if kind < 0 else kind) + (fault == 2))
        if before is not None and before + initial not in ("su", "ua", "au"):
            out["illegal"] += 1
        before = initial
    turns = [x[0] for x in rows if x[0] is not None]
    out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return out


def edited(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) after the edits of ``audit``."""
    out, state, i = [], 0, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role, text = ("", "") if letter == "I" else rows[i]
        if letter != "K":
            role = NAMES[WANTED[state]]
        state = STEP[state][role[:1]]
        i += letter != "I"
        out.append((role, text))
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, its rows) from rows sorted by conversation."""
    conv, rows, begun = None, [], False
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if begun and row[0] != conv:
                yield conv, rows
                rows = []
            conv, begun = row[0], True
            if row[1]:  # not one that only names its conversation
                rows.append(row[2:])
    if begun:
        yield conv, rows


def _flags(text: Column) -> tuple[Column, Column, Column]:
    """Digest, whether blank, whether the last character but white space isn't a stop."""
    return F.unhex(F.md5(text)), ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """One row per conversation id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired.

    Rows come by turn (null first), then by role and text. Each row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated (no stop at its end).
    ``audit`` has the initials of the cheapest edits in order (Keep, Rerole, Delete,
    Insert; ties least in ASCII) after which role initials are (s?(ua)+)?; ``repaired``
    has the edited turns, of which ``repaired_sha256`` digests role:text lines. Null
    roles and texts are one space; a null id is an id of its own. A boolean column ``there`` may say which rows count: the
    others only name their conversation, which has zeros if it has no more. Rows that repeat are duplicates.
    A conversation is held by one task as a whole. Other columns are ignored; an empty table gives no rows.
    """
    exists = column(df, there) if there else F.lit(True)
    value = lambda c: F.coalesce(column(df, c).cast("string"), F.lit(" "))
    rows = df.select(column(df, conv).cast("long").alias("conv_id"), exists.alias("there"), column(df, turn).cast("long").alias("turn"), value(role).alias("role"), F.when(exists, value(text)).otherwise("").alias("text"))
    mark, blank, cut = _flags(F.col("text"))
    order = ("conv_id", "turn", "role")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [read(x)["symbols"] for _, x in _conversations(batches)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["symbols"])

    light = rows.select("conv_id", "there", "turn", "role", mark.alias("mark"), blank.alias("blank"), cut.alias("cut"))
    sequences = checkpoint(map_batches(light.repartition("conv_id").sortWithinPartitions(*order, "mark"), train, "symbols array<int>"))
    shared = grammar(sequences)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", *_FAULTS, "illegal", "cost", "audit", "repaired_sha256", "repaired"]
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        out, size = [], 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for conv_id, own in _conversations(batches):
            texts = [(r, t) for _, r, t in own]
            found = read([(n, r, hashlib.md5(t.encode()).digest(), not _WORD.search(t), t.rstrip(" \t\n\x0b\x0c\r")[-1:] not in (".", "!", "?")) for n, r, t in own])
            cost, audit = shared.repair(found["symbols"])
            done = edited(texts, audit)
            sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
            out.append((conv_id, found["gaps"], *[found[f] for f in _FAULTS], found["illegal"], cost, audit, sha, [{"role": r, "text": t} for r, t in done]))
            size += sum(len(t) for _, t in done)
            if size > 1 << 22 or len(out) == 4096:
                yield written()
                out, size = [], 0
        if out:
            yield written()

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"
    return map_batches(rows.repartition("conv_id").sortWithinPartitions(*order, "text"), mend, schema)


def damaged(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) damaged by CRC-32 of conv_id:turn modulo 20; rows that are dropped stay with ``there`` false."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = df.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), code.alias("code"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op12(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), there="there").drop("repaired")


_BLANK = r"[^\x20\x09-\x0D]"
ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations),
c AS (SELECT k.*, {crc_sql("named")} % 20 AS code FROM k, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE code <> 0),
n AS (SELECT conv_id, turn, role, text, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
      NOT regexp_matches(text, '{_BLANK}') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS same FROM n),
f AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN same THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT conv_id, count(*) AS m, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
ins(q, p, letters, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
      (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
ops AS (SELECT p, e, unnest(['K', 'R', 'D']) AS op FROM (SELECT DISTINCT p FROM ins), (VALUES ('s'), ('u'), ('a'), ('')) AS v(e)),
moves AS (SELECT p, e, op, CASE op WHEN 'D' THEN p WHEN 'R' THEN CASE p WHEN 2 THEN 3 ELSE 2 END
      ELSE CASE WHEN p = 0 AND e = 's' THEN 1 WHEN p IN (0, 1, 3) AND e = 'u' THEN 2 WHEN p = 2 AND e = 'a' THEN 3 END END AS q, CASE op WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END AS cost FROM ops),
dp(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT dp.conv_id, f.i, v.q, min({{'c': dp.best.c + {INSERT} * len(ins.letters) + v.cost + CASE WHEN v.op <> 'D' AND f.fault = 'truncated' THEN {REWRITE} ELSE 0 END, 'a': dp.best.a || ins.letters || v.op,
         'o': list_concat(dp.best.o, list_concat(ins.lines, CASE v.op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE ins.p WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] END))}})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.q = dp.q
       JOIN moves v ON v.p = ins.p AND v.e = CASE WHEN f.r IN ('s', 'u', 'a') THEN f.r ELSE '' END AND v.q IS NOT NULL AND (v.op = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY dp.conv_id, f.i, v.q),
e AS (SELECT dp.conv_id, min({{'c': best.c + {INSERT} * len(x.letters), 'a': best.a || x.letters, 'o': list_concat(best.o, x.lines)}}) AS best
      FROM dp LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN ins x ON x.q = dp.q AND x.letters = CASE dp.q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END
      WHERE dp.i = coalesce(g.m, 0) GROUP BY dp.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""
