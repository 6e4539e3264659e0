"""Quality filtering by a learned decision list over text statistics.

Statistics are DataFrame expressions over whole texts, without a shuffle. Rules
are learned by sequential covering on a bounded sample of labelled statistics:
a rule grows by the threshold condition with the best information gain on one part of the rows
until it covers no clean row, is pruned on the other part while that doesn't lower its precision,
and removes what it covers before the next. The list becomes one ordered Spark
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, column, table, text_column

#: At most this many labelled rows are used to learn, the first by a hash of the id.
SAMPLE = 5000
WINDOW = 5
CUTS, MOST_RULES, MOST_CONDITIONS, LEAST_ROWS = 24, 12, 4, 3

#: Ratios that rules test, as expressions of the base statistics.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: lambdas see a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the array ``words``.

    Window hashes are sorted with their places, so equal ones are neighbours; the
    places of those give the words covered. A text whose windows are all different needs no sort.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return F.get(pairs, i)["h"] == F.get(pairs, j)["h"]

            places = F.filter(pairs, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            places = F.sort_array(F.transform(places, lambda x: x["i"]))
            last = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-window).alias("at"))
            return F.aggregate(places, last, lambda a, p: F.struct((a["words"] + F.least(p - a["at"], F.lit(window))).alias("words"), p.alias("at")), lambda a: a["words"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, of_sorted))

    def windows(bound: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(bound) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(bound, i + k) for k in range(window)]))

    return F.when(n < window, F.lit(0).cast("long")).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def statistics(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of each text; a null text counts as empty."""
    t = F.col("text")
    docs = df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text"))
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return docs.select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?|", ""))).cast("long").alias("n_marks"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def _split(rows: list, labels: list[bool]) -> tuple[list[int], list[int]]:
    """Two thirds to grow on and one to prune on, alike in labels."""
    grow, prune, seen = [], [], {True: 0, False: 0}
    for i, y in enumerate(labels):
        (prune if seen[y] % 3 == 2 else grow).append(i)
        seen[y] += 1
    return grow, prune


def _covered(rule: Rule, rows: list[dict], at: list[int]) -> list[int]:
    return [i for i in at if all(c.holds(rows[i]) for c in rule)]


def _candidates(rows: list[dict], at: list[int]) -> list[Condition]:
    """Cuts between neighbouring values, at even steps of the rows."""
    out = []
    for f in FEATURES:
        values = sorted({rows[i][f] for i in at})
        step = max(1, len(values) // CUTS)
        for a, b in zip(values[::step], values[1::step]):
            out += [Condition(f, True, (a + b) / 2), Condition(f, False, (a + b) / 2)]
    return out


def learn(rows: list[dict], bad: list[bool]) -> list[Rule]:
    """Ordered rules for bad rows; a row that none covers is good.

    A rule is kept if, on the rows to prune on, more than nine in ten it covers are bad.
    """
    rules: list[Rule] = []
    left = list(range(len(rows)))
    while len(rules) < MOST_RULES and sum(bad[i] for i in left) >= LEAST_ROWS:
        order, labels = left, [bad[i] for i in left]
        grow, prune = ([order[i] for i in part] for part in _split(order, labels))
        rule: Rule = ()
        at = grow
        while len(rule) < MOST_CONDITIONS and not all(bad[i] for i in at):
            p0, n0 = sum(bad[i] for i in at), len(at)
            if not p0:
                break
            best = (0.0, None, [])
            for c in _candidates(rows, at):
                inside = [i for i in at if c.holds(rows[i])]
                p1 = sum(bad[i] for i in inside)
                if p1 >= LEAST_ROWS:
                    gain = p1 * (math.log2(p1 / len(inside)) - math.log2(p0 / n0))
                    if gain > best[0] + 1e-9:
                        best = (gain, c, inside)
            if best[1] is None:
                break
            rule, at = (*rule, best[1]), best[2]
        if not rule:
            break

        def worth(r: Rule) -> float:
            inside = _covered(r, rows, prune)
            p = sum(bad[i] for i in inside)
            return (2 * p - len(inside)) / len(inside) if inside else -1.0

        while len(rule) > 1:
            shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        inside = _covered(rule, rows, left)
        if worth(rule) <= 0.8 or sum(bad[i] for i in inside) < LEAST_ROWS:
            break
        rules.append(rule)
        gone = set(inside)
        left = [i for i in left if i not in gone]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: one ordered conditional expression."""
    expression = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {expression} ELSE true END" if rules else "true")


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality 0 or 1) and the statistics of those rows that the base rules pass."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = stats.join(F.broadcast(chosen), "doc_id").where(~base_failed()).select("doc_id", F.struct("quality", *[F.expr(e).alias(f) for f, e in FEATURES.items()]).alias("row"))
    # bounded by ``sample``: of rows that share an id, the one with the smallest statistics
    rows = known.groupBy("doc_id").agg(F.min("row").alias("row")).orderBy("doc_id").select("doc_id", "row.*").collect()
    return learn([r.asDict() for r in rows], [r["quality"] == 0 for r in rows])


def quality(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails. Labels with nulls are no training
    rows; an id labelled both ways counts as bad; without labels only the base
    rules decide. Rows that repeat get equal results, a null id stays null, other
    columns are ignored, and an empty table gives no rows.
    """
    docs = df.select(column(df, id_column).alias("doc_id"), text_column(df, text).alias("text"))
    known = labels.select("doc_id", "quality")
    chosen = known.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # only texts of the sample are measured to learn from; written first, or filters on the statistics would be pushed below the join
    rules = fit(statistics(checkpoint(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))), known, sample)
    stats = statistics(docs)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
