import re
from collections import Counter

from helpers import ODD, SF, documents, words

from ridgeline.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = [False] * len(w)
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if words(x)]
    n, r = len(w), sum(hit)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def measured(rows):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str)


def test_statistics_against_brute_force_and_labels(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = q.op8(spark, SF).collect()
    assert measured(rows) == sorted(((d, *brute(t)) for d, t in docs), key=str)
    assert not any(r.kept and r.base_failed for r in rows)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in rows}
    clean = [kept[d] for d, y in good.items() if y == 1 and not brute(dict(docs)[d])[-1]]
    assert sum(clean) >= 0.97 * len(clean)


def test_learned_rules_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    rows = q.quality(docs, labels.where("doc_id % 2 = 0")).collect()
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    passed = [r for r in rows if r.doc_id in held and not r.base_failed]
    good, bad = [r.kept for r in passed if held[r.doc_id]], [r.kept for r in passed if not held[r.doc_id]]
    print("good kept", sum(good) / len(good), "bad kept", sum(bad) / max(1, len(bad)), len(good), len(bad))
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


def test_rules_are_grown_and_pruned():
    import random

    rng = random.Random(2)
    rows = [{f: rng.random() for f in q.FEATURES} for _ in range(900)]
    bad = [r["symbol_share"] > 0.6 and r["upper_share"] <= 0.5 or r["n_words"] > 0.9 for r in rows]
    rules = q.learn(rows, bad)
    called = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert sum(x == y for x, y in zip(called, bad)) > 0.95 * len(rows)
    assert q.learn(rows, [False] * len(rows)) == [] and q.learn([], []) == []


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (3, None)], "doc_id long, quality int")
    odd = [*ODD, (9, "a b c d e " * 30, "s"), (10, "a b c d e f a b c d e g h i j k\n\nx\n x\nx", "s")]
    rows = q.quality(documents(spark, odd), labels).collect()
    assert measured(rows) == sorted(((d, *brute(t)) for d, t, _ in odd), key=str)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.quality(documents(spark, []), labels).collect() == []
    assert len(q.quality(documents(spark, ODD), labels).collect()) == len(ODD)
