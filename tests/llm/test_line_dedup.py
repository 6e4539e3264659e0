import random
from collections import defaultdict

from helpers import ODD, documents

from ridgeline.llm import line_dedup

BLANK = " \t\r\x0b\f"


def brute(docs, sites):
    on = defaultdict(set)
    for _, text, site in docs:
        for line in (text or "").split("\n"):
            on[line.strip(BLANK)].add(site)
    out = []
    for doc, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(BLANK) or len(on[x.strip(BLANK)]) < sites]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in df.collect()), key=str)


def test_spread_around_and_far_over_the_threshold(spark):
    rng = random.Random(4)
    docs = []
    for i in range(400):
        site = None if i % 97 == 0 else f"site{rng.randrange(300)}"
        lines = [f"  common{k}" for k in range(30) if rng.random() < (k + 1) / 60] + [f"own{i}", ""]
        docs.append((i, "\n".join(lines), site))
    for sites in (2, 40, 100):
        assert found(line_dedup.remove_boilerplate(documents(spark, docs), sites=sites)) == brute(docs, sites)


def test_odd_rows(spark):
    assert found(line_dedup.remove_boilerplate(documents(spark, ODD), sites=2)) == brute(ODD, 2)


def test_empty_table(spark):
    assert line_dedup.remove_boilerplate(documents(spark, [])).collect() == []


def test_more_lines_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    docs = [(i, f"common line\nline {i % 7}\nown {i}", f"s{i % 12}") for i in range(60)]
    rows = line_dedup.remove_boilerplate(documents(spark, docs)).collect()
    monkeypatch.undo()
    assert sorted(map(str, rows)) == sorted(map(str, line_dedup.remove_boilerplate(documents(spark, docs)).collect()))
    assert all(r.n_removed >= 1 for r in rows)
