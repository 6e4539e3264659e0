from collections import Counter, defaultdict

import pytest
from helpers import ODD, SF, documents, words

from ridgeline.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by pouring and resharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest = dict.fromkeys(order, 0.0), min(share, epochs) * sum(sizes.values())
    for _ in range(200):
        open_ = [s for s in order if target[s] < epochs * sizes[s] - 1e-9]
        if not open_ or rest < 1e-9:
            break
        total, left = sum(weight[s] for s in open_), 0.0
        for s in open_:
            more = rest * weight[s] / total
            taken = min(more, epochs * sizes[s] - target[s])
            target[s] += taken
            left += more - taken
        rest = left
    return target


@pytest.mark.parametrize("where", ["documents", "odd", "skewed"])
def test_targets_and_takes(spark, where, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    if where == "documents":
        docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    elif where == "odd":
        docs = ODD
    else:
        docs = [(i, "w " * (i % 7), "a" if i % 3 else f"s{i % 40}") for i in range(900)] + [(1000, "w " * 5000, "z"), (1001, "x", None)]
    rows = mixing.mix(documents(spark, docs)).collect()
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(words(t))
    want = water(dict(sizes))
    by = {d: s for d, _, s in docs} if where != "odd" else None
    took, largest = Counter(), Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        if by:
            s = by[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            took[s] += r.taken
            largest[s] = max(largest[s], r.size)
    assert sum(r.taken for r in rows) <= sum(want.values()) + 1e-3
    for s in took:
        assert abs(took[s] - want[s]) <= 2 * max(largest.values())
    again = mixing.mix(documents(spark, docs[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter({d: k for d, k in taken.items() if k})


@pytest.mark.parametrize("rows", [ODD, [(i // 3, "w " * (3 + i % 3 * 8), "s") for i in range(30)], [(1, "a b", "s")] * 5 + [(1, "c d", "s"), (2, "a b", None)]])
def test_mixed_documents_have_the_words_that_the_mix_takes(spark, rows):
    df = documents(spark, rows)
    taken = sum(r.taken for r in mixing.mix(df).collect())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len(words(r.text)) for r in out.collect()) == taken
    assert {(r.doc_id, r.text) for r in out.collect()} <= {x[:2] for x in rows}


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.mixed_documents(documents(spark, [])).collect() == []
