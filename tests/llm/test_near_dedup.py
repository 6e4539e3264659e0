import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, SF, documents, words
from test_substring_dedup import twins

from ridgeline.llm import near_dedup


def grams(text, size=5):
    w = words(text)
    if 0 < len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, threshold=0.8):
    sets = [(d, grams(t)) for d, t in docs]
    n = len(sets)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        d = sets[i][0]
        r = find(i)
        least[r] = d if least.get(r) is None else min(x for x in (least[r], d) if x is not None) if d is not None else least[r]
    return sorted(((sets[i][0], least[find(i)], links[i]) for i in range(n)), key=str)


def compared(rows, docs):
    """Classes as brute force has them; links only where it has some, and no more of them."""
    got, want = sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str), brute(docs)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(bool(x[2]) == bool(y[2]) and x[2] <= y[2] for x, y in zip(sorted(got, key=lambda x: str(x[:2])), sorted(want, key=lambda x: str(x[:2]))))
    return got


def test_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert any(x[2] for x in compared(near_dedup.op2(spark, SF).collect(), docs))


def near_copies(seed, many, edits):
    rng = random.Random(seed)
    base = [str(rng.random()) for _ in range(120)]
    docs = []
    for i in range(many):
        text = base[:]
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(120)] = "w%d" % rng.randrange(10**6)
        docs.append((i, " ".join(text), "s"))
    return docs


@pytest.mark.parametrize("seed,many,edits", [(1, 150, 4), (3, 150, 9)])
def test_large_groups_of_near_copies(spark, seed, many, edits):
    # 9 edits: most pairs share buckets without being similar, and links make chains
    docs = near_copies(seed, many, edits)
    compared(near_dedup.near_duplicates(documents(spark, docs), recall=0.999999).collect(), [x[:2] for x in docs])


@pytest.mark.parametrize("many,edits", [(150, 4), (150, 9)])
def test_large_buckets_join_on_rare_grams(spark, monkeypatch, many, edits):
    monkeypatch.setattr(near_dedup, "LARGE", 1)
    monkeypatch.setattr(near_dedup, "FEWER", 1e-9)
    docs = near_copies(3, many, edits)
    compared(near_dedup.near_duplicates(documents(spark, docs), recall=0.999999).collect(), [x[:2] for x in docs])


def exactly(rows, docs):
    """Classes and all links as brute force has them."""
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str) == brute(docs)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 7])
def test_no_link_is_left_out(spark, monkeypatch, block):
    # pairs of a component that never meet in a star, in one block and in many; copies and other groups among them
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_GRAMS", 1000 if block == 7 else near_dedup.BLOCK_GRAMS)
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    docs = [(i, t, "s") for i, (_, t, _) in enumerate(near_copies(3, 100, 9) + near_copies(4, 3, 1) * 2)]
    docs += [(200 + i, " ".join(docs[0][1].split()[: 120 - 3 * i]), "s") for i in range(30)]
    rows = near_dedup.near_duplicates(documents(spark, docs)).collect()
    exactly(rows, [x[:2] for x in docs])
    assert max(r.n_links for r in rows) > 20


def test_pairs_without_a_common_band(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "bands_for", lambda *a: (1, 60))
    docs = near_copies(6, 40, 6) + [(100 + i, t, s) for g in range(7, 12) for i, t, s in near_copies(g, 2, 5)] + ODD
    exactly(near_dedup.near_duplicates(documents(spark, docs)).collect(), [x[:2] for x in docs])


def around_a_passage(seed, many):
    """Unlike texts around one passage at a similarity of 0.4, some with a near copy."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    docs = []
    for i in range(many):
        own = passage + [f"t{i}_{j}" for j in range(90)] if i % 10 or not i else docs[-1][1].split()
        if not i % 10 and i:
            own[rng.randrange(len(own))] = f"edit{i}"
        docs.append((i, " ".join(own), "s"))
    return docs


def test_unlike_texts_around_one_passage(spark, monkeypatch):
    docs = around_a_passage(1, 1500)
    monkeypatch.setattr(near_dedup, "LARGE", 20)
    met = []
    pairs = near_dedup.rare_pairs
    monkeypatch.setattr(near_dedup, "rare_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(documents(spark, docs)).collect()}
    assert got == {(i, i - 1 if i and not i % 10 else i) for i in range(len(docs))}
    assert met and met[0].count() < len(docs)  # and not their square


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95, 1.0])
def test_rare_pairs_lose_none(spark, threshold):
    rng = random.Random(int(threshold * 100))
    sets = [sorted(rng.sample(range(40), rng.randint(1, 30))) for _ in range(120)]
    rows = [(f"{i:03}".encode(), f"{i % 7}".encode(), s) for i, s in enumerate(sets)]
    found = near_dedup.rare_pairs(spark.createDataFrame(rows, "key binary, label binary, grams array<long>"), threshold).collect()
    got = {(int(r.a), int(r.b)) for r in found}
    assert len(got) == len(found) and all(a < b and a % 7 != b % 7 for a, b in got)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if i % 7 != j % 7 and len(set(a) & set(b)) >= threshold * len(set(a) | set(b)):
                assert (i, j) in got


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95, 1.0])
def test_sketches_lose_none(spark, monkeypatch, threshold):
    # sets of 20 to 800 n-grams, so sketches of several widths; all that meet are compared by them
    monkeypatch.setattr(near_dedup, "CROWD", 1)
    rng = random.Random(int(threshold * 100))
    sets = []
    for i in range(90):
        base = sets[rng.randrange(i)] if i % 6 else rng.sample(range(1 << 40), rng.randint(20, 800))
        kept = rng.sample(base, max(1, int(len(base) * rng.choice([1, rng.uniform(max(0.25, threshold - 0.1), 1)]))))
        sets.append(sorted({*kept, *(rng.randrange(1 << 40) for _ in range(rng.choice([0, 0, 4])))}))
    sketches = [(f"{i:03}".encode(), near_dedup.parity_sketch(np.array(s, np.uint64)).tolist()) for i, s in enumerate(sets)]
    assert len({len(x) for _, x in sketches}) > 2
    sketches = spark.createDataFrame(sketches, "key binary, sketch array<long>")
    meeting = near_dedup.meeting
    monkeypatch.setattr(near_dedup, "meeting", lambda *a: meeting(*a, sketches=sketches))
    rows = [(f"{i:03}".encode(), f"{i % 7}".encode(), s) for i, s in enumerate(sets)]
    got = {(int(r.a), int(r.b)) for r in near_dedup.rare_pairs(spark.createDataFrame(rows, "key binary, label binary, grams array<long>"), threshold).collect()}
    sets = [set(s) for s in sets]
    want = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if i % 7 != j % 7 and len(a & sets[j]) >= threshold * len(a | sets[j])}
    assert want and want <= got


@pytest.mark.parametrize("n", [0, 1, 100, 128, 129, 5000])
def test_sketches_differ_in_no_more_than_sets(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
    x, y = near_dedup.parity_sketch(a), near_dedup.parity_sketch(b)
    assert near_dedup.LEAST_WORDS <= len(x) == len(y) <= near_dedup.MOST_WORDS
    assert np.unpackbits((x ^ y).view(np.uint8)).sum() <= len(np.setxor1d(a, b))


def test_crowds_of_edited_copies_do_not_meet_in_pairs(spark, monkeypatch):
    # one text with two words changed in each copy: any two share most n-grams, and few are similar
    rng = random.Random(9)
    docs = []
    for i in range(200):
        text = [f"b{j}" for j in range(120)]
        for at in rng.sample(range(120), 2):
            text[at] = f"w{i}_{at}"
        docs.append((i, " ".join(text), "s"))
    met, pairs = {}, near_dedup.met_pairs

    def counted(open_, *a):
        for name, rows in (("before", open_.drop("sketch")), ("now", open_)):
            met[name] = met.get(name, 0) + pairs(rows, *a).count()
        return pairs(open_, *a)

    monkeypatch.setattr(near_dedup, "met_pairs", counted)
    exactly(near_dedup.near_duplicates(documents(spark, docs)).collect(), [x[:2] for x in docs])
    assert met["before"] > 100 * len(docs) and met["now"] < met["before"] / 5


def test_wanted_classes_are_joined_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    docs = near_copies(5, 60, 4)
    compared(near_dedup.near_duplicates(documents(spark, docs)).collect(), [x[:2] for x in docs])


def test_words_that_polynomials_confuse(spark):
    lead, rest = " ".join(f"l{i}" for i in range(12)), " ".join(f"r{i}" for i in range(12))
    docs = [(i, f"{lead} {w} {rest}", "s") for i, w in enumerate(twins())]
    assert not any(r.n_links for r in near_dedup.near_duplicates(documents(spark, docs)).collect())


def test_odd_rows(spark):
    rows = near_dedup.near_duplicates(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    compared(rows, [x[:2] for x in ODD])


def test_one_row_of_each_class_stays(spark):
    left = near_dedup.deduplicate(documents(spark, ODD))
    assert left.columns == documents(spark, ODD).columns
    # (1, "a b  c...") stands for five rows, (2, ...) twice and a null id among them; texts without words all stay
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 7, 6]))
    long = " ".join(f"w{i}" for i in range(50))
    docs = [(1, long, "s"), (2, long + " x", "s"), (2, "an unrelated text that shares an id", "s"), (9, "twice", "s"), (9, "twice", "s"), (None, long + " y", "s")]
    left = near_dedup.deduplicate(documents(spark, docs))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [docs[0][:2], docs[2][:2], docs[3][:2]]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).collect() == []
    assert near_dedup.deduplicate(documents(spark, [])).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_bands_reach_the_recall(threshold):
    bands, rows = near_dedup.bands_for(threshold, 0.999)
    assert bands * rows <= near_dedup.MAX_HASHES
    assert 1 - (1 - threshold**rows) ** bands >= 0.999
