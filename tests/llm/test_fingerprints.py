import hashlib
import random

import numpy as np
from helpers import ODD, SF, documents

from ridgeline.llm import fingerprints as fp

WALKS = fp.Walks()


def plain(text):
    """One step of the walk at a time."""
    stood, i = [], 0
    while i < len(text):
        c = ord(text[i])
        stood.append(c)
        i += bool(WALKS.moves[(len(stood) - 1) % fp.PERIOD, ((c * 0x9E3779B1) & 0xFFFFFFFF) >> 24])
    if not stood:
        return "0" * fp.SAMPLES
    steps = [max(x for x in r.tolist() if x < len(stood)) for r in WALKS.records]
    return "".join(f"{int(fp._mixed(np.array([stood[j]], np.uint64) * WALKS.factors[k : k + 1])[0]) >> 60:x}" for k, j in enumerate(steps))


def brute(rows):
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5((x[1] or "").encode()).hexdigest()))
    out = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = plain(t), plain(edited), plain(after)
        near = [max(0.0, (sum(x == y for x, y in zip(a, z)) / 256 - 1 / 16) * 16 / 15) for z in (b, c)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, *(round(x, 9) for x in near)))
    return sorted(out, key=str)


def collected(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    return sorted(((*(r[c] for c in names), round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collected(fp.op13(spark, SF)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [x[:2] for x in ODD]
    assert collected(fp.with_edited(documents(spark, ODD))) == brute(rows)
    assert fp.with_edited(documents(spark, [])).collect() == []
    one = [(5, "alone é", "s")]
    assert collected(fp.with_edited(documents(spark, one))) == brute([one[0][:2]])
    monkeypatch.setattr(fp, "RANGE_BYTES", 50)  # many ranges
    monkeypatch.setattr(fp, "WALKED", 40)
    many = [(i // 2 if i % 5 else None, "x" * (i % 7) + f"text {i % 11}", "s") for i in range(90)]
    assert collected(fp.with_edited(documents(spark, many))) == brute([x[:2] for x in many])


def test_walks_of_many_and_few_texts_agree():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([97, 98, 233, 0x65E5, 0x1F600, 32])) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert WALKS.fingerprints(texts) == [WALKS.fingerprints([t])[0] for t in texts] == [plain(t) for t in texts]


def test_likeness_falls_with_edits():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(2000)) for _ in range(60)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(2)] = rng.choice(["", "z", "qq"])
        return "".join(t)

    means = [np.mean([fp.likeness(a, b) for a, b in zip(WALKS.fingerprints(texts), WALKS.fingerprints([edited(t, k) for t in texts]))]) for k in (0, 1, 10, 100)]
    assert means[0] == 1 and means[1] > 0.9 and means[2] > 0.6 and sorted(means, reverse=True) == means and means[3] < 0.5


def test_column(spark):
    df = fp.fingerprinted(documents(spark, ODD))
    assert df.columns[:-1] == documents(spark, ODD).columns
    assert all(r.fingerprint == plain(r.text or "") for r in df.collect())


def classes(docs, threshold=0.8):
    """By comparing all pairs of fingerprints."""
    prints = [WALKS.fingerprints([t or ""])[0] for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] and docs[j][1] and fp.likeness(prints[i], prints[j]) >= threshold - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def test_near_copies(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(300, 2000))) for _ in range(25)]
    docs = []
    for i in range(220):
        t = list(base[min(24, int(rng.expovariate(0.2)))])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8, 60])):
            t[rng.randrange(len(t))] = rng.choice(["", "z", "qq"])
        docs.append((i, "".join(t), "s"))
    for rows in (docs, ODD):
        got = sorted(((r.doc_id, r.class_id) for r in fp.near_copies(documents(spark, rows)).collect()), key=str)
        assert got == classes([x[:2] for x in rows])
    assert any(d != c for d, c in classes([x[:2] for x in docs]))
    assert fp.near_copies(documents(spark, [])).collect() == []
