import hashlib
import random

import pytest
import xxhash
from helpers import ODD, SF, documents, words

from ridgeline.llm import substring_dedup


def brute(docs, window=20):
    seen, out = set(), []
    digest = lambda t: (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64) - (1 << 63)
    for doc, text in sorted(docs, key=lambda x: (x[0] is None, digest(x[1]) if x[0] is None else x[0], x[1] or "")):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = found(substring_dedup.op3(spark, SF))
    assert got == brute(docs)
    assert any(x[2] for x in got)


def test_random_repeats_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    rng = random.Random(5)
    passages = [[f"p{i}_{j}" for j in range(rng.randint(15, 60))] for i in range(8)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += [rng.choice("abc") for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            s = rng.randint(0, 10)
            w += p[s:]
        docs.append((i, "  ".join(w), "s"))
    df = substring_dedup.remove_repeats(documents(spark, docs))
    assert found(df) == brute([x[:2] for x in docs])
    rows = df.collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and sum(s.words for s in r.spans) == r.n_removed for r in rows)


def test_windows_with_one_hash_and_other_words_differ():
    import numpy as np
    import pyarrow as pa

    def row(chunk, hashes, checks, ids):
        h, c = np.array(hashes, np.uint64), np.array(checks, np.uint64)
        return {"chunk": chunk, "windows": h.tobytes(), "checks": c.tobytes(), "at": np.arange(len(h), dtype=np.uint32).tobytes(), "nulls": np.packbits(np.zeros(len(h), bool)).tobytes(), "ids": np.array(ids, np.int64).tobytes()}

    group = pa.Table.from_pylist([row(0, [5, 9], [1, 1], [10, 10]), row(1, [5, 9], [2, 1], [20, 20])])
    assert [(c, list(np.frombuffer(at, np.uint32))) for c, at in substring_dedup._later(group)] == [(1, [1])]


@pytest.mark.parametrize("window,block", [(3, 2), (5, 2), (20, 10), (20, 7)])
def test_small_windows(spark, window, block):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))), "s") for i in range(40)]
    assert found(substring_dedup.remove_repeats(documents(spark, docs), window=window, block=block)) == brute([x[:2] for x in docs], window)


def test_rows_without_ids_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    rng = random.Random(9)
    docs = [(rng.choice([None, None, i // 3]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70))), "s") for i in range(120)]
    assert found(substring_dedup.remove_repeats(documents(spark, docs), window=9, block=5)) == brute([x[:2] for x in docs], 9)


def test_odd_rows(spark):
    assert found(substring_dedup.remove_repeats(documents(spark, ODD))) == brute([x[:2] for x in ODD])
    assert found(substring_dedup.remove_repeats(documents(spark, ODD), window=3, block=2)) == brute([x[:2] for x in ODD], 3)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).collect() == []


def twins():
    """Two words of 1,024 letters that hashes by powers of an odd base don't tell apart."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    lead, rest = " ".join(f"l{i}" for i in range(12)), " ".join(f"r{i}" for i in range(12))
    docs = [(i, f"{lead} {w} {rest}", "s") for i, w in enumerate(twins())]
    got = found(substring_dedup.remove_repeats(documents(spark, docs)))
    assert got == brute([x[:2] for x in docs]) and not any(x[2] for x in got)
