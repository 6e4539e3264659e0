import hashlib
import re
from collections import defaultdict

from helpers import ODD, SF, documents

from ridgeline.llm import exact_dedup


def brute(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ids in groups.items():
        named = [x for x in ids if x is not None]
        keep, sha, seen = min(named, default=None), hashlib.sha256(t.encode()).hexdigest(), False
        for d in ids:
            out.append((d, keep, len(ids), d == keep and not seen, sha))
            seen |= d == keep
    return sorted(out, key=str)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op9(spark, SF).collect()), key=str)
    assert got == brute(docs)


def test_odd_rows(spark):
    df = documents(spark, ODD)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicates(df).collect()), key=str)
    assert got == brute([x[:2] for x in ODD])
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(x[0]) for x in got if x[3])


def test_filter_misses_no_copy(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_CELL_BITS", 16)
    docs = [(i, f"text {i % 3000}", "s") for i in range(9000)]
    rows = exact_dedup.duplicates(documents(spark, docs)).collect()
    assert sum(r.kept for r in rows) == 3000 and all(r.group_size == 3 for r in rows)


def test_empty_table(spark):
    assert exact_dedup.duplicates(documents(spark, [])).collect() == []
    assert exact_dedup.deduplicate(documents(spark, [])).collect() == []
