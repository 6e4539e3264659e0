import numpy as np
from helpers import ODD, SF, documents

from ridgeline.llm import toxicity


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 10 < 5")
    held = {r.doc_id: r.toxic for r in labels.where("doc_id % 10 >= 5").collect()}
    rows = [r for r in toxicity.toxicity(docs, train).collect() if r.doc_id in held]
    truth, called = np.array([held[r.doc_id] for r in rows]), np.array([r.toxic for r in rows])
    recall, wrong = called[truth == 1].mean(), called[truth == 0].mean()
    print("recall", recall, "false", wrong)
    # some toxic rows of these tables are junk without a toxic word left
    assert recall > 0.8 and wrong < 0.01
    assert all((r.p_toxic >= toxicity.DECISION) == r.toxic and 0 <= r.expected_severity <= 3 for r in rows)
    # grades rise with severity
    means = [np.mean([r.expected_severity for r in rows if r.grade == g]) for g in sorted({r.grade for r in rows})]
    assert means == sorted(means)


def test_fit_recovers_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)) < 0.5
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    grade = (score > 0).astype(int) + (score > 1) + (score > 3)
    row, feature = np.nonzero(x)
    w, b = toxicity.fit_ordinal(row, feature, grade, 3)
    assert np.abs(w - [2, -1, 0]).max() < 0.25 and np.abs(b - [0, -1, -3]).max() < 0.25


def test_odd_rows(spark):
    docs = documents(spark, ODD + [(20, "bad bad bad", "s"), (21, "bad word", "s")])
    labels = spark.createDataFrame([(20, 1), (21, 1), (1, 0), (2, 0), (3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.doc_id for r in rows if r.toxic} <= {20, 21}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.toxic for r in rows)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(documents(spark, []), labels).collect() == []
    rows = toxicity.toxicity(documents(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and not any(r.toxic for r in rows)


def test_scores_against_a_plain_version(spark):
    """Sums over a text's set of features, one text and one feature at a time."""
    import math

    import numpy as np

    from ridgeline.llm import text as words_of

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))
    known = dict(zip(model.keys.tolist(), model.weights))

    def weight(piece, k):
        h = int(words_of.span_hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0])
        return known.get(h ^ (0xA24BAED4963EE407 * k & (1 << 64) - 1) if k else h, 0.0)

    def plain(text):
        folded = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text)
        found = set()
        for w in folded.split(" "):
            raw = w.encode()
            if raw:
                found.add((raw, 0))
            for k in (4, 5, 6):
                if len(raw) >= k:
                    cut = k
                    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                        cut += 1
                    found.add((raw[:cut], k))
        score = sum(weight(p, k) for p, k in found)
        return [1 / (1 + math.exp(-(score + t))) for t in model.thresholds]

    rows = toxicity.score(docs, model).collect()
    assert len(model.keys) or all(r.severity.p_toxic < 1e-9 for r in rows)
    for r in rows:
        want = plain(r.text or "")
        assert abs(r.severity.p_toxic - want[0]) < 1e-9 and abs(r.severity.expected - sum(want)) < 1e-9
