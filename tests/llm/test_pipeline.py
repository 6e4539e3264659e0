from collections import Counter

from helpers import SF, words
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import mixing, packing


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        rows = after.count()
        if name != "mixing":
            assert after.select("doc_id").distinct().count() == rows
            assert after.join(before, docs.columns, "left_anti").isEmpty()
            counts.append(rows)
        before = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, before, SF)
    assert packed.selectExpr("max(offset + length)").first()[0] <= 2048


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long, "en", "a", 1), (1, long, "en", "a", 1), (1, "another text of the same id", "en", "a", 2), (2, long + " x", "en", None, 3), (3, None, None, "b", None),
        (4, "", "en", "b", 0), (5, " \n", "en", "b", 2), (None, "no id \u00e9 \u65e5\u672c", "en", None, 4), (None, "no id  \u00e9 \u65e5\u672c", "en", "a", 5), (6, "y " * 400_000, "de", "c", 800_000), (7, "short", "en", "c", 5),
    ]
    # names that stages might use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS sha", "1 AS n", "2 AS mark", "3 AS size", "array(1) AS `a.b`")


def test_odd_rows_through_all_stages(spark):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).checkpoint()
    assert clean.columns == docs.columns and clean.count() == 11
    once = stages["exact_dedup"](spark, clean, SF).checkpoint()
    # the repeated row, the blank line's copies and the two texts that differ in white space
    assert once.columns == docs.columns and sorted(map(str, (r.doc_id for r in once.collect()))) == sorted(map(str, [1, 1, 2, 3, 5, None, 6, 7]))
    apart = stages["ngram_jaccard"](spark, once, SF).checkpoint()
    assert apart.columns == docs.columns and sorted(map(str, (r.doc_id for r in apart.collect()))) == sorted(map(str, [1, 1, 3, 5, None, 6, 7]))
    mixed = stages["mixing"](spark, apart, SF).checkpoint()
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in mixing.mix(apart).collect())
    packed = stages["packing"](spark, mixed, SF).collect()
    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for p in packed:
        got[p.doc_id] += p.length
        assert p.offset + p.length <= 2048
    assert got == want
