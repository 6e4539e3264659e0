"""Every operator on texts of five million characters, of words and of single runs."""

import random
import string
import time

import pytest
from helpers import documents

from ridgeline.llm import exact_dedup, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, quality_rules, secrets, substring_dedup, toxicity


@pytest.fixture(scope="module")
def table(spark):
    long = "\n".join(" ".join(f"w{i % 977}x{j}" for j in range(i, i + 12)) for i in range(52_000))
    return documents(spark, [(1, long, "a"), (2, "short text", "b"), (3, None, None)]).checkpoint()


#: One unbroken run each.
RUNS = {
    "letters": "ab" * 2_500_000, "one letter": "a" * 5_000_000, "dots": "." * 5_000_000, "dashes": "-" * 5_000_000, "digits": "0123456789" * 500_000, "spaces": " " * 5_000_000, "newlines": "\n " * 2_500_000,
    "labels": "a." * 2_500_000, "keyword": "licence. " + "- " * 2_500_000, "base64": "".join(random.Random(1).choices(string.ascii_letters + string.digits + "+/", k=5_000_000)),
}


@pytest.fixture(scope="module")
def runs(spark):
    return documents(spark, [(i, f"see ab:12 the licence. {x} ab: secret", "a") for i, x in enumerate(RUNS.values())]).checkpoint()


OPERATORS = [
    ("licenses", lambda df: licenses.recognise(df)), ("near", lambda df: near_dedup.near_duplicates(df)), ("substring", lambda df: substring_dedup.remove_repeats(df, texts=False)),
    ("lines", lambda df: line_dedup.remove_boilerplate(df)), ("packing", lambda df: packing.pack(df, packing.default_tokenizer()).groupBy("doc_id").count()),
    ("toxicity", lambda df: toxicity.toxicity(df, df.selectExpr("doc_id", "int(doc_id = 2) AS toxic"))), ("mixing", lambda df: mixing.mix(df)),
    ("quality", lambda df: quality_rules.quality(df, df.selectExpr("doc_id", "int(doc_id = 2) AS quality"))), ("exact", lambda df: exact_dedup.duplicates(df)), ("secrets", lambda df: secrets.scan(df)),
    ("fingerprints", lambda df: fingerprints.with_edited(df)),
]


@pytest.mark.parametrize("name,run", OPERATORS)
def test_a_very_long_text(spark, table, name, run):
    assert len(run(table).collect()) == 3


@pytest.mark.parametrize("name,run", OPERATORS)
def test_long_runs(spark, runs, name, run):
    began = time.time()
    assert len(run(runs).drop("text", "spans", "kept").collect()) == len(RUNS)
    assert time.time() - began < 120  # 50 MB; a quadratic step takes hours
