import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, SF, documents
from test_substring_dedup import twins
from tokenizers import Tokenizer

from ridgeline.llm import packing, tokens


def check(rows, docs, capacity=2048):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    ids_of = {}
    for doc, text, *_ in docs:
        ids = (*tok.encode(text or "", add_special_tokens=False).ids, 1)
        ids_of.setdefault((doc, len(ids)), ids)
        want[doc] += len(ids)
    got, sequences = Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        ids = ids_of[r.doc_id, r.doc_tokens]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    assert sorted(sequences) == list(range(len(sequences)))
    return padding / max(1, sum(want.values()))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op5(spark, SF).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.03


def test_odd_rows_and_small_capacity(spark):
    rows = packing.pack(documents(spark, ODD), packing.default_tokenizer(), capacity=16, keep_ids=True).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    assert sum(r.length for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD)
    assert all(len(r.ids) == r.length for r in rows)
    by = defaultdict(list)
    for r in rows:
        if r.doc_id == 7:
            by[r.doc_id].append((r.start, r.ids))
    assert sum((x for _, x in sorted(by[7])), []) == tok.encode("x" * 5000, add_special_tokens=False).ids + [1]


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), packing.default_tokenizer()).collect() == []


@pytest.mark.parametrize("lengths", [[1300] * 50, [1] * 5000, [2048] * 7, [1025, 1024, 1023], list(range(1, 2048))])
def test_plan_places_every_rank_once(lengths):
    plan = packing.plan(Counter(lengths))
    room = defaultdict(int)
    counts = Counter()
    ends = {n: c for n, c in Counter(lengths).items()}
    for n, kept in plan.whole.items():
        for part in (1024, n - 1024):
            ends[part] = ends.get(part, 0) + ends[n] - kept
        ends[n] = kept
    for i, (n, rank, seq, k, offset) in enumerate(plan.blocks):
        after = plan.blocks[i + 1][1] if i + 1 < len(plan.blocks) and plan.blocks[i + 1][0] == n else ends[n]
        assert (after - rank) % k == 0
        counts[n] += after - rank
        for s in range(seq, seq + (after - rank) // k):
            room[s] += k * n
    assert counts == {n: c for n, c in ends.items() if c}
    assert max(room.values()) <= 2048 and len(room) == plan.sequences


def test_units_encode_as_whole_texts():
    import random

    import pyarrow as pa

    random.seed(3)
    texts = ["", None, " ", "a  b", "a \n b", "it's  don't\t\tx", "x<|endoftext|>y", "a b", "　 c", " \n\tq"]
    texts += ["".join(random.choice(" \n\tab'1é$s") for _ in range(random.randint(0, 14))) for _ in range(2000)]
    e = tokens.Encoder(packing.default_tokenizer(), 1)
    ids, at = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], t


def test_words_that_polynomials_confuse(spark):
    docs = [(i, f"before {w} after", "s") for i, w in enumerate(twins())]
    check(packing.pack(documents(spark, docs), packing.default_tokenizer()).collect(), docs)


@pytest.mark.parametrize("how", ["batch", "cache"])
def test_units_that_collide_are_encoded_whole(monkeypatch, how):
    import pyarrow as pa

    monkeypatch.setattr(tokens.words, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64) + np.uint64(7))
    encoder, tok = tokens.Encoder(packing.default_tokenizer(), 1), Tokenizer.from_file(packing.default_tokenizer())
    batches = [["one two two", None, ""]] if how == "batch" else [["one"], ["two"], ["one"]]
    for texts in batches:
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_the_closest_ones(seed):
    import itertools
    import random

    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
    room = rng.randint(1, 64)
    goals = [room, *sorted(rng.sample(range(1, room + 1), min(room, rng.randint(0, 2))), reverse=True)]
    sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])}
    best = next((g for g in goals if g in sums), max(x for x in sums if x <= room))
    chosen, total = packing.fill(counts, room, goals)
    assert total == best == sum(n * k for n, k in chosen.items())
    assert all(0 < k <= counts[n] for n, k in chosen.items())
