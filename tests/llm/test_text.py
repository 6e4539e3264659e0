import itertools

import numpy as np
import pyarrow as pa
from test_substring_dedup import twins

from ridgeline.llm import text


def both(words):
    w = text.Words(pa.array([" ".join(words)]))
    assert list(w.counts) == [len(words)]
    return w.hashes, w.others


def structured():
    yield from (f"{a}{i}" for a in ("a", "b", "_") for i in range(200_000))
    yield from ("".join(x) for x in itertools.product("ab", repeat=16))
    yield from ("ab" * i for i in range(1, 800))
    yield from ("".join(x) for x in itertools.product("01234567", repeat=6))
    yield from ("x" * i + "y" + "x" * (400 - i) for i in range(400))


def test_a_million_structured_words_have_hashes_of_their_own():
    words = list(dict.fromkeys(structured()))
    assert len(words) > 900_000
    for h in both(words):
        assert len(np.unique(h)) == len(words)


def test_words_of_any_length_and_place():
    words = [*twins(), "a", "ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "\0", "\0\0", "é", "x" * 70_000]
    one, two = both(words)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    again = text.Words(pa.array([" ".join(reversed(words)), None, "  ab\n", words[0]]))
    assert again.hashes[: len(words)].tolist() == one[::-1].tolist() and again.hashes[len(words) :].tolist() == [one[3], one[0]]
    assert again.others[: len(words)].tolist() == two[::-1].tolist()


def test_windows_of_regular_sequences():
    # sequences of two words that a polynomial of word hashes can't tell apart
    a = np.array([7], np.uint64)
    b = np.array([7 + (1 << 40)], np.uint64)
    for _ in range(10):
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    assert text.window_hashes(a, 1024)[0] != text.window_hashes(b, 1024)[0]
    w = np.arange(100, dtype=np.uint64)
    for size in (1, 2, 3, 5, 20, 100):
        whole = text.window_hashes(w, size)
        assert len(whole) == 101 - size and all(text.window_hashes(w[i : i + size], size)[0] == whole[i] for i in range(len(whole)))
