"""Token ids of texts by a tokenizers file, with each distinct word encoded once.

The byte-level pre-tokenizer splits text at white space (one preceding space
belongs to a word), so the ids of a text are those of its units in order: words
with their space, and what is left of each run of white space. Units repeat, so
a bounded cache of units saves most of the encoding. Texts with white space
outside ASCII or with an added token's string are encoded whole, by tokenizers.
Units are looked up by hash, and their bytes are compared on every hit; texts whose
units collide are encoded whole too.
New units are encoded by tiktoken with the ranks of the same file, which gives
the same ids in a third of the time, where the file's merges are in order of id;
else by tokenizers too.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from . import text as words

#: Units, ids and bytes of units in a task's cache, about 45 MB; when full it is emptied.
CACHE_UNITS, CACHE_IDS, CACHE_BYTES = 400_000, 2_000_000, 8_000_000

#: White space outside ASCII (fixed values, as UTF-8).
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


#: The pattern by which the byte-level pre-tokenizer splits text (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE file; None unless its merges are in order of id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, model = spec["model"]["vocab"], spec["model"]
    merged = [vocab["".join(x.split(" ")) if isinstance(x, str) else "".join(x)] for x in model["merges"]]
    kind = spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"] or merged != sorted(merged):
        return None
    # bytes that print stand for themselves, the others follow from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {x["content"] for x in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}


def unit_starts(data: np.ndarray, offsets: np.ndarray, whole: list[int]) -> np.ndarray:
    """Byte starts of the units of all rows; rows in ``whole`` are one unit each."""
    starts, ends, at = words.word_spans(data, offsets)
    mark = np.zeros(len(data) + 1, bool)
    if len(starts):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        previous = np.empty_like(starts)
        previous[1:] = ends[:-1]
        heads = at[:-1][np.diff(at) > 0]
        previous[heads] = offsets[row[heads]]
        gap = starts - previous
        spaced = (gap > 0) & (data[starts - 1] == 0x20)
        mark[starts - spaced] = True
        mark[starts[(gap > 0) & ~spaced] - 1] = True
        mark[previous[gap > 1]] = True
        tails = at[1:][np.diff(at) > 0] - 1
        mark[ends[tails]] = True  # white space at a row's end; else the next row's start
    mark[offsets] = True
    for i in whole:
        mark[offsets[i] + 1 : offsets[i + 1]] = False
    mark[len(data)] = False
    return np.flatnonzero(mark)


class Encoder:
    """``encode(texts)`` gives all ids in one array, ``end`` after each text, and the rows' offsets.

    A task makes its own: kept from task to task, it would stay in memory while workers serve other stages.
    """

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = end
        self.fast = None
        if found := ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})
            self.line = found[b"\n"]
        self.clear()

    def clear(self) -> None:
        self.keys, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 1
        self.ids[0] = self.end
        self.at = np.array([0, 1], np.int64)  # unit 0 is the end of a text
        self.units, self.bytes = [b""], 0

    def unit_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after the other, and each unit's number of ids."""
        if self.fast:
            # one call: a line feed parts from any unit that has no white space but a space before it
            ids = self.fast.encode_to_numpy(b"\n".join(units).decode())
            cuts = np.append(np.flatnonzero(ids == self.line), len(ids))
            lengths = np.diff(cuts, prepend=-1) - 1
            return np.delete(ids, cuts[:-1]), lengths
        found = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in units], add_special_tokens=False)]
        return np.fromiter((x for y in found for x in y), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, keys: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        """Cache new units. ``plain``: those that are a word; the others are encoded one by one."""
        order = np.argsort(~plain, kind="stable")
        keys, units, many = keys[order], [units[i] for i in order], int(plain.sum())
        ids, lengths = self.unit_ids(units[:many]) if many else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest = [self.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in units[many:]]
        ids = np.concatenate([ids, np.fromiter((x for y in rest for x in y), np.uint32)])
        lengths = np.concatenate([lengths, np.fromiter(map(len, rest), np.int64, len(rest))])
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        self.ids[self.used : need] = ids
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, self.used + np.cumsum(lengths)])
        self.used = need
        self.units += units
        self.bytes += sum(map(len, units))
        order = np.argsort(keys)
        keys, index = np.concatenate([self.keys, keys[order]]), np.concatenate([self.index, first + order])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.index = keys[order], index[order]

    def encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, by tokenizers and without the cache."""
        found = [[*self.tokenizer.encode(x or "", add_special_tokens=False).ids, self.end] for x in texts.to_pylist()]
        return np.fromiter((x for y in found for x in y), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > CACHE_UNITS or self.used > CACHE_IDS or self.bytes > CACHE_BYTES:
            self.clear()
        data, offsets = words.column_bytes(texts)
        raw = data.tobytes()
        odd = [_OTHER_SPACE.search, *((lambda x, t=t: t in x) for t in self.added)]
        whole = []
        if any(f(raw) for f in odd):
            whole = [i for i in range(len(offsets) - 1) if any(f(raw[offsets[i] : offsets[i + 1]]) for f in odd)]
        starts = unit_starts(data, offsets, whole)
        units = np.zeros(0, np.int64)
        if len(starts):
            ends = np.append(starts[1:], len(data))
            hashes = words.span_hashes(data, starts, ends)
            code, keys = pd.factorize(hashes)
            first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
            if not words.same_spans(data, starts, ends, first[code]):
                return self.encode_whole(texts)
            order = np.argsort(keys)
            keys, first = keys[order], first[order]
            near = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            new = self.keys[near] != keys if len(self.keys) else np.ones(len(keys), bool)
            known = np.flatnonzero(~new)
            if any(self.units[i] != raw[a:b] for i, a, b in zip(self.index[near[known]].tolist(), starts[first[known]].tolist(), ends[first[known]].tolist())):
                return self.encode_whole(texts)
            if new.any():
                at = first[new]
                plain = ~words.is_separator(data[ends[at] - 1])
                plain[np.isin(starts[at], offsets[whole])] = False
                self.learn(keys[new], [raw[starts[i] : ends[i]] for i in at], plain)
            index = np.empty(len(keys), np.int64)
            index[order] = self.index[np.searchsorted(self.keys, keys)]
            units = index[code]
        units = np.insert(units, np.searchsorted(starts, offsets[1:]), 0)
        row_ends = np.searchsorted(starts, offsets[1:]) + np.arange(1, len(offsets))
        begin, length = self.at[units], self.at[units + 1] - self.at[units]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], length)]
        return ids, np.concatenate([[0], total[row_ends]])
