import hashlib
import zlib
from collections import defaultdict

from helpers import SF, words

from ridgeline.llm import prefix_trie

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            mark = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, r, mark, x))
    return {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}


def brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below if x)
        full = {x[: len(x) - 1] for x in members if x}
        children = sum(len(x) == len(node) + 1 for x in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children, sum(x not in full for x in below), saved, sha))
    return sorted(out, key=str)


def family(paths):
    out = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = paths.get(c - c % 20, [])[:h] + path[h:]
    return out


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "'x' AS key", "array(1) AS path")


def collected(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=str)


def test_documents(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert collected(prefix_trie.op11(spark, SF)) == brute(family(ordered(rows)))


ODD = [
    (1, None, "user", "first of all"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 2, "user", ""),
    (2, 5, "user", "first of all"), (2, 6, "", ""), (3, None, "user", "first of all"), (3, 0, "", None), (None, 1, "user", "lost"), (-4, 1, "user", "x y"), (-4, 1, "user", "x y"),
]


def test_odd_rows(spark):
    assert collected(prefix_trie.prefix_trie(conversations(spark, ODD))) == brute(ordered(ODD))
    assert prefix_trie.prefix_trie(conversations(spark, [])).collect() == []


def test_copies_hot_turns_and_deep_paths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = []
    for c in range(130):
        if c < 50:
            path = ["hello there"] * 3  # copies
        elif c < 90:
            path = ["hello there", f"own {c % 9}", f"way {c}"]
        else:
            path = ["one", "two words"] * 11 + [f"end {c % 2}"] * (c % 40)  # long shared and lone stretches
        rows += [(c, i, "user" if i % 2 else "system", x) for i, x in enumerate(path)]
    paths = ordered(rows)
    assert collected(prefix_trie.prefix_trie(conversations(spark, rows))) == brute(paths)


def test_turnless_conversations(spark):
    rows = [(40, 0, "user", "a b"), (41, 0, "user", "own"), (44, 0, "user", "c"), (45, 0, "user", "d"), (45, 1, "user", "e"), (60, 0, "u", "z")]
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.steps(conversations(spark, rows))))
    assert collected(found) == brute(family(ordered(rows)))
    lost = conversations(spark, rows).where("conv_id NOT IN (40, 60)")
    assert collected(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.steps(lost)))) == brute(family(ordered(rows[1:5])))
