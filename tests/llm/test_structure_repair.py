import hashlib
import itertools
import random
import re
import zlib

from helpers import SF

from ridgeline.llm import structure_repair as sr

LANGUAGE = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out, ids = [], set()
    for c, t, r, x in rows:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out, ids


def search(rows):
    """(cost, audit, repaired) by brute force over all edits with at most two inserts at each place."""
    best = None
    choices = []
    for role, text, gone, extra in rows:
        own = [("D", 4, None)]
        if not gone:
            own += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        choices.append(own)
    inserts = [("", 0, ())] + [("I", 3, ((x, ""),)) for x in ("user", "assistant")] + [("II", 6, ((x, ""), (y, ""))) for x in ("user", "assistant") for y in ("user", "assistant")]
    for edits in itertools.product(*[list(itertools.product(inserts, c)) for c in choices], inserts):
        out, audit, cost = [], "", 0
        for e in edits[:-1]:
            audit += e[0][0] + e[1][0]
            cost += e[0][1] + e[1][1]
            out += [*e[0][2], *([e[1][2]] if e[1][2] else [])]
        audit, cost, out = audit + edits[-1][0], cost + edits[-1][1], out + list(edits[-1][2])
        if (best is None or (cost, audit) < best[:2]) and LANGUAGE.fullmatch("".join(r[:1] or "-" for r, _ in out)):
            best = (cost, audit, out)
    return best


def states(rows):
    """(cost, audit, repaired) by a plain pass over states, every candidate kept as a whole string."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
    here = {"": (0, "", [])}

    def inserted(at):
        out = {q: [v] for q, v in at.items()}
        for q, (cost, audit, rows_) in at.items():
            for _ in range(2):
                name = "assistant" if q == "u" else "user"
                q, cost, audit, rows_ = step[q][name[0]], cost + 3, audit + "I", [*rows_, (name, "")]
                out.setdefault(q, []).append((cost, audit, rows_))
        return out

    for role, text, gone, extra in rows:
        found = {}
        for q, of in inserted(here).items():
            for cost, audit, rows_ in of:
                found.setdefault(q, []).append((cost + 4, audit + "D", rows_))
                if not gone:
                    if role[:1] in step[q]:
                        found.setdefault(step[q][role[:1]], []).append((cost + extra, audit + "K", [*rows_, (role, text)]))
                    name = "assistant" if q == "u" else "user"
                    found.setdefault(step[q][name[0]], []).append((cost + 3 + extra, audit + "R", [*rows_, (name, text)]))
        here = {q: min(of, key=lambda x: x[:2]) for q, of in found.items()}
    return min((x for q, of in inserted(here).items() if q in ("", "ua") for x in of), key=lambda x: x[:2])


def brute(rows, ids):
    out = []
    for c in ids:
        own = sorted(((t is not None, t or 0, r, x) for d, t, r, x in rows if d == c))
        turns = [t for there, t, _, _ in own if there]
        seen, edits, counts, illegal = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
        for i, (_, _, r, x) in enumerate(own):
            last = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            edits.append((r, x, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
            illegal += i > 0 and own[i - 1][2][:1] + r[:1] not in ("su", "ua", "au")
        cost, audit, done = states(edits)
        if len(edits) <= 2:
            assert search(edits)[:2] == (cost, audit)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest()))
    return sorted(out, key=str)


FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def collected(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "'x' AS there_", "array(1) AS copy")


def test_documents(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert collected(sr.op12(spark, SF)) == brute(*damage(rows))


def test_odd_rows(spark):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user"], ["Yes.", "no", "", " \n", None, "Why?  \n", "é!", "x" * 3000 + "."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None, -3] for _ in range(rng.randrange(1, 9))]
    assert collected(sr.repair(sr.damaged(conversations(spark, rows)), there="there")) == brute(*damage(rows))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert collected(sr.repair(conversations(spark, rows))) == brute(plain, {x[0] for x in rows})
    assert sr.repair(conversations(spark, [])).collect() == []


def test_any_grammar_gives_the_same_repairs(spark):
    rng = random.Random(3)
    sequences = [[rng.randrange(sr.TERMINALS) for _ in range(rng.randrange(30))] for _ in range(80)] + [[2, 4] * 60, [2] * 33, [2, 5, sr.GONE] * 20]
    df = spark.createDataFrame([(x,) for x in sequences], "symbols array<int>")
    shared = sr.grammar(df, 60, 6)
    assert len(shared.matrices) > sr.TERMINALS + 20 and len(shared.compressed([2, 4] * 60)) < 40
    plain = sr.Grammar()

    def rows(symbols):
        return [("t", "", True, 0) if x == sr.GONE else ({0: "s", 1: "u", 2: "a", 3: "t"}[x // 2], "", False, 3 * (x % 2)) for x in symbols]

    for x in sequences:
        assert shared.repair(x) == plain.repair(x) == states(rows(x))[:2]


def test_long_conversation(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"text {i}" + "." * (i % 5 > 0)) for i in range(20_000)]
    (row,) = sr.repair(conversations(spark, rows)).collect()
    kept = [(r, x, False, 3 * (not x.endswith("."))) for _, _, r, x in rows]
    assert len(row.audit) >= 20_000 and row.truncated == sum(e > 0 for *_, e in kept)
    assert re.fullmatch(LANGUAGE, "".join(x.role[0] for x in row.repaired))
