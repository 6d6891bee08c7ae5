import hashlib
import random
import re
import zlib

import pytest

from litspark.llm import op11_conversation_repair as op11

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, uid long, pos string, edit long"
GOOD = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """Cheapest edits by a table over (row, state) that keeps the least (cost, audit) to the end, as whole strings."""
    fault = faults(rows)
    best = {(len(rows), s): x for s, x in {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}.items()}
    follow = lambda s, r: {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(r, {}).get(s)
    other = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for i in range(len(rows) - 1, -1, -1):
        role, text = rows[i][2], rows[i][3]
        late = 3 if fault[i] == "truncated" else 0
        def join(s, cost, edit, line, to):
            c, e, t = best[to]
            return (c + cost, edit + e, ((line,) if line is not None else ()) + t)
        for s in ("", "s", "u", "a"):
            options = [join(s, 4, "D", None, (i + 1, s))]
            if fault[i] not in ("blank", "duplicate"):
                options.append(join(s, 3 + late, "R", f"{other[s]}:{text}", (i + 1, other[s][0])))
                if (to := follow(s, role[:1])) is not None:
                    options.append(join(s, late, "K", f"{role}:{text}", (i + 1, to)))
            best[i, s] = min(options)
        for s in ("u", "a", "", "s", "u", "a"):
            best[i, s] = min(best[i, s], join(s, 3, "I", f"{other[s]}:", (i, other[s][0])))
    return best[0, ""]


def expected(rows):
    """The whole contract for the undamaged rows, by plain Python."""
    out, ids = {}, {r[0] for r in rows}
    kept = damage(rows)
    for conv in ids:
        mine = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode()))
        f = faults(mine)
        cost, audit, lines = plain(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        assert GOOD.fullmatch("".join(x[:1] for x in lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, conversations, longest, odd=True):
    r, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", "", " \n", "Wait ", "Go!  ", "one. two", "é漢字.", "\U0001f600", None, "Hm.\x0b"]
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "system", "user", "assistant"] + ["tool", "", None, "ußer"] * odd) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t * r.choice([1, 1, 2]) if r.random() < 0.9 else None, role, r.choice(texts) if r.random() < 0.5 else f"turn {t} of {c}{r.choice(['.', '', '?'])}"))
    # One row a turn: what is within a turn is ordered by role, then by a hash.
    return list({(c, t, "" if role is None else role): (c, t, role, x) for c, t, role, x in rows}.values())


def repaired(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(3)
    turns, stats = op11.repair(op11.damaged(df), **kw)
    d = {r.conv: (r.audit, r.sha) for r in op11.digests(turns).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *d.get(r.conv, ("", hashlib.sha256(b"").hexdigest()))) for r in stats.collect()}


def test_recurrence_against_all_edits():
    """Every sequence of edits up to a length, tried out."""
    from itertools import product
    for n in range(4):
        for codes in product(range(16), repeat=n):
            if n == 3 and random.Random(str(codes)).random() > 0.05:
                continue
            v, gain = op11.vectors(bytes(codes), op11.END)
            rows = [(0, i, {0: "tool", 1: "system", 2: "user", 3: "assistant"}[c >> 2], {0: f"x{i}.", 1: f"x{i}", 2: "", 3: f"x{i}."}[c & 3]) for i, c in enumerate(codes)]
            if any(c & 3 == 3 for c in codes):
                continue
            cost, audit, _ = plain(rows)
            state, edits = 0, ""
            for i, c in enumerate(codes):
                e, state = op11.step(c, v[i + 1], state)
                edits += e
            assert (v[0][0] + gain, edits + "I" * (op11.END[state] // 3)) == (cost, audit)


@pytest.mark.parametrize("chunk,size", [(2, 40), (8, 1 << 20), (4096, 1 << 20)])
def test_against_plain_python(spark, monkeypatch, chunk, size):
    monkeypatch.setattr(op11, "SLICE", size)
    rows = [r for seed, (c, n) in enumerate([(30, 9), (3, 60), (1, 300)]) for r in ((10 * r0[0] + seed, *r0[1:]) for r0 in made(seed, c, n))]
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none"), (-5, None, None, None)]
    got, want = repaired(spark, rows, chunk=chunk), expected(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {k: got.get(k, empty) for k in want} == want and set(got) <= set(want)


def test_rows_that_never_settle_alone(spark):
    """Clean alternations keep two vectors apart: each pass settles one more chunk."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(64)] + [(2, t, "user", f"turn {t}.") for t in range(40)]
    assert repaired(spark, rows, chunk=4) == expected(rows)


def test_repeated_and_long_rows(spark):
    long = "The quick brown fox. " * 30000
    rows = [(1, 1, "user", long), (1, 1, "user", long), (1, 2, "assistant", "fine."), (1, 3, "assistant", "fine."), (2, 7, "user", "x")] * 2
    got = repaired(spark, rows)
    assert got == {k: v for k, v in expected(rows).items() if k in got}


def test_edits_are_rows(spark):
    df = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("assistant", "A."), ("user", ""), ("user", "U"), ("tool", "T.")])],
                               "conv long, turn long, role string, text string")
    turns, stats = op11.repair(df)
    rows = [(t.edit, t.role, t.text) for t in sorted(turns.collect(), key=lambda t: (t.pos, t.no))]
    cost, audit, lines = plain([tuple(r) for r in df.collect()])
    assert "".join(e for e, _, _ in rows) == audit and stats.collect()[0].cost == cost
    assert tuple(f"{r}:{x}" for e, r, x in rows if e != "D") == lines


def test_empty_table(spark):
    assert repaired(spark, []) == {}


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op11.op11_conversation_repair(spark, SF).collect()}
    assert got == expected(rows)
