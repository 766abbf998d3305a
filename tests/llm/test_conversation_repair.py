import hashlib
import itertools
import random
import re
import zlib

import pytest

from factorweave.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for r in rows:
        bare = r[1].strip(SPACE)
        out.append("blank" if not bare else "duplicate" if r in seen else "fine" if bare[-1] in ".!?" else "truncated")
        seen.add(r)
    return out


def exhaustive(rows):
    """(cost, audit, repaired) by trying every string of edits up to three inserts in a row."""
    faults, best = faults_of(rows), None
    runs = ["", *(["".join(x) for k in (1, 2, 3) for x in itertools.product("ua", repeat=k)])]
    name = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*[[(i, e) for i in runs for e in ("D", "K", "Ru", "Ra")] for _ in rows]):
        if any(e[0] != "D" and f in ("blank", "duplicate") for (_, e), f in zip(edits, faults)):
            continue
        for tail in runs:
            cost, audit, out = 2 * len(tail), "", []
            for (run, e), (role, text), f in zip(edits, rows, faults):
                out += [(name[x], "") for x in run]
                audit += "I" * len(run) + e[0]
                cost += 2 * len(run) + {"D": 3, "K": 0, "R": 2}[e[0]] + (e[0] != "D" and f == "truncated")
                if e[0] != "D":
                    out.append((name[e[1]] if e[0] == "R" else role, text))
            out += [(name[x], "") for x in tail]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                best = min(best or (cost, audit + "I" * len(tail), out), (cost, audit + "I" * len(tail), out), key=lambda x: x[:2])
    return best


def simple(rows):
    """(cost, audit, repaired) by a search over whole strings, state by state."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    layer = {"": (0, "", ())}

    def inserted(layer):
        out = {s: [x] for s, x in layer.items()}
        for s, (c, a, o) in layer.items():
            for _ in range(2):
                s = after[s]
                c, a, o = c + 2, a + "I", (*o, (name[s], ""))
                out.setdefault(s, []).append((c, a, o))
        return out

    for (role, text), fault in zip(rows, faults_of(rows)):
        new = {}
        for s, ways in inserted(layer).items():
            for c, a, o in ways:
                new.setdefault(s, []).append((c + 3, a + "D", o))
                if fault in ("blank", "duplicate"):
                    continue
                c += fault == "truncated"
                new.setdefault(after[s], []).append((c + 2, a + "R", (*o, (name[after[s]], text))))
                if role[:1] == after[s] or (role[:1] == "s" and s == ""):
                    new.setdefault(role[0], []).append((c, a + "K", (*o, (role, text))))
        layer = {s: min(w) for s, w in new.items()}
    return min(w for s, ways in inserted(layer).items() if s in ("", "a") for w in ways)


def plain(conv_id, rows):
    """The report of one conversation from its (turn, role, text) in the table."""
    damaged = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return report(conv_id, damaged)


def report(conv_id, damaged):
    turns, own = {r[0] for r in damaged if r[0] is not None}, [r[1:] for r in damaged]
    faults, initials = faults_of(own), [r[0][:1] for r in own]
    cost, audit, out = simple(own)
    lines = "\n".join(f"{r}:{t}" for r, t in out)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(lines.encode()).hexdigest())


ROLES, TEXTS = ["system", "user", "assistant", "tool", " ", ""], ["Yes.", "No", "", " \t", "Why?", "So!  \n"]


def test_simple_is_the_exhaustive_search():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]
        cost, audit, out = exhaustive(rows)
        assert simple(rows) == (cost, audit, tuple(out))


def test_ranks_equal_whole_strings():
    rng = random.Random(2)
    for _ in range(3000):
        rows = [(rng.choice(ROLES[: rng.choice([3, 6])]), rng.choice(TEXTS[: rng.choice([1, 6])]) + str(rng.randrange(4))[: rng.choice([0, 1])]) for _ in range(rng.randrange(9))]
        got = cr._solve(1, [(i, *r) for i, r in enumerate(rows)])
        assert (got["cost"], got["audit"], tuple((t["role"], t["text"]) for t in got["turns"] if t["edit"] != "D")) == simple(rows)


def test_codes_are_ordered_and_prefix_free():
    assert cr.CODES == ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
    assert not any(a != b and b.startswith(a) for a in cr.CODES for b in cr.CODES)


def conversations():
    rng = random.Random(3)
    out = {c: [(i + (i > 5), rng.choice(ROLES[:3]), rng.choice(TEXTS) + f"{rng.randrange(3)}."[: rng.randrange(3)]) for i in range(rng.choice([1, 2, 5, 9, 30]))] for c in range(60)}
    out[100] = [(None, "user", "a."), (None, None, None), (3, "user", None), (3, "user", "a."), (3, "user", "a.")]
    out[None] = [(0, "user", "null id"), (1, "assistant", "é漢.")]
    out[-5] = [(i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(300)]
    out[101] = [(0, "user", "x" * 100_000)]
    drop = next(c for c in range(200, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out[drop] = [(0, "user", "It goes.")]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, no int, audit string, present boolean"


def table(spark, talks):
    rows = [(c, *r, 1, "clash", None) for c, own in talks.items() for r in own]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("most_bytes", "chunk_rows"), [(1 << 26, 4096), (0, 1), (0, 3), (2000, 50)])
def test_equals_plain(spark, most_bytes, chunk_rows):
    talks = conversations()
    got = cr.repair(cr.damaged(table(spark, talks)), present_col="present", most_bytes=most_bytes, chunk_rows=chunk_rows).digests()
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(c, own) for c, own in talks.items()), key=repr)


@pytest.mark.parametrize("most_bytes", [1 << 26, 0])
def test_rows_of_the_result(spark, most_bytes):
    """Without damage; whatever the pieces, the turns that stay are those of the whole."""
    talks = {c: own for c, own in conversations().items() if c is not None}
    got = cr.repair(table(spark, talks), most_bytes=most_bytes, chunk_rows=4).turns().orderBy("conv_id", "no", "at").collect()
    by = {c: [(r["role"], r["text"]) for r in own] for c, own in itertools.groupby(got, key=lambda r: r["conv_id"])}
    for c, own in talks.items():
        rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert tuple(by.get(c, ())) == simple([r[1:] for r in rows])[2]


def test_no_rows(spark):
    assert cr.repair(table(spark, {})).digests().collect() == []


def test_query_on_the_whole_table(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = sorted(map(tuple, cr.op12_conversation_repair(spark, sf).collect()))
    assert got == sorted(plain(c, own) for c, own in talks.items())
