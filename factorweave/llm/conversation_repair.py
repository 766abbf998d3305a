"""Repair of broken conversations by the cheapest edits that give the roles (s?(ua)+)?.

The roles are read by an automaton of four states: nothing yet, after the system turn, after
a user's, after an assistant's turn.  What happens at one turn is a macro edit: a run of
inserts and then Delete, Keep or Rerole, written I...D, I...K, I...R.  No such code begins another,
so audit strings of equally many turns compare as their sequences of codes do.  A layer
holds for each state the least cost, and in place of its least audit the audit's rank among the
layer's and a pointer to its parent; the audit is read off the pointers at the end.

A chunk of turns is a function: for each start and end state the cost, and the rank among
those of the start.  Functions compose associatively (distinct states have distinct audits, so the
rank of the first part decides a tie), which lets the chunks of a huge conversation be solved
wherever they lie.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import ordered, saved, small_batches

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What a user's or assistant's turn after a state is, and the state it leads to.
_NEXT = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
INSERT, REROLE, DELETE, CUT_SHORT = 2, 2, 3, 1
#: Inserts that end a conversation from a state.
_ENDING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED, FINE = "blank", "duplicate", "truncated", "fine"

#: The macro codes in ASCII order; two inserts lead from any state to one that more can't better.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
_RANK = {c: i for i, c in enumerate(CODES)}


def _steps(initial: str, fault: str) -> list[list[tuple[int, int, int]]]:
    """For each state the (next state, cost, code) of the best macro edit of a turn to each next state."""
    more, out = CUT_SHORT if fault == TRUNCATED else 0, []
    for state in _NEXT:
        best: dict[int, tuple[int, int]] = {}
        at = state
        for k in range(3):
            ways = [("D", at, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                role, to = _NEXT[at]
                ways.append(("R", to, REROLE + more))
                if initial == role[0]:
                    ways.append(("K", to, more))
                if initial == "s" and at == EMPTY:
                    ways.append(("K", SYSTEM, more))
            for edit, to, cost in ways:
                new = (cost + INSERT * k, _RANK["I" * k + edit])
                best[to] = min(best.get(to, new), new)
            at = _NEXT[at][1]
        out.append([(to, *x) for to, x in best.items()])
    return out


_STEPS = {(i, f): _steps(i, f) for i in ("s", "u", "a", "") for f in (BLANK, DUPLICATE, TRUNCATED, FINE)}


def forward(turns: list[tuple[str, str]], start: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, tuple[int, int]]]]:
    """({state: (cost, rank)} after all turns, and for each layer {state: (parent state, code)}).

    turns: (initial of the role, fault) of each.
    """
    layer, back = {start: (0, 0)}, []
    for initial, fault in turns:
        steps = _STEPS[initial if initial in ("s", "u", "a") else "", fault]
        best: dict[int, tuple[int, int, int, int]] = {}
        for state, (cost, rank) in layer.items():
            for to, step, code in steps[state]:
                new = (cost + step, rank, code, state)
                if to not in best or new < best[to]:
                    best[to] = new
        ranks = {x: i for i, x in enumerate(sorted(v[1:3] for v in best.values()))}
        layer = {to: (v[0], ranks[v[1:3]]) for to, v in best.items()}
        back.append({to: (v[3], v[2]) for to, v in best.items()})
    return layer, back


def _end(layer: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) of the cheapest whole repair; ties by audit."""
    cost, _, state = min((cost + INSERT * _ENDING[s], rank, s) for s, (cost, rank) in layer.items())
    return cost, state


def _read_back(back: list[dict[int, tuple[int, int]]], state: int) -> tuple[list[str], int]:
    """(codes of all turns, start state) of the best way to a state."""
    codes = []
    for layer in reversed(back):
        state, code = layer[state]
        codes.append(CODES[code])
    return codes[::-1], state


def _rebuilt(rows: list[tuple[str, str]], codes: list[str], state: int, last: bool) -> list[dict]:
    """The edits in order, with what they leave: a deleted turn keeps its role and text here, but isn't in the result."""
    out = []

    def insert() -> None:
        nonlocal state
        role, state = _NEXT[state]
        out.append({"edit": "I", "role": role, "text": ""})

    for (role, text), code in zip(rows, codes, strict=True):
        for _ in code[:-1]:
            insert()
        edit = code[-1]
        if edit == "R":
            role, state = _NEXT[state]
        elif edit == "K":
            state = SYSTEM if role[:1] == "s" else _NEXT[state][1]
        out.append({"edit": edit, "role": role, "text": text})
    if last:
        for _ in range(_ENDING[state]):
            insert()
    return out


def _fault(text: str, again: bool) -> str:
    seen = text.rstrip(_SPACE)
    return BLANK if not seen else DUPLICATE if again else FINE if seen[-1] in ".!?" else TRUNCATED


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE_ARROW = pa.schema([("conv_id", pa.int64()), ("no", pa.int64()), ("pieces", pa.int64()), *[(c, pa.int64()) for c in _FACTS], ("audit", pa.string()), ("turns", _TURNS)])
_PIECE = f"conv_id long, no long, pieces long, {', '.join(f'{c} long' for c in _FACTS)}, audit string, turns array<struct<edit:string,role:string,text:string>>"
_MOST = (1 << 63) - 1


def _gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return min(max(known) - min(known) + 1 - len(set(known)), _MOST) if known else 0


def _solve(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> dict:
    """A whole conversation as one piece; rows: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(_fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    layer, back = forward(list(zip(initials, faults, strict=True)), EMPTY)
    cost, state = _end(layer)
    edits = _rebuilt([r[1:] for r in rows], _read_back(back, state)[0], EMPTY, True)
    counts = {f: faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)}
    return {"conv_id": conv_id, "no": 0, "pieces": 1, "gaps": _gaps([r[0] for r in rows]), **counts, "illegal": _illegal(initials), "cost": cost, "audit": "".join(e["edit"] for e in edits), "turns": edits}


def _whole(batches):
    """Conversations that lie in one task, in order; one is held at a time."""
    conv, rows, have = None, [], False
    for batch in batches:
        out = []
        for conv_id, present, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if have and conv_id != conv:
                out.append(_solve(conv, rows))
                rows = []
            conv, have = conv_id, True
            if present:
                rows.append(tuple(row))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)
    if have:
        yield pa.RecordBatch.from_pylist([_solve(conv, rows)], schema=_PIECE_ARROW)


_FUNCTION = "conv_id long, part int, block long, way array<array<int>>, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, different long"
_FUNCTION_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("way", pa.list_(pa.list_(pa.int32()))), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("least", "most", "different")]]
)


def _chunk(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[int]]:
    """(rows, what forward() needs of them, known turns) of a chunk in order."""
    table = table.sort_by("at")
    roles, texts, again = (table[c].to_pylist() for c in ("role", "text", "again"))
    faults = [_fault(t, a) for t, a in zip(texts, again, strict=True)]
    return list(zip(roles, texts, strict=True)), [(r[:1], f) for r, f in zip(roles, faults, strict=True)], [t for t in table["turn"].to_pylist() if t is not None]


def _function(key, table):
    """The chunk's function as (start, end, cost, rank) entries, and what its conversation's report needs."""
    _, needs, turns = _chunk(table)
    way = [[s, e, *x] for s in _NEXT for e, x in forward(needs, s)[0].items()]
    initials, faults = [i for i, _ in needs], [f for _, f in needs]
    ends = {"least": min(turns, default=None), "most": max(turns, default=None), "different": len(set(turns))}
    row = {**dict(zip(("conv_id", "part", "block"), (k.as_py() for k in key), strict=True)), "way": way, **{f: faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)}, "illegal": _illegal(initials), "first": initials[0], "last": initials[-1], **ends}
    return pa.Table.from_pylist([row], schema=_FUNCTION_ARROW)


_PATH = f"conv_id long, part int, block long, no long, pieces long, entry int, exit int, {', '.join(f'{c} long' for c in _FACTS)}"
_PATH_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("no", pa.int64()), ("pieces", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), *[(c, pa.int64()) for c in _FACTS]])


def _path(key, table):
    """The states between the chunks of one conversation, and its report."""
    chunks = table.sort_by([("part", "ascending"), ("block", "ascending")]).to_pylist()
    layer, back = {EMPTY: (0, 0)}, []
    for c in chunks:
        best: dict[int, tuple[int, int, int, int]] = {}
        for s, e, cost, rank in c["way"]:
            if s in layer:
                new = (layer[s][0] + cost, layer[s][1], rank, s)
                if e not in best or new < best[e]:
                    best[e] = new
        ranks = {x: i for i, x in enumerate(sorted(v[1:3] for v in best.values()))}
        layer = {e: (v[0], ranks[v[1:3]]) for e, v in best.items()}
        back.append({e: v[3] for e, v in best.items()})
    cost, state = _end(layer)
    states = [state]
    for b in reversed(back):
        states.append(b[states[-1]])
    states.reverse()
    known = [c for c in chunks if c["least"] is not None]
    different = sum(c["different"] for c in known) - sum(a["most"] == b["least"] for a, b in pairwise(known))
    gaps = min(known[-1]["most"] - known[0]["least"] + 1 - different, _MOST) if known else 0
    illegal = sum(c["illegal"] for c in chunks) + sum(_illegal([a["last"], b["first"]]) for a, b in pairwise(chunks))
    facts = {"gaps": gaps, **{f: sum(c[f] for c in chunks) for f in (BLANK, DUPLICATE, TRUNCATED)}, "illegal": illegal, "cost": cost}
    return pa.Table.from_pylist([{**{k: c[k] for k in ("conv_id", "part", "block")}, "no": i, "pieces": len(chunks), "entry": states[i], "exit": states[i + 1], **facts} for i, c in enumerate(chunks)], schema=_PATH_ARROW)


def _piece(key, table):
    """The repaired turns of a chunk whose entry and exit states are known."""
    rows, needs, _ = _chunk(table)
    way = {c: table[c][0].as_py() for c in ("conv_id", "no", "pieces", "entry", "exit", *_FACTS)}
    codes, start = _read_back(forward(needs, way["entry"])[1], way["exit"])
    edits = _rebuilt(rows, codes, start, way["no"] + 1 == way["pieces"])
    return pa.Table.from_pylist([{**{c: way[c] for c in ("conv_id", "no", "pieces", *_FACTS)}, "audit": "".join(e["edit"] for e in edits), "turns": edits}], schema=_PIECE_ARROW)


def _long(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Conversations in chunks: sorted over all tasks, so that a chunk's place tells its order."""
    kept = rows.where("present").withColumn("tie", F.monotonically_increasing_id())
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text"))
    table = ordered(kept.withColumn("digest", digest), ["conv_id", "turn", "role", "text", "tie"], "turns")
    table = table.withColumn("block", F.expr(f"at div {chunk_rows}"))
    place = F.struct("part", "at")
    first = table.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    table = table.join(first, "digest", "left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False)))
    table = saved(table.select("conv_id", "part", "block", "at", "turn", "role", "text", "again"), "flagged-turns")
    keys = ["conv_id", "part", "block"]
    paths = saved(table.groupBy(*keys).applyInArrow(_function, _FUNCTION).groupBy("conv_id").applyInArrow(_path, _PATH), "paths")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    both = table.alias("t").join(paths.alias("p"), same).select("t.*", *[f"p.{c}" for c in ("no", "pieces", "entry", "exit", *_FACTS)])
    return both.groupBy(*keys).applyInArrow(_piece, _PIECE)


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, most_bytes: int = 64 << 20, chunk_rows: int = 4096
) -> Repaired:
    """The cheapest repair of every conversation, in pieces: rows (conv_id, no, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, turns).

    Turns are taken by turn (nulls first), then role and text; null roles and texts count as one
    space, and rows of a null conv_id are one conversation.  Keep costs 0, Rerole 2, Insert 2,
    Delete 3, and a truncated turn that stays 1; blank and duplicate turns have to go.  Of equally
    cheap repairs the one of the least audit in ASCII is taken.  gaps to cost are those of the whole conversation;
    audit and turns, the edits with their roles and texts (deleted turns included), are the piece's own, in order of
    `no`.  Rows whose present_col is false only name a conversation; one without turns has an empty
    audit.  Repeated rows stay (the second is a duplicate); other columns are ignored.

    A conversation of up to `most_bytes` is one piece, solved in one task; a longer one is spread
    by chunks of `chunk_rows` turns, with the same result.
    """
    small_batches(turns.sparkSession)
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), (F.coalesce(F.col(f"`{present_col}`").cast("boolean"), F.lit(False)) if present_col else F.lit(True)).alias("present"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
    )
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64).alias("bytes"), F.max("present").alias("some"))
    huge = saved(sizes.where(F.col("some") & (F.col("bytes") > most_bytes)).select("conv_id"), "huge")
    n = huge.count()
    if n:  # as many as the table has multiples of most_bytes
        same = rows["conv_id"].eqNullSafe(huge["conv_id"])
        huge = F.broadcast(huge) if n <= 1_000_000 else huge
        parts = rows.join(huge, same, "left_anti"), rows.join(huge, same, "left_semi")
    else:
        parts = rows, None
    whole = parts[0].repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_whole, _PIECE)
    return Repaired(whole, None if parts[1] is None else saved(_long(parts[1], chunk_rows), "repaired-pieces"))


def _lines(turns) -> list[str]:
    return [f"{t['role']}:{t['text']}" for t in turns if t["edit"] != "D"]


_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches):
    """The audit and digest of conversations in several pieces; the pieces of one follow each other."""
    conv, audit, sha, some, have = None, [], None, False, False

    def done():
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=_DIGEST_ARROW)

    for batch in batches:
        for i in range(batch.num_rows):
            conv_id, no, own, turns = (batch.column(k)[i].as_py() for k in range(4))
            if not no:
                if have:
                    yield done()
                conv, audit, sha, some, have = conv_id, [], hashlib.sha256(), False, True
            audit.append(own)
            for line in _lines(turns):
                sha.update((("\n" if some else "") + line).encode())
                some = True
    if have:
        yield done()


@dataclass(frozen=True)
class Repaired:
    """whole: conversations of one piece; spread: the pieces of the others, stored, if there are any."""

    whole: DataFrame
    spread: DataFrame | None

    @property
    def pieces(self) -> DataFrame:
        return self.whole if self.spread is None else self.whole.unionByName(self.spread)

    def turns(self) -> DataFrame:
        """(conv_id, no, at, edit, role, text) of what stays: order by conv_id, no, at."""
        return self.pieces.select("conv_id", "no", F.posexplode("turns").alias("at", "t")).select("conv_id", "no", "at", "t.*").where("edit <> 'D'")

    def digests(self) -> DataFrame:
        """(conv_id, gaps, ..., cost, audit, repaired_sha256) of each conversation: the digest is that of its `role:text` lines.

        One piece is hashed where it lies; those of a longer conversation are dealt by its id and
        run through one hash in order, a piece at a time.  Its audit is one string.
        """
        line = F.transform(F.filter("turns", lambda t: t["edit"] != "D"), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        one = self.whole.select("conv_id", *_FACTS, "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
        if self.spread is None:
            return one
        read = self.spread.select("conv_id", "no", "audit", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
        facts = self.spread.where("no = 0").select(F.col("conv_id").alias("id"), *_FACTS)
        return one.unionByName(facts.join(read, F.col("id").eqNullSafe(F.col("conv_id"))).select("conv_id", *_FACTS, "audit", "repaired_sha256"))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): turns with faults, chosen by crc32(`conv_id:turn`) % 20.

    0 drops a turn (present is false), 1 empties it, 2 removes its [.!?], 3 repeats it, 4
    makes it a user's.  Null roles and texts, and nulls in the text that is hashed, are one space.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    own = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space(role_col)).alias("role"),
        text.alias("text"), (kind != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return own.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present_col="present").digests()


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
