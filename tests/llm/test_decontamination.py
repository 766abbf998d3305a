import random
import re

import pytest

from factorweave.llm.decontamination import build_index, decontaminate, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, length):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            if item is None or not v:
                continue
            n = min(length, len(v))
            for a in range(len(v) - n + 1):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(2)
    v = [f"w{i}" for i in range(12)] + ["The", "Éa", "x9"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 9)))) for i in range(14)] + [(90, None), (None, "w1 w2"), (91, "?!")]
    rows = [(i, ", ".join(rng.choice(v + [items[rng.randrange(14)][1]]) for _ in range(rng.randint(0, 80)))) for i in range(40)]
    return rows, items


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, docs, odd):
    rows, items = case()
    got = decontaminate(docs(rows + odd), spark.createDataFrame(items, "item_id long, text string"), length=5)
    assert result(got) == brute(rows + odd, items, 5)


def test_shards_of_items_give_the_same(spark, docs, odd):
    rows, items = case()
    index = build_index(docs(rows + odd), block_bytes=500)
    table = spark.createDataFrame(items, "item_id long, text string")
    one, many = (search(index, table, length=5, slop=1, most_bytes=b) for b in (1 << 20, 60))
    flat = lambda df: sorted(((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(sorted(r["items"])), tuple(sorted(r.near_items))) for r in df.collect()), key=repr)
    assert flat(one) == flat(many)


@pytest.mark.parametrize("most_bytes", [1 << 20, 30])
def test_repeated_rows_and_equal_places_stay_apart(spark, docs, most_bytes):
    """Blocks of one text with equal ids and word places, repeated rows and null ids."""
    rows = [(1, "alpha"), (1, "beta"), (None, "alpha"), (None, "gamma"), (2, "alpha beta"), (2, "alpha beta"), (0, "alpha")]
    items = [(1, "alpha"), (2, "beta delta"), (3, "beta"), (4, "one more item that is long enough"), (3, "beta")]
    got = search(build_index(docs(rows), block_bytes=5), spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes)
    out = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got.collect()), key=repr)
    assert out == [x[:4] for x in brute(rows, items, 13)]


def test_proximity(spark, docs):
    table = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight")], "item_id long, text string")
    got = search(build_index(docs([(1, "one two big three four"), (2, "five six seven eight"), (3, "one two 3 4")])), table, slop=1)
    assert {r.doc_id: (r["items"], r.near_items) for r in got.collect()} == {1: ([], ["1"]), 2: (["2"], []), 3: ([], [])}


def near(w, v, length, slop):
    """Some start has every word of a window within slop of its place."""
    n = min(length, len(v))
    return bool(n) and any(all(any(w[p] == v[a + k] for p in range(max(0, s + k - slop), min(len(w), s + k + slop + 1))) for k in range(n)) for a in range(len(v) - n + 1) for s in range(-slop - n, len(w) + slop + 1))


@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_proximity_equals_brute_force(spark, docs, slop):
    """Over many short documents, whatever else lies in the block."""
    rng = random.Random(slop)
    v = ["aa", "bb", "cc", "dd", "ee"]
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(100, "aa bb cc xx"), (101, "dd ee"), (102, "bb aa cc"), (103, "aa aa bb bb"), (104, "bb bb cc cc")]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(1, 6)))) for i in range(12)] + [(50, "aa bb cc dd"), (51, "aa bb cc")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        exact = {str(k) for k, it in items if near(words(t), words(it), 4, 0)}
        want[i] = (exact, {str(k) for k, it in items if near(words(t), words(it), 4, slop)} - exact)
    for block_bytes in (1, 60, 1 << 20):
        got = search(build_index(docs(rows), block_bytes=block_bytes), table, length=4, slop=slop)
        assert {r.doc_id: (set(r["items"]), set(r.near_items)) for r in got.collect()} == want


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs([]), none).collect() == []
    assert [r.contaminated for r in decontaminate(docs([(1, "a b")]), none).collect()] == [False]
