import random

import corpus_pipeline
import numpy as np

from factorweave.llm import simhash
from factorweave.llm.simhash import bit_share, number_of_fingerprints, shingle_sets, similar_texts


def words_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """The rows kept: the least of each group of texts that are linked at 0.8 or more."""
    sets = [words_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or x and y and len(x & y) / len(x | y) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return groups.values()


def test_shingle_sets():
    import pyarrow as pa

    texts = ["a b c d e f", None, "x", "A  b c\td e f", "one two three four", " ", "a b c d e a b c d e"]
    h, first = shingle_sets(pa.array(texts))
    own = [set(h[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert [len(x) for x in own] == [len(words_set(t)) for t in texts] and own[0] == own[3] and own[0] & own[6]


def case(odd):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(99))
    rows = [*odd, (None, "a"), (None, "no id"), (10, "another text of a repeated id"), (11, "another TEXT of a repeated id")]
    for k in range(60):  # copies with a few words replaced: similarities from 0.5 to 1, some just at the bound
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for j in range(4):
            own = base[:]
            for _ in range(rng.randrange(1 + len(base) // 20)):
                own[rng.randrange(len(own))] = word()
            rows.append((1000 + 4 * k + j, " ".join(own)))
    passage = [word() for _ in range(40)]  # shared by many, but no copies
    rows += [(5000 + k, " ".join([*passage, *[word() for _ in range(30)]])) for k in range(60)]
    whole = [word() for _ in range(200)]  # one group that is linked by steps
    for k in range(80):
        whole[rng.randrange(200)] = word()
        rows.append((6000 + k, " ".join(whole)))
    return rows


def test_stage_keeps_one_of_each_group_at_0_8(spark, docs, odd):
    rows = case(odd)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows, 5), "").collect()]
    groups = brute(rows)
    assert len(got) == len(groups)
    for group in groups:
        mine = [r for r in group if r in got]
        assert len(set(mine)) == 1 and mine[0][0] == min((i for i, _ in group if i is not None), default=None)


def test_number_of_fingerprints():
    assert [number_of_fingerprints(0.8, k) for k in (3, 2)] == [12, 78] and number_of_fingerprints(0.9, 3) < 7
    assert abs(bit_share(0.8) - 0.1515) < 1e-3


def test_longer_segments_and_small_blocks_find_the_same(spark, docs, odd):
    rows = [(i, t) for i, t in case(odd) if i is not None][:140]
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "key long, doc_id long, text string")
    own, roots = similar_texts(df, parts=2, block=8)
    got = {}
    for r in own.join(roots, "node", "left").collect():
        got.setdefault(r.root if r.root is not None else r.node, set()).add(rows[r.key])
    assert sorted(map(sorted, (map(repr, g) for g in got.values()))) == sorted(map(sorted, (map(repr, set(g)) for g in brute(rows))))


def near_copies(n, seed=5):
    """n texts that differ from one text, and so from each other, in a word or two."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(n):
        own = base[:]
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, i, " ".join(own)))
    return rows


def test_what_is_dealt_of_near_copies_grows_with_their_number(spark):
    """20,000 unlike near copies make one group, and each set is dealt twice at most, on average."""
    dealt = {}
    for n in (2_000, 20_000):
        df = spark.createDataFrame(near_copies(n), "key long, doc_id long, text string").repartition(8)
        seen = []
        whole = simhash._tiles
        simhash._tiles = lambda sets, least: (seen.append(sets.count()), whole(sets, least))[1]  # noqa: B023
        try:
            own, roots = similar_texts(df)
        finally:
            simhash._tiles = whole
        assert roots.count() == n and roots.select("root").distinct().count() == 1
        dealt[n] = sum(seen)
        assert dealt[n] <= 2.5 * n
    assert dealt[20_000] <= 12 * dealt[2_000]


def test_blocks_of_one_component_do_not_meet(spark):
    nodes = [(k, f"k{k}", 100 if k < 90 else 400, 0, 4) for k in range(100)]
    members = spark.createDataFrame(nodes, "node long, key string, n int, cluster long, blocks int")
    roots = spark.createDataFrame([(k, 0) for k in range(1, 60)], "node long, root long")
    sets, sides = simhash._unconnected(members, roots, 0.8, 20)
    name = {r.node: (r.name, r.own) for r in sets.collect()}
    tiles = {}
    for r in sides.collect():
        tiles.setdefault(r.tile, []).append((r.name, r.side))
    meet = {frozenset(x for x, _ in t) for t in tiles.values()}
    assert all(sorted(s for _, s in t) in ([0], [1, 2]) for t in tiles.values()) and len(meet) == len(tiles)
    n = {k: row[2] for k, row in enumerate(nodes)}
    for a in range(100):
        for b in range(a):
            apart = name[a][1] != name[b][1]
            if apart and 0.8 * max(n[a], n[b]) <= min(n[a], n[b]):
                assert frozenset({name[a][0], name[b][0]}) in meet
            elif not apart and a < 60:
                assert frozenset({name[a][0], name[b][0]}) not in meet
    connected = spark.createDataFrame([(k, 0) for k in range(1, 100)], "node long, root long")
    assert simhash._unconnected(members, connected, 0.8, 20) is None
