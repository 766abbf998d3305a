import random

import numpy as np
import pytest
import xxhash

from factorweave.llm.components import components
from factorweave.llm.simhash import Routes, fingerprint, keys, linked, links, majority, near_duplicates, odd_sketches, op8_simhash


def slow(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(values, bits=4):
    v = np.array(values, np.uint64)
    root = np.arange(len(v))
    while True:
        old = root.copy()
        for i in range(len(v)):
            near = np.bitwise_count(v ^ v[i]) <= bits
            root[near] = root[near].min()
        if (old == root).all():
            return root


def test_fingerprint():
    for t in ("", "One", "one two\tthree", "a b c d e f g h", "x " * 50):
        assert fingerprint(b" ".join(t.encode().lower().split())) == slow(t)


@pytest.mark.parametrize("together", [1, 2, 3])
def test_some_variant_is_shared(together):
    rng, routes = random.Random(1), Routes(keys(4, together))
    assert together > 1 or routes.used.sum() == 64  # 3 segments, a wildcard for each bit
    every = np.arange(len(routes))
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        own = [set(zip(*map(np.ndarray.tolist, (key, every[row])))) for row, key in (routes.variants(np.full(len(routes), v, np.uint64), every, every) for v in (x, y))]
        assert own[0] & own[1]
        assert any((x & int(routes.masks[r])) == (y & int(routes.masks[r])) for r in {r for _, r in own[0] & own[1]})


def near_values(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    return np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))) for b in base for _ in range(40)], np.uint64))


def same_components(fps, edges):
    parent = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    got, want = [find(int(f)) for f in fps.view(np.int64)], brute(fps)
    return len({*zip(got, want.tolist())}) == len(set(got)) == len(set(want.tolist()))


def test_linked_gives_the_components_of_all_links():
    fps, routes = near_values(4), Routes(keys(4))
    x, route = np.repeat(fps, len(routes)), np.tile(np.arange(len(routes)), len(fps))
    a, b = linked(x.view(np.int64), *routes.variants(x, route, route), [x], 4)
    assert same_components(fps, zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("together", [None, 2, 3])
def test_links_by_longer_keys_are_the_same(spark, together):
    fps = near_values(5)
    edges = links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), 4, together).collect()
    assert same_components(fps, [(r.a, r.b) for r in edges])


def test_majority():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 3, 4, 5, 9, 0, 31, 200, 1])
    words = rng.integers(0, 2**63, (counts.sum(), 3), dtype=np.uint64) & rng.integers(0, 2**63, (counts.sum(), 3), dtype=np.uint64) | np.uint64(6)
    got, at = majority(words, counts), 0
    for i, n in enumerate(counts):
        bits = np.unpackbits(words[at : at + n].view(np.uint8).reshape(n, 24), axis=1, bitorder="little")
        assert (np.packbits(2 * bits.sum(0) > n, bitorder="little").view(np.uint64) == got[i]).all()
        at += n


def test_sketches_differ_in_no_more_cells_than_sets_in_elements():
    rng = np.random.default_rng(5)
    for n in (1, 30, 800):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.append(x[n // 4 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)))
        s = odd_sketches(np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(x, y))


def test_near_duplicates(docs, odd):
    rng = random.Random(6)
    long = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(120)) for _ in range(5)]
    rows = odd + [(100 + k, " ".join(w if rng.random() < 0.99 else "new" for w in long[k % 5].split())) for k in range(40)]
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in near_duplicates(docs(rows)).collect()}
    values = [slow(t) for _, t in rows]
    root = brute(values)
    for (i, _), v, c in zip(rows, values, root):
        ids = [x for (x, _), y in zip(rows, root) if y == c and x is not None]
        assert got[i, v] == (min(ids) if ids else None)
    assert near_duplicates(docs([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 180)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 1
    got = {r.node: r.root for r in found.collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_query_on_the_whole_table(spark, sf):
    """Every row against brute force; and of queries with an id divisible by 20 each link to any row is found."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op8_simhash(spark, sf).collect()}
    values = [slow(t) for _, t in rows]
    root = brute(values)
    least = {c: min(i for (i, _), r in zip(rows, root) if r == c) for c in set(root.tolist())}
    assert len(got) == len(rows)
    for (i, _), v, c in zip(rows, values, root.tolist()):
        assert (got[i].fingerprint, got[i].component_id) == (f"{v:016x}", least[c])
    links = [(i, j) for (i, _), v in zip(rows, values) if i % 20 == 0 for (j, _), w in zip(rows, values) if i != j and (v ^ w).bit_count() <= 4]
    assert links and all(got[i].component_id == got[j].component_id for i, j in links)
