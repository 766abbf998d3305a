import hashlib
import random
import re
from collections import Counter

import pytest

from factorweave.llm.substring_dedup import substring_dedup


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (key(i), s)), (key(i), s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (key(i), s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def longest_repeat(rows, window):
    """Of each row: the longest of window, 2 * window, ... of which a window of it occurs twice in all."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    out = [0] * len(rows)
    length = window
    while True:
        seen = Counter(tuple(w[s : s + length]) for w in words for s in range(len(w) - length + 1))
        if not seen:
            return out
        for d, w in enumerate(words):
            if any(seen[tuple(w[s : s + length])] > 1 for s in range(len(w) - length + 1)):
                out[d] = length
        length *= 2


def case(seed, odd):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(4)]
    rows = odd + [(20 + i, " ".join(rng.choice([rng.choice("abcdefgh"), rng.choice(shared), "x\ny"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return rows + [(200, "z " * 500), (201, "z " * 30), (202, shared[0]), (203, shared[0]), (204, shared[1]), (204, shared[1]), (204, "of the same id " + shared[1])]


@pytest.mark.parametrize("shorter", [0, 1, 2, 3])
def test_equals_brute_force(docs, odd, shorter):
    rows = case(shorter, odd)
    out = substring_dedup(docs(rows), window=8, shorter=shorter, block_bytes=1500, bucket_bytes=3000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr) == brute(rows, 8)
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert all((r.longest == 8) == (x > 0) for r, x in paired(out, rows, longest_repeat(rows, 8)))


def paired(out, rows, values):
    """Result rows with the values of their input rows."""
    own = {}
    for (i, t), v in zip(rows, values):
        own.setdefault((i, len((t or "").split())), []).append(v)
    assert all(len(set(v)) == 1 for v in own.values())
    return [(r, own[r.doc_id, r.n_words][0]) for r in out]


def test_levels_go_on_until_no_candidate_survives(docs, odd):
    rows = case(9, odd)
    out = substring_dedup(docs(rows), window=8, shorter=1, to_the_end=True, block_bytes=1500, bucket_bytes=3000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr) == brute(rows, 8)
    got = paired(out, rows, longest_repeat(rows, 8))
    assert max(x for _, x in got) >= 256 and [r.longest for r, _ in got] == [x for _, x in got]


def test_empty_table(docs):
    assert substring_dedup(docs([])).collect() == []


def test_window_must_be_halved(docs):
    with pytest.raises(ValueError):
        substring_dedup(docs([]), window=9, shorter=1)


def test_kept_text_of_a_null(docs):
    r = substring_dedup(docs([(1, None)])).first()
    assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) == (0, 0, hashlib.sha256(b"").hexdigest())
