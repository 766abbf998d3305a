import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factorweave.llm import toxicity as tox
from factorweave.llm.packing import Plan, pack, word_lengths
from factorweave.llm.preferences import format_preferences
from factorweave.llm.sharding import shard

# ---- sharding


def brute_shards(rows, shards):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = lambda i: float("-inf") if i is None else i
    known = lambda g: min((i for i in g if i is not None), default=float("-inf"))
    order = sorted(groups.items(), key=lambda kv: known(kv[1]))
    size = [(len(t.encode()) + 1) * len(g) for t, g in order]

    def cut(cap):
        out, n, used = [], 0, 0
        for s in size:
            if used + s > cap:
                n, used = n + 1, 0
            used += s
            out.append(n)
        return out

    cap = max(size)
    while max(cut(cap)) >= shards:
        cap += 1
    place, slots = [], Counter()
    for (t, g), n in zip(order, cut(cap)):
        for i in sorted(g, key=low):
            place.append((i, len(t.encode()) + 1, zlib.crc32(t.encode()), n, slots[n]))
            slots[n] += 1
    return sorted(place, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shards_are_minimax(docs, odd, seed):
    rng = random.Random(seed)
    rows = odd + [(20 + i, rng.choice(["hot text"] * 3 + ["x" * rng.randrange(1, 60)])) for i in range(90)]
    got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shard(docs(rows), 8).collect()), key=repr)
    assert got == brute_shards(rows, 8)


def test_few_groups_and_none(docs):
    assert {r.shard for r in shard(docs([(1, "a"), (2, "b")]), 8).collect()} <= {0, 1}
    assert shard(docs([]), 8).collect() == []


# ---- packing


def item_by_item(sizes, caps, overhead):
    """Best fit over single items, opening bins by the same rule."""
    bins, left, count = [], sum(sizes), Counter(sizes)
    left_of, total = {}, sum(sizes)
    for s in sorted(count, reverse=True):
        total -= s * count[s]
        left_of[s] = total
    for s in sorted(count, reverse=True):
        n = count[s]
        while n:
            open_ = [b for b in bins if b[0] - b[1] >= s]
            if open_:
                b = min(open_, key=lambda b: b[0] - b[1])
            else:
                cost = lambda c: (overhead + c) / (min(n, c // s) * s + min(c - min(n, c // s) * s, left_of[s]))  # noqa: E731, B023
                b = [min((c for c in caps if c >= s), key=cost), 0]
                bins.append(b)
            b[1] += s
            n -= 1
    return bins, left


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    caps = sorted(rng.sample(range(8, 200), rng.randint(1, 4)))
    sizes = [min(caps[-1], max(1, int(rng.expovariate(1 / 30)))) for _ in range(rng.randint(1, 200))]
    counts = Counter(sizes)
    plan = Plan(counts, caps)
    size = np.array([s for s in counts for _ in range(counts[s])])
    rank = np.array([k for s in counts for k in range(counts[s])])
    content = defaultdict(list)
    for s, b, o, c in zip(size, *plan.where(size, rank)):
        content[b].append((o, s, c))
    assert sorted(content) == list(range(plan.bins))
    for own in content.values():
        at = 0
        for o, s, _ in sorted(own):
            assert o == at
            at += s
        assert {c for _, _, c in own} == {min(c for c in caps if c >= at)}
    bins, total = item_by_item(sizes, caps, plan.overhead)
    assert sum(s for own in content.values() for _, s, _ in own) == total
    assert sum(next(iter(own))[2] for own in content.values()) <= 1.2 * sum(min(c for c in caps if c >= b[1]) for b in bins)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_is_within_a_hundredth_of_item_by_item(seed):
    rng = random.Random(seed)
    caps = [64, 128, 256, 512]
    sizes = [min(512, max(1, int(rng.lognormvariate(3.5, 1)))) for _ in range(8000)]
    plan = Plan(Counter(sizes), caps)
    bins, _ = item_by_item(sizes, caps, plan.overhead)
    final = np.array([plan.final[np.searchsorted(plan.first_bin, b, "right") - 1] for b in range(plan.bins)])
    assert final.sum() <= 1.01 * sum(min(c for c in caps if c >= b[1]) for b in bins)


def test_pack_places_every_piece_once(docs, odd):
    rng = random.Random(3)
    rows = odd + [(50 + i, "w " * rng.choice([3, 3, 3, rng.randrange(90)])) for i in range(200)]
    out = pack(word_lengths(docs(rows)), capacities=(8, 16, 32)).collect()
    whole = Counter()
    for r in out:
        whole[r.doc_id] += r["size"]
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split()) + 1
    assert whole == want
    bins = defaultdict(list)
    for r in out:
        bins[r.bin].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r["size"]
        assert at <= own[0].capacity in (8, 16, 32) and not any(c >= at for c in (8, 16, 32) if c < own[0].capacity)
    assert pack(word_lengths(docs([]))).collect() == []


# ---- preferences


def test_preferences(spark):
    turns = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string")
    a = turns([(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (2, 0, "user", "same", ""), (3, 0, "user", "alone", ""), (None, 0, "user", "x", ""), (4, 0, None, None, ""), (5, 0, "user", "q", ""), (5, 1, "assistant", "ok", "")])
    b = turns([(1, 0, "user", "hi", ""), (1, 1, "assistant", "no", ""), (1, 2, "user", "why", ""), (2, 0, "user", "same", ""), (4, 0, None, None, ""), (5, 0, "user", "other", "")])
    got = {r.pair_id: r for r in format_preferences(a, b).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    one = got[1]
    assert (one.n_common, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert one.chosen == "<|assistant|>\nyes<|end|>\n" and one.rejected.startswith("<|assistant|>\nno<|end|>\n<|user|>")
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["yes<|end|>\n"] and [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["no<|end|>\n"]
    assert (got[2].n_common, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", [])
    assert (got[3].n_common, got[3].prompt, got[3].rejected) == (0, "", "")
    assert got[4].n_common == 1 and got[5].n_common == 0
    assert format_preferences(turns([]), turns([])).collect() == []


# ---- toxicity


@pytest.fixture(scope="module")
def model(spark, sf):
    return tox.language_model(tox.ngram_counts(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")))


@pytest.mark.parametrize(("seen", "meant"), [("l0ser", "loser"), ("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("iiidiooot", "idiot"), ("p@thetic", "pathetic"), ("tr4sh", "trash")])
def test_words_are_restored(model, seen, meant):
    assert tox.restore_word(seen, model) == meant


def every_path(word, model, wide=None):
    """The cheapest reading of a lattice by trying all of them."""
    best = (float("inf"), "")
    codes = [[a for a in tox.arcs_of(word, i)] for i in range(len(word))]
    for own in itertools.product(*codes):
        for edges in itertools.product((False, True), repeat=len(word) - 1 if wide else 0):
            cost, text, last = 0.0, "", (0, 0, 0)
            for i, (out, code, price) in enumerate(own):
                if wide and i:
                    if edges[i - 1]:
                        if last[2] == 0 or code < 0:
                            break
                        cost, text, last = cost + float(model[(*last, 0)]) + (0.0 if wide[i - 1] else tox._SPLIT), text + " ", (0, 0, 0)
                    else:
                        cost += tox._JOIN * wide[i - 1]
                if code >= 0:
                    cost, last = cost + float(model[(*last, code)]), (*last[1:], code)
                cost, text = cost + price, text + out
            else:
                best = min(best, (cost + float(model[(*last, 0)]), text), key=lambda x: x[0])
    return best


def cost_of(word, got, model, wide=None):
    """The least cost of the paths that put out a given text."""
    costs = {}
    for own in itertools.product(*[tox.arcs_of(word, i) for i in range(len(word))]):
        text = "".join(o for o, _, _ in own)
        last, cost = (0, 0, 0), 0.0
        for _, code, price in own:
            if code >= 0:
                cost, last = cost + float(model[(*last, code)]), (*last[1:], code)
            cost += price
        cost += float(model[(*last, 0)])
        costs[text] = min(cost, costs.get(text, cost))
    return costs[got]


def test_viterbi_finds_the_cheapest_of_all_paths(model):
    rng = random.Random(8)
    for _ in range(150):
        word = "".join(rng.choice("aaidotsrn014!$@.6|") for _ in range(rng.randint(1, 7)))
        got = tox.restore_word(word, model)
        if got != word:
            assert abs(cost_of(word, got, model) - every_path(word, model)[0]) < 1e-4


def test_viterbi_of_spaced_runs(model):
    rng = random.Random(9)
    for _ in range(60):
        word = "".join(rng.choice("youaid1t0s$") for _ in range(rng.randint(2, 5)))
        wide = [rng.random() < 0.4 for _ in word[1:]]
        assert tox.restore_word(word, model, wide=wide) == every_path(word, model, wide)[1]


def test_long_words_take_linear_time(model):
    import time

    def seconds(n):
        began = time.process_time()
        tox.restore_word("a1b!x0z9" * (n // 8), model)
        return time.process_time() - began

    seconds(800)
    assert seconds(32_000) < 8 * seconds(8_000)


def test_score_is_a_plain_noisy_or():
    """Whole words and their first 3 to 10 bytes, each known one once a text."""
    import pyarrow as pa

    texts = [b"zorkling abc zork", b"", b"zorkling zorkling", b"abc", "é漢zork".encode()]
    weights = {b"zorkling": 0.9, b"zork": 0.7, b"abc": 0.2}
    hashed = {}
    for w in weights:
        h, _ = tox._features([w])
        hashed[w] = h[0]  # the whole word's
    prefix = tox._features([b"zorkling"])[0][1 + [3, 4, 5, 6, 7].index(5)]
    scorer = tox.Scorer(None, np.array([*hashed.values(), prefix], np.uint64), np.array([*weights.values(), 0.5]))

    def plain(text):
        p = 1.0
        found = {w for w in text.split()}
        for w, x in weights.items():
            p *= 1 - x if w in found else 1
        if any(w.startswith(b"zorkl") and len(w) > 5 for w in found):
            p *= 0.5
        return 1 / (1 + np.exp(-(scorer.slope * -np.log(p) + scorer.shift)))

    assert np.allclose(scorer(texts, [b""] * len(texts)), [plain(t) for t in texts])


def test_texts_are_restored(model):
    import pyarrow as pa

    r = tox.Restorer(model)
    assert r(pa.array(["You i d i o t go", None, "", "plain Text é", "a.b@mail1.example.com 4111111111111111"])) == [b"you idiot go", b"", b"", "plain text é".encode(), b"a.b@mail1.example.com 4111111111111111"]


SPACED = [
    ("s c u m.", "scum"), ("s c u m!", "scum"), ("i d i o t, go", "idiot go"), ("i d 1 o t", "idiot"), ("1 d 1 0 t", "idiot"), ('"s c u m" he said', 'scum he said'),
    ("y o u i d i o t", "you idiot"), ("y o u   i d i o t", "you idiot"), ("s c u m !", "scum !"), ("s c u m.\ni d i o t!", "scum\nidiot"), ("i - d - i - o - t", "idiot"),
]


@pytest.mark.parametrize(("seen", "meant"), SPACED)
def test_spaced_words_are_restored(model, seen, meant):
    import pyarrow as pa

    assert tox.Restorer(model)(pa.array([seen])) == [meant.encode()]


def test_spaced_runs_end_with_their_text(model):
    import pyarrow as pa

    texts = ["go i d i o t", "s c u m", None, "l o s e r", "a b"]
    assert tox.Restorer(model)(pa.array(texts)) == [b"go idiot", b"scum", b"", b"loser", b"a b"]


def test_spaced_phrases_are_read_from_each_letter(model):
    import pyarrow as pa

    r = tox.Restorer(model)
    feature = lambda w: tox._features([w])[0][0]
    for phrase in ("y o u p a t h e t i c", "s u c h a g a r b a g e", "w o r t h l e $ $ s c u m"):
        seen = {*tox._features(r(pa.array([phrase])))[0], *tox._inner_features(r.glued)[0]}
        assert any(feature(x) in seen for x in (b"pathetic", b"garbage", b"scum"))
    assert r(pa.array(["plain i d i o t"])) == [b"plain idiot"] and r.glued == [b""]


def test_inner_features_are_those_of_every_reading():
    """Words of any length, from each of their characters; texts stay apart."""
    glued = ["abc" + "defghij" * 9, "", "é漢xyz 12a", "ab"]
    got = set(zip(*(x.tolist() for x in tox._inner_features([g.encode() for g in glued])), strict=True))
    readings = [(w[i:], d) for d, g in enumerate(glued) for w in g.split() for i in range(len(w)) if len(w[i:].encode()) >= 3]
    want = set()
    for w, d in readings:
        want |= {(h, d) for h in tox._features([w.encode()])[0].tolist()}
    assert got == want


def test_counts_do_not_depend_on_how_rows_are_dealt(spark, docs):
    rows = [(i, t) for i, t in enumerate(["ab", "cd", "", None, "é", "cd ab", "abc"] * 3)]
    one, many = (sorted(map(tuple, tox.ngram_counts(docs(rows, n).select("doc_id", "text")).collect())) for n in (1, 7))
    assert one == many


def test_scores(spark, docs, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = list(odd), []
    for i in range(20, 820):
        bad = i % 4 == 0
        w = [word() for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["zorkling", "zorkled", "zork"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows.append((9001, "abc z0rkl1ng"))
    out = tox.toxicity(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), restored=True)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels) and got[None].held_out is None
    assert got[5].score == got[6].score and got[9001].restored == "abc zorkling" and got[9001].predicted == 1


def test_without_labels(spark, docs, odd):
    out = tox.toxicity(docs(odd), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(out) == len(odd) and len({r.score for r in out}) == 1
    assert tox.toxicity(docs([]), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
