import hashlib
import re

import numpy as np
import pytest

from factorweave.llm import fill_in_middle as fim
from pyspark.sql import functions as F


def plain(doc_id, text, rate=90, spm=20):
    text = text or ""
    words = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(words)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (words[:a], words[a:b], words[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


ROWS = [(i, " ".join(f"w{j} Ünder{j},é漢x\n" for j in range(i % 40))) for i in range(120)] + [
    (200, "a<P>b c"), (201, "x<S"), (202, "<M>"), (203, "\U0001f600" * 50), (204, "abc" * 400), (205, "abcé" * 300), (206, "<" * 30), (206, "<" * 30), (-7, "minus seven"),
]


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 16])
def test_equals_plain(spark, docs, odd, chunk):
    rows = ROWS + odd
    got = fim.fill_in_middle(docs(rows), chunk=chunk)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(i, t) for i, t in rows), key=repr)


def test_restored(spark, docs):
    """In every form, whatever the text holds beside whole marks."""
    texts = [t for _, t in ROWS] + ["<S<M" * 5, "P><S>", "a < b > c <", ""]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    out = fim.fill_in_middle(docs(rows), rate=100, spm=50, chunk=32).withColumn("text", fim.restored(F.col("form"), F.col("output")))
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: got[i]["text"] for i, _ in rows} == dict(rows)
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_no_rows(docs):
    assert fim.fill_in_middle(docs([]), chunk=4).collect() == []


def test_compose_is_the_fold():
    rng = np.random.default_rng(1)
    for m in (1, 2, 7, 33):
        exits, counts = rng.integers(0, 2, (m, 2)), rng.integers(0, 9, (m, 2))
        state, total, want = 0, 0, []
        for e, c in zip(exits, counts, strict=True):
            want.append((state, total))
            state, total = int(e[state]), total + int(c[state])
        assert list(zip(*(x.tolist() for x in fim.compose(exits, counts)), strict=True)) == want


def test_function_of_a_chunk():
    for text in ("", "ab", "ab c", "é", "aé", "éa", " a"):
        data = np.frombuffer(text.encode(), np.uint8)
        exits, counts, chars = fim.function_of(data)
        for entry, before in ((fim.OUT, " "), (fim.IN, "x")):
            whole = re.findall(r"[A-Za-z]+|[^A-Za-z]", before + text)
            assert counts[entry] == len(whole) - 1
            assert exits[entry] == (fim.IN if (before + text)[-1].isascii() and (before + text)[-1].isalpha() else fim.OUT)
        assert chars == len(text)
