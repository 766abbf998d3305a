"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition first.

1. A character 4-gram model is counted over all documents.
2. Words with digits or symbols among their letters, letters repeated three times or more,
   and runs of three or more single spaced characters become lattices: an observed character
   may stand for itself, for a letter that it imitates, or for nothing, and a space in a run
   for nothing or for a word's edge.  The Viterbi path with the least channel and
   language-model cost is the restored word or phrase.
3. Words, and word beginnings of 3 to 10 bytes, of the restored text are weighed by how
   often documents with them are labelled toxic; a document's score is the noisy-or of the
   weights it contains.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import texts
from factorweave.llm.words import ALNUM_WORD, SPACE_WORD, Words, pieces, text_buffer

#: What a digit or symbol may stand for (fixed values of the channel).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "&": "a", "#": "h", "%": "x",
}
_SEPARATORS = "._-*~^'`,:;/\\=\"" + "@$!|+(<&#%"
_EDGE, _OTHER = 0, 27  # of the alphabet: word edge, a-z as 1-26, any other letter
_A = 28
_SUBSTITUTE, _SKIP, _UNDOUBLE, _STAY = 1.5, 2.0, 1.0, 9.0  # channel costs in nats
_SPLIT, _JOIN = 3.0, 6.0  # of a word's edge at a space as narrow as any of its run, and of none at a wider one
_CODE = np.zeros(256, np.uint8)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0xC0:] = _OTHER  # the first byte of a longer character
_LETTER = _CODE > 0
_LETTER[0x80:] = True
_NOISE = np.zeros(256, bool)
_NOISE[[ord(c) for c in set(LEET) | set("._-*~^")]] = True
_LEAD = ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))  # the first byte of any character
_SIGN = _NOISE.copy()  # a character that can be one of a spaced run: a Latin letter, digit or symbol
_SIGN[0x61:0x7B] = _SIGN[0x41:0x5B] = _SIGN[0xC3:0xC6] = True
_AFTER, _BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_AFTER[list(b".,!?;:\"')]")] = True
_BEFORE[list(b".,?;:\"'[(")] = True
_NO_SIGN = frozenset("._-*~^")  # symbols that stand for no letter
_TAIL = re.compile(rb"[.,!?;:\"')\]]+$|(?:([^a-z0-9\x80-\xff])\1{2,}[.,!?;:]*)+$")
_HEAD = re.compile(rb"^[.,?;:\"'\[(]+")
#: Numbers, addresses and keys are not words.
_NO_WORD = re.compile(rb"^(?:[^a-z\x80-\xff]*|[^@]+@[^@]+\.[a-z]+|[0-9a-f]{16,}|(?:https?://|www\.).*)$")


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each character 4-gram occurs within the words of all texts.

    At most 28**4 codes; each task sends each of its codes once.
    """

    def rows(batches):
        total = np.zeros(_A**4, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                data = np.insert(data, offsets[1:-1], 0x20)  # texts end words
                data = data[(data < 0x80) | (data >= 0xC0)] if len(data) else data
                code = _CODE[data].astype(np.int32)
                code = code[np.append(True, (code[1:] > 0) | (code[:-1] > 0))] if len(code) else code
                code = np.concatenate([[0, 0, 0], code, [0]])
                third, second, last, now = code[:-3], code[1:-2], code[2:-1], code[3:]
                second = np.where(last > 0, second, 0)  # a context stops at a word's edge
                third = np.where(second > 0, third, 0)
                some = (last > 0) | (now > 0)
                total += np.bincount((((third * _A + second) * _A + last) * _A + now)[some], minlength=_A**4)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    return docs.mapInArrow(rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """-log P(character | three before) as a dense float32 array of 28**4; a context stops at a word's edge."""
    rows = counts.toArrow()
    n = np.zeros(_A**4, np.float64)
    n[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    four = n.reshape(_A, _A, _A, _A)
    three = four.sum(0)
    two = three.sum(0)
    one = two.sum(0)
    p = (one + 1) / (one.sum() + _A)
    for table in (two, three, four):  # each order leans on the shorter one with the weight of 4 observations
        p = (table + 4 * p) / (table.sum(-1, keepdims=True) + 4)
    return -np.log(p).astype(np.float32)


def arcs_of(word: str, i: int) -> list[tuple[str, int, float]]:
    """What character i of a word may stand for: (text, its code or -1 for none, channel cost)."""
    c = word[i]
    again = i > 0 and word[i - 1] == c
    if c.isalpha():
        return [(c, ord(c) - 96 if "a" <= c <= "z" else _OTHER, 0.0), *[("", -1, _UNDOUBLE)] * again]
    return [*[(x, ord(x) - 96, _SUBSTITUTE) for x in LEET.get(c, "")], *[("", -1, _SKIP)] * (c in _SEPARATORS or again), (c, _OTHER, _STAY)]


def restore_word(word: str, model: np.ndarray, wide: list[bool] | None = None) -> str:
    """The Viterbi path through the lattice of one lower-case word, exact over all states.

    A state is the last three characters put out, and holds the cheapest way to it with a
    link backwards, so the work is linear in the word.
    With `wide`, word is a run of spaced characters, each of which may begin a new word:
    wide[i] says whether the space before character i + 1 is wider than others of the run.
    """
    states: dict[tuple, tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}  # what is put out is linked backwards
    for i in range(len(word)):
        arcs = arcs_of(word, i)
        starts = [(k, cost, out, arcs) for k, (cost, out) in states.items()]
        if wide is not None and i:
            edges = [(cost + float(model[(*k, _EDGE)]) + (0.0 if wide[i - 1] else _SPLIT), out) for k, (cost, out) in states.items() if k[2] != _EDGE]
            starts = [(k, cost + _JOIN * wide[i - 1], out, arcs) for k, cost, out, _ in starts]
            if edges:
                cost, out = min(edges, key=lambda x: x[0])
                starts.append(((_EDGE, _EDGE, _EDGE), cost, (out, " "), [x for x in arcs if x[1] >= 0]))
        after: dict[tuple, tuple[float, tuple]] = {}
        for (a, b, d), cost, out, own in starts:
            for text, code, price in own:
                key = (a, b, d) if code < 0 else (b, d, code)
                total = cost + price + (0.0 if code < 0 else float(model[a, b, d, code]))
                if key not in after or total < after[key][0]:
                    after[key] = (total, (out, text) if text else out)
        states = after
    _, out = min(((cost + float(model[(*k, _EDGE)]), out) for k, (cost, out) in states.items()), key=lambda x: x[0])
    found = []
    while out:
        out, text = out
        found.append(text)
    return "".join(reversed(found)) or word


class Restorer:
    """Restores whole texts; words seen before come from a table that is emptied when full."""

    def __init__(self, model: np.ndarray, most: int = 100_000):
        self.model, self.most, self.known, self.glued = model, most, {}, []

    def word(self, raw: bytes) -> bytes:
        got = self.known.get(raw)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            core = raw[len(m[0]) :] if (m := _HEAD.match(raw)) else raw
            core = _TAIL.sub(b"", core)
            plain = core.decode("utf-8", "replace")
            if _NO_WORD.match(core) or plain.isalpha() and not re.search(r"(.)\1\1", plain):
                got = core or raw
            else:
                got = restore_word(plain, self.model).encode()
            self.known[raw] = got
        return got

    def runs(self, words: Words, count, letters: np.ndarray) -> list[tuple[int, int]]:
        """Runs of three or more single characters within a text, one of them a letter.

        The first may have punctuation before it and the last behind it.
        """
        chars = count(_LEAD[words.data])
        plain = (chars == 1) & _SIGN[words.data[words.starts]]
        last = words.data[words.ends - 1]
        closes = (chars > 1) & _SIGN[words.data[words.starts]] & ~_AFTER[words.data[words.starts]] & (count(_AFTER[words.data]) == chars - 1)
        opens = (chars > 1) & ~_BEFORE[last] & (count(_BEFORE[words.data]) == chars - 1) & (letters > 0) & ~closes
        own = plain | closes | opens
        # a word goes on with the run of the word before it
        on = own[1:] & own[:-1] & ~closes[:-1] & ~opens[1:] & (words.doc[1:] == words.doc[:-1])
        turn = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        out = []
        for a, b in zip(turn[::2].tolist(), (turn[1::2] + 1).tolist(), strict=True):
            if b - a < 3 or not letters[a:b].any():
                continue
            at, signs = words.starts[a:b].tolist(), words.data
            while b - a >= 3 and not letters[a] and _BEFORE[signs[at[0]]] | (chr(signs[at[0]]) in _NO_SIGN):
                a, at = a + 1, at[1:]
            while b - a >= 3 and not letters[b - 1] and _AFTER[signs[at[-1]]] | (chr(signs[at[-1]]) in _NO_SIGN):
                b, at = b - 1, at[:-1]
            if b - a >= 3 and sum(chr(signs[i]) not in _NO_SIGN for i in at) >= 3:
                out.append((a, b))
        return out

    def run(self, signs: list[bytes], gaps: list[bytes]) -> tuple[bytes, bytes]:
        """(phrase, glued): what a run of spaced characters spells; punctuation at its ends is left out.

        The character model can misplace a word's edge ('y oustupid'), so a phrase of more than
        one word is also given without its edges, for words to be looked for from each of its letters.
        """
        least, lines = min(map(len, gaps)), [b"\n" in g for g in gaps]
        wide = tuple(len(g) > least or line and not all(lines) for g, line in zip(gaps, lines, strict=True))
        if len(signs[0]) > 1:
            signs[0] = _HEAD.sub(b"", signs[0])
        if len(signs[-1]) > 1:
            signs[-1] = signs[-1].rstrip(b".,!?;:\"')]")
        word = b"".join(signs).decode("utf-8", "replace")
        got = self.known.get((word, wide))
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = restore_word(word, self.model, wide=list(wide))
            whole = got.replace(" ", "")
            got = self.known[word, wide] = got.encode(), whole.encode() if whole != got else b""
        return got

    def __call__(self, column) -> list[bytes]:
        """The texts in lower case, with their obfuscated words restored; `glued` has each one's spaced phrases without edges."""
        words = Words(column, SPACE_WORD, lower=True)
        data, n = words.data, len(words.starts)
        whole = data.tobytes()
        out: list[list] = [[] for _ in range(len(words.offsets) - 1)]
        self.glued = [b""] * len(out)
        if n:
            def count(mask):
                c = np.concatenate([[0], np.cumsum(mask)])
                return c[words.ends] - c[words.starts]

            letter = _LETTER[data]
            letters = count(letter)
            three = np.zeros(len(data), bool)
            three[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
            odd = (letters > 0) & ((count(_NOISE[data]) > 0) | (count(three) > 0))
            runs = self.runs(words, count, letters)
            todo = [(i, i + 1) for i in np.flatnonzero(odd).tolist()]
            if runs:
                in_run = np.zeros(n, bool)
                for a, b in runs:
                    in_run[a:b] = True
                todo = [(i, j) for i, j in todo if not in_run[i]] + runs
            for a, b in sorted(todo):
                if b - a == 1:
                    new = self.word(whole[words.starts[a] : words.ends[a]])
                else:
                    new, glued = self.run([whole[i:j] for i, j in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)], [whole[i:j] for i, j in zip(words.ends[a : b - 1].tolist(), words.starts[a + 1 : b].tolist(), strict=True)])
                    if glued:
                        self.glued[words.doc[a]] += b" " + glued
                out[words.doc[a]].append((int(words.starts[a]), int(words.ends[b - 1]), new))
        texts_ = []
        for d, changes in enumerate(out):
            at, parts = int(words.offsets[d]), []
            for a, b, new in changes:
                parts += [whole[at:a], new]
                at = b
            texts_.append(b"".join([*parts, whole[at : words.offsets[d + 1]]]))
        return texts_


def _features(restored: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) for each distinct pair: whole words, and their first 3 to 10 bytes."""
    words = Words(pa.array(restored, pa.binary()), ALNUM_WORD)
    size = words.ends - words.starts
    hashes = [words.hashes()]
    docs = [words.doc]
    full = words.ends
    for k in range(3, 11):
        longer = np.flatnonzero(size > k)
        words.ends = np.minimum(words.starts + k, full)
        hashes.append(words.hashes()[longer] + np.uint64(k))
        docs.append(words.doc[longer])
    words.ends = full
    return np.concatenate(hashes), np.concatenate(docs)


def _inner_features(glued: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of what begins at each character of the words: all to the word's end, and the first 3 to 10 bytes."""
    words = Words(pa.array(glued, pa.binary()), ALNUM_WORD)
    size = words.ends - words.starts
    start = np.repeat(words.starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    end, doc = np.repeat(words.ends, size), np.repeat(words.doc, size)
    begins = _LEAD[words.data[start]] & (end - start >= 3)
    start, end, doc = start[begins], end[begins], doc[begins]
    hashes, docs = [words.segment_hashes(start, end)], [doc]
    for k in range(3, 11):
        longer = end - start > k
        hashes.append(words.segment_hashes(start[longer], start[longer] + k) + np.uint64(k))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


class Scorer:
    """Noisy-or over the features a text contains, brought to a probability by slope and shift."""

    def __init__(self, model: np.ndarray, features: np.ndarray, precision: np.ndarray):
        self.slope, self.shift = 1.0, -2.0
        order = np.argsort(features)
        self.model, self.features, self.cost = model, features[order], -np.log1p(-precision[order])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def evidence(self, restored: list[bytes], glued: list[bytes]) -> np.ndarray:
        """-log of the noisy-or's chance of no toxicity; 0 without a known feature."""
        total = np.zeros(len(restored))
        hashes, doc = (np.concatenate(x) for x in zip(_features(restored), _inner_features(glued), strict=True))
        some = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(some) and len(self.features):
            hashes, doc = hashes[some], doc[some]
            i = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            hit = self.features[i] == hashes
            pairs = np.unique(doc[hit] * len(self.features) + i[hit])
            np.add.at(total, pairs // len(self.features), self.cost[pairs % len(self.features)])
        return total

    def __call__(self, restored: list[bytes], glued: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(restored, glued) + self.shift)))

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression on the evidence by Newton's method with a small ridge."""
        if not len(toxic) or toxic.min() == toxic.max():
            return
        x, w = np.stack([np.minimum(evidence, 50), np.ones(len(evidence))], 1), np.array([self.slope, self.shift])
        for _ in range(100):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1, x.T @ (p - toxic) + 0.1 * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        if np.isfinite(w).all() and w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, most_rows: int = 20_000, least: float = 0.6) -> Scorer:
    """Weighs features by the labelled documents that have them; labels is (doc_id, toxic).

    At most about `most_rows` labelled rows are used, chosen by a hash of doc_id, and equal
    texts count once.  A feature's weight is the lower Wilson bound, at 5**0.5 standard errors, of
    the share of toxic among its documents, so that one seen in a few documents only, or in
    clean ones as well, weighs little; it is used if that is `least` or more.  Four fifths
    of the rows weigh the features, the last fifth calibrates the scores.  All features that
    reach `least` are kept; only `most_rows` bounds them.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if n > most_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows_in = docs.join(F.broadcast(labels), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))  # bounded by most_rows
    rows_in = rows_in.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 0

    def rows(batches):
        restorer = Restorer(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, doc = _features(restorer(part.column(1)))
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))
                hashes, toxic = hashes[new], part.column(2).to_numpy()[doc[new]]
                head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
                if len(head):
                    t = np.add.reduceat(toxic, head).astype(np.int64)
                    yield pa.record_batch([pa.array(hashes[head].view(np.int64)), pa.array(np.diff(np.append(head, len(hashes)))), pa.array(t)], names=["feature", "n", "t"])

    got = rows_in.where(~apart).mapInArrow(rows, "feature long, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share, z2 = F.col("t") / F.col("n"), 5.0
    bound = (share + z2 / (2 * F.col("n")) - 5.0**0.5 * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    best = got.withColumn("weight", bound).where(F.col("weight") >= least).orderBy("feature").toArrow()  # of the bounded sample
    scorer = Scorer(model, best.column("feature").to_numpy().view(np.uint64), np.minimum(best.column("weight").to_numpy(), 0.999))

    def evidence(batches):
        restorer = Restorer(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.record_batch([pa.array(scorer.evidence(restorer(part.column(1)), restorer.glued)), part.column(2)], names=["x", "toxic"])

    known = rows_in.where(apart).mapInArrow(evidence, "x double, toxic int").toArrow()  # two numbers for each of most_rows / 5 rows
    scorer.calibrate(known.column("x").to_numpy(), known.column("toxic").to_numpy().astype(float))
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", restored: bool = False) -> DataFrame:
    """docs with score; with the restored text as well if wanted.  Columns of these names are replaced."""
    new = ["score", *["restored"] * restored]
    docs = docs.drop(*new)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double" + ", restored string" * restored

    def rows(batches):
        restorer = Restorer(scorer.model)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for part in pieces(batch, text_col):
                texts_ = restorer(part.column(at))
                own = [pa.array([x.decode("utf-8", "replace") for x in texts_])] if restored else []
                yield pa.record_batch([*part.columns, pa.array(scorer(texts_, restorer.glued)), *own], names=[*part.schema.names, *new])

    return docs.mapInArrow(rows, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= 0.5, else 0).

    Labels are learned from rows that aren't held out.  Null and empty texts get the score
    of a text without evidence.  A null doc_id has no label, and held_out is null.  Repeated
    rows each get a row.  Without toxic labels every score is the same.  All other columns
    stay; those of the three names are replaced.
    """
    own = texts(docs, id_col, text_col)
    model = language_model(ngram_counts(own))
    scorer = train(own, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), model)
    out = score(docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), scorer, text_col, restored)
    return out.withColumns({"held_out": held_out(F.col(f"`{id_col}`").cast("long")), "predicted": (F.col("score") >= 0.5).cast("int")})


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
