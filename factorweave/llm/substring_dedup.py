"""Substring dedup by level-wise doubling.

The first level asks which windows of a few words occur more than once.  Only places where
two such windows stand end to end can hold a repeated window of twice that length, so only
those are asked about at the next level.  At the level of the wanted length the earliest
start of each window is found as well; every other window that equals it is removed.  The
levels beyond it, on demand, go on until no candidate survives: they tell how long the
repeats of a document are, and can't change what is removed.

How it is spread: documents are dealt into blocks by a hash of id and text, and that
exchange is read again by every level up to the wanted length.  A block sends each distinct
window hash once, packed by hash bucket; a bucket answers with one or two bits for each hash
it was sent.  So a window that stands in a third of all documents costs one entry a block,
and no group holds more than one bucket's or block's share of the data.

Shorter windows are told apart by their bucket and 24 bits, as a wrong candidate only costs
a question at the next level; windows of the wanted length by 96 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import saved, texts
from factorweave.llm.words import Words, mix, window_hashes

_SENT = "level int, bucket int, block int, keys binary, extra binary"
_BITS = "level int, bucket int, block int, bits binary"
_SENT_ARROW = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
_BITS_ARROW = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])
_NO_ID = -(2**63)


class _Level:
    """The candidate windows of one length in one block, distinct and in order of their hash, so of bucket, too."""

    def __init__(self, words: Words, ids: np.ndarray, length: int, at: np.ndarray, buckets: int):
        self.at = at
        keys = window_hashes(ids, length)[at]
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        head = np.flatnonzero(new)
        self.of = np.empty(len(keys), np.int64)  # of each candidate: its distinct key
        self.of[order] = np.cumsum(new) - 1
        self.first = np.minimum.reduceat(order, head) if len(head) else head  # of each distinct key: its first candidate
        self.many = np.diff(np.append(head, len(keys))) > 1
        self.keys = ordered[new]
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def sent(self):
        """(bucket, the distinct keys in it) for each bucket with keys."""
        for b in np.flatnonzero(np.diff(self.cut)):
            yield int(b), slice(int(self.cut[b]), int(self.cut[b + 1]))

    def answer(self, bits: dict[int, bytes], which: int = 0) -> np.ndarray:
        """The buckets' bits, one for each distinct key; which: the first or second bit of a key."""
        out = np.zeros(len(self.keys), bool)
        for b, own in self.sent():
            n = own.stop - own.start
            out[own] = np.unpackbits(np.frombuffer(bits[b], np.uint8, offset=which * ((n + 7) // 8)), count=n).astype(bool)
        return out


class _Ladder:
    """The lengths of the levels; `wanted` is the place of the wanted length."""

    def __init__(self, window: int, shorter: int, longer: int = 0):
        if shorter < 0 or window % (1 << shorter):
            raise ValueError("window must be a multiple of 2**shorter")
        self.wanted = shorter
        self.lengths = [window >> (shorter - i) if i < shorter else window << (i - shorter) for i in range(shorter + 1 + longer)]


class _Block:
    """One block of documents, in order of id, and the levels that its answers allow."""

    def __init__(self, table: pa.Table, ladder: _Ladder, buckets: int):
        ids = table.column("doc_id").fill_null(_NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table, self.doc_ids = table.take(pa.array(order)), ids[order]
        self.words, self.ladder, self.buckets = Words(self.table.column("text")), ladder, buckets
        self.ids = self.words.hashes()
        self.start = np.arange(len(self.ids)) - self.words.first[:-1][self.words.doc]

    def level(self, k: int, bits: dict[int, dict[int, bytes]]) -> _Level:
        """Level k, given the answers to all levels before it."""
        at = np.flatnonzero(self.words.fits(self.ladder.lengths[0]))
        for i, length in enumerate(self.ladder.lengths[: k + 1]):
            if i:
                half = length // 2
                at = at[repeated[at] & self.words.fits(length)[at]]
                at = at[repeated[at + half]]
            level = _Level(self.words, self.ids, length, at, self.buckets)
            if i < k:
                repeated = self.repeated(i, level, bits)
        return level

    def repeated(self, k: int, level: _Level, bits: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Of each word: whether a window of level k that occurs elsewhere starts there."""
        out = np.zeros(len(self.ids), bool)
        if len(level.at):
            out[level.at] = level.answer(bits.get(k, {}), int(k == self.ladder.wanted))[level.of]
        return out


def _bits_of(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for lv, b, bits in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True):
        out.setdefault(lv, {})[b] = bits
    return out


_KEY_BYTES = 3  # of windows shorter than the wanted one


def _send(k: int, ladder: _Ladder, buckets: int):
    def rows(docs: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        out = {name: [] for name in _SENT_ARROW.names}
        if docs.num_rows:
            block = _Block(docs, ladder, buckets)
            level = block.level(k, _bits_of(answers) if answers is not None else {})
            # a second hash of each window, so that unlike windows are told apart in any corpus
            second = window_hashes(mix(block.ids), ladder.lengths[k])[level.at[level.first]].astype("<u4") if k >= ladder.wanted else None
            for b, which in level.sent():
                p, keys = level.at[level.first[which]], level.keys[which]
                many = np.packbits(level.many[which]).tobytes()
                if k >= ladder.wanted:
                    extra = second[which].tobytes() + many
                    if k == ladder.wanted:
                        extra += block.doc_ids[block.words.doc[p]].astype("<i8").tobytes() + block.start[p].astype("<u4").tobytes()
                    keys = keys.tobytes()
                else:
                    extra = many
                    keys = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]).tobytes()
                for name, v in zip(_SENT_ARROW.names, (k, b, docs.column("block")[0].as_py(), keys, extra), strict=True):
                    out[name].append(v)
        return pa.table(out, _SENT_ARROW)

    return rows


def _alone(send):
    return lambda docs: send(docs)  # of one argument, as groupBy().applyInArrow() wants it


def _judge(k: int, wanted: int):
    def rows(table: pa.Table) -> pa.Table:
        blobs, extra = table.column("keys").to_pylist(), table.column("extra").to_pylist()
        long = k >= wanted
        size = [len(x) // (8 if long else _KEY_BYTES) for x in blobs]
        bits_at = 4 if long else 0
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, (n + 7) // 8, bits_at * n), count=n) for x, n in zip(extra, size, strict=True)]).astype(bool)
        if long:
            keys, second = np.frombuffer(b"".join(blobs), "<u8"), np.frombuffer(b"".join(x[: 4 * n] for x, n in zip(extra, size, strict=True)), "<u4")
        else:
            low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _KEY_BYTES).astype(np.uint32)
            keys, second = (low << (8 * np.arange(_KEY_BYTES, dtype=np.uint32))).sum(1, dtype=np.uint32), np.zeros(len(low), np.uint32)
        order = np.argsort(keys)
        if long:  # rows of an equal first hash, which are few, are told apart by the second
            near = keys[order][1:] == keys[order][:-1]
            alike = np.flatnonzero(np.append(near, False) | np.append(False, near))
            own = order[alike]
            parts = [second[own], keys[own]]
            if k == wanted:
                tail = [4 * n + (n + 7) // 8 for n in size]
                ids = np.frombuffer(b"".join(x[t : t + 8 * n] for x, t, n in zip(extra, tail, size, strict=True)), "<i8")
                start = np.frombuffer(b"".join(x[t + 8 * n :] for x, t, n in zip(extra, tail, size, strict=True)), "<u4")
                parts = [start[own], ids[own], *parts]
            order[alike] = own[np.lexsort(parts)]
        new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1]))
        group, head = np.cumsum(new) - 1, np.flatnonzero(new)
        count = np.diff(np.append(head, len(order)))
        repeated = np.empty(len(order), bool)  # does it occur twice?
        repeated[order] = ((count > 1) | np.maximum.reduceat(many[order], head))[group]
        answers = [repeated]
        if k == wanted:  # is it the earliest (doc_id, start) of its window?
            least = order[head][group]
            first = np.empty(len(order), bool)
            first[order] = (ids[order] == ids[least]) & (start[order] == start[least])
            answers = [first, repeated]
        cut = np.cumsum([0, *size])
        bits = [b"".join(np.packbits(x[a:b]).tobytes() for x in answers) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table([table.column("level"), table.column("bucket"), table.column("block"), pa.array(bits, pa.binary())], schema=_BITS_ARROW)

    return rows


_RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>, longest long"
_RESULT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("longest", pa.int64()),
    ]
)


def _apply(ladder: _Ladder, buckets: int):
    def rows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT_ARROW.empty_table()
        block, bits, k = _Block(docs, ladder, buckets), _bits_of(answers), ladder.wanted
        level, words, width = block.level(k, bits), block.words, ladder.lengths[k]
        gone = np.zeros(len(block.ids) + 1, np.int64)
        longest = np.zeros(len(block.doc_ids), np.int64)
        if len(level.at):
            first = level.at[level.first][level.of]
            own = (block.doc_ids[words.doc[first]] == block.doc_ids[words.doc[level.at]]) & (block.start[first] == block.start[level.at])
            away = level.at[~(own & level.answer(bits.get(k, {}))[level.of])]
            gone[away] += 1
            np.subtract.at(gone, away + width, 1)
            for i in range(k, len(ladder.lengths)):
                level = level if i == k else block.level(i, bits)
                longest[words.doc[np.flatnonzero(block.repeated(i, level, bits))]] = ladder.lengths[i]
        gone = np.cumsum(gone)[:-1] > 0
        kept, spans, removed = [], [], []
        data = words.data.tobytes()
        for d, (a, b) in enumerate(zip(words.first, words.first[1:], strict=False)):
            own, parts = gone[a:b], data[words.offsets[d] : words.offsets[d + 1]].split()
            removed.append(int(own.sum()))
            if removed[-1]:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                parts = [parts[i] for i in np.flatnonzero(~own)]
            else:
                spans.append([])
            kept.append(b" ".join(parts).decode())
        return pa.table([block.table.column("doc_id"), words.counts, removed, kept, spans, longest], schema=_RESULT_ARROW)

    return rows


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shorter: int = 2, to_the_end: bool = False, block_bytes: int = 3 << 20, bucket_bytes: int = 12 << 20
) -> DataFrame:
    """Removes words covered by a window of `window` words that also starts earlier.

    The levels have window/2**shorter, ..., window/2, window words; with to_the_end also 2,
    4, 8, ... times the window, until no candidate survives.  Blocks and buckets have about
    block_bytes and bucket_bytes of text, which bounds what a task holds, and up to 8 times
    that from 64 GB of text on, so that what a block sends to a bucket doesn't get tiny.

    Returns doc_id, n_words, n_removed, kept (words joined by one space), spans of removed
    words [start, end), in words of the input, and longest: the longest level at which one
    of the document's windows occurs elsewhere or twice, 0 for none; at most `window`
    without to_the_end.  Each longer level is a job that deals the documents again.

    Null text: no words, kept is empty.  Empty text and texts shorter than a window: nothing
    is removed.  Null doc_id: sorts before every other.  Rows with an equal doc_id count as
    one place in the order: of two equal windows at the same (doc_id, start) neither is
    earlier.  Empty table: no rows.  Other columns are ignored.
    """
    ladder = _Ladder(window, shorter)
    docs = texts(docs, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = min(8.0, max(1.0, math.sqrt(total / 2**36)))
    blocks, buckets = math.ceil(total / (block_bytes * grown)) or 1, math.ceil(total / (bucket_bytes * grown)) or 1
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def bits(k: int, answers: DataFrame | None) -> DataFrame:
        send = _send(k, ladder, buckets)
        sent = placed.groupBy("block").applyInArrow(_alone(send), _SENT) if answers is None else placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, _SENT)
        return sent.groupBy("bucket").applyInArrow(_judge(k, ladder.wanted), _BITS)

    answers = None
    for k in range(shorter + 1):
        own = bits(k, answers)
        answers = own if answers is None else answers.unionByName(own)
    if to_the_end:
        answers, k = saved(answers, "answers"), shorter
        while True:
            k += 1
            ladder = _Ladder(window, shorter, k - shorter)
            own = saved(bits(k, answers), "answers")
            if own.isEmpty():
                ladder = _Ladder(window, shorter, k - 1 - shorter)
                break
            answers = answers.unionByName(own)
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_apply(ladder, buckets), _RESULT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w),
k AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS win FROM s),
f AS (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS rn FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM f WHERE rn > 1),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
q AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.pos) AS kept
      FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN q ON w.doc_id = q.doc_id"""
}
