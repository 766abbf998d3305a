"""Benchmark decontamination on a positional inverted index.

The index holds every token of the training texts: one row for a block of documents, with
its distinct terms in order and, for each, the ascending places where it stands.  It is
built where the documents lie, without a shuffle, and stored in the shared folder.

A phrase is looked up from its rarest term in the block: that term's places, moved back by
its offset, are intersected with the moved places of the next rarest, and so on.  With
`slop`, a term may stand up to so many words from its offset: a proximity match, within one
document, whatever else is in the block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import filesystem, saved, texts
from factorweave.llm.words import ALNUM_WORD, Words, pieces

_INDEX = "doc_ids binary, missing binary, first binary, terms binary, heads binary, places binary"
_INDEX_ARROW = pa.schema([(x.split()[0], pa.binary()) for x in _INDEX.split(", ")])
_FOUND = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 22) -> DataFrame:
    """The stored positional index of all texts; one row for each block of `block_bytes` or one longer text."""

    def rows(batches):
        for batch in batches:
            for part in pieces(batch, "text", block_bytes):
                words = Words(part.column(1), ALNUM_WORD, lower=True)
                ids = words.hashes()
                order = np.argsort(ids, kind="stable")
                heads = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])) if len(ids) else np.zeros(0, np.int64)
                doc_ids = part.column(0)
                out = (
                    doc_ids.fill_null(0).to_numpy().astype("<i8"), np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)), words.first.astype("<u4"),
                    ids[order][heads].astype("<u8"), np.append(heads, len(ids)).astype("<u4"), order.astype("<u4"),
                )
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in out], schema=_INDEX_ARROW)

    return saved(texts(docs, id_col, text_col).mapInArrow(rows, _INDEX), "positional-index")


class _Queries:
    """The windows of some test items, over the distinct words of these items."""

    def __init__(self, item_ids: list[str], item_texts: pa.Array, length: int):
        words = Words(item_texts, ALNUM_WORD, lower=True)
        self.item_ids, self.words = item_ids, words
        self.vocabulary, self.word = np.unique(words.hashes(), return_inverse=True)
        size = np.minimum(words.counts, length)  # of the windows of each item
        per_item = np.where(words.counts > 0, words.counts - size + 1, 0)
        self.item = np.repeat(np.arange(len(item_ids)), per_item)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(per_item) - per_item, per_item) + words.first[:-1][self.item]
        self.size = size[self.item]


class _Block:
    def __init__(self, row: dict):
        self.first = np.frombuffer(row["first"], "<u4").astype(np.int64)
        self.terms, self.heads = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["heads"], "<u4")
        self.places = np.frombuffer(row["places"], "<u4")

    def find(self, q: _Queries, slop: int):
        """(item, exact starts, documents with a proximity match, size) for each window that occurs here."""
        if not len(self.terms) or not len(q.vocabulary):
            return
        at = np.minimum(np.searchsorted(self.terms, q.vocabulary), len(self.terms) - 1)
        have = self.terms[at] == q.vocabulary
        count = np.where(have, self.heads[at + 1] - self.heads[at], 0).astype(np.int64)
        absent = np.concatenate([[0], np.cumsum(~have[q.word])])
        lists: dict[int, np.ndarray] = {}
        for w in np.flatnonzero(absent[q.start + q.size] == absent[q.start]):
            terms = q.word[q.start[w] : q.start[w] + q.size[w]]
            for t in np.unique(terms).tolist():
                if t not in lists:
                    lists[t] = self.places[self.heads[at[t]] : self.heads[at[t] + 1]].astype(np.int64)
            order = [(int(off), lists[int(terms[off])]) for off in np.argsort(count[terms], kind="stable")]  # the rarest first
            exact = self._exact(order, int(q.size[w]))
            near = self._near(order, slop) if slop else np.zeros(0, np.int64)
            if len(exact) or len(near):
                yield int(q.item[w]), exact, near, int(q.size[w])

    def _exact(self, order: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
        """Starts s at which every term stands at s + its offset, within one document."""
        starts = order[0][1] - order[0][0]
        for off, own in order[1:]:
            if not len(starts):
                return starts
            i = np.minimum(np.searchsorted(own, starts + off), len(own) - 1)
            starts = starts[own[i] == starts + off]
        starts = starts[starts >= 0]
        doc = np.searchsorted(self.first, starts, "right") - 1
        return starts[starts + size <= self.first[np.minimum(doc + 1, len(self.first) - 1)]]

    def _near(self, order: list[tuple[int, np.ndarray]], slop: int) -> np.ndarray:
        """Documents with a start s for which every term stands, in them, within `slop` words of s + its offset.

        All such s are within `slop` of a place of the rarest term, moved back; so the choice
        of that term, which depends on what else lies in the block, changes nothing.
        """
        off, own = order[0]
        doc = np.repeat(np.searchsorted(self.first, own, "right") - 1, 2 * slop + 1)
        starts = (own[:, None] - off + np.arange(-slop, slop + 1)).ravel()
        for off, own in order[1:]:
            if not len(starts):
                break
            i = np.searchsorted(own, np.maximum(starts + off - slop, self.first[doc]))
            found = own[np.minimum(i, len(own) - 1)]
            ok = (i < len(own)) & (found <= starts + off + slop) & (found < self.first[doc + 1])
            starts, doc = starts[ok], doc[ok]
        return np.unique(doc)


def _spans(hit: np.ndarray) -> list[dict]:
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]


class _Found:
    """What some shards of items have found in one block so far."""

    def __init__(self, row: dict):
        self.row, self.block = row, _Block(row)
        self.cover = np.zeros(int(self.block.first[-1]) + 1, np.int64)
        self.items: dict[int, set[str]] = {}
        self.near: dict[int, set[str]] = {}

    def look(self, q: _Queries, slop: int) -> None:
        for item, exact, near, size in self.block.find(q, slop):
            np.add.at(self.cover, exact, 1)
            np.subtract.at(self.cover, exact + size, 1)
            for found, into in ((np.unique(np.searchsorted(self.block.first, exact, "right") - 1), self.items), (near, self.near)):
                for d in found.tolist():
                    into.setdefault(d, set()).add(q.item_ids[item])

    def batch(self) -> pa.RecordBatch:
        first, n = self.block.first, len(self.block.first) - 1
        hit = np.cumsum(self.cover)[:-1] > 0
        ids = pa.array(np.frombuffer(self.row["doc_ids"], "<i8"), mask=np.unpackbits(np.frombuffer(self.row["missing"], np.uint8), count=n).astype(bool))
        spans = [_spans(hit[first[d] : first[d + 1]]) if d in self.items else [] for d in range(n)]
        items = [sorted(self.items.get(d, ())) for d in range(n)]
        near = [sorted(self.near.get(d, set()) - self.items.get(d, set())) for d in range(n)]
        return pa.record_batch([ids, pa.array(np.diff(first)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], schema=_FOUND_ARROW)


def _search(files: list[str], length: int, slop: int, most_bytes: int):
    """Looks up the items of all files in every block; some blocks are held while the files are gone through."""

    def queries(file: str) -> _Queries:
        fs, path = filesystem(file)
        with fs.open_input_file(path) as f:
            table = pq.read_table(f, columns=["item_id", "text"])
        return _Queries(table.column(0).to_pylist(), table.column(1), length)

    def rows(batches):
        only = queries(files[0]) if len(files) == 1 else None
        held, size = [], 0

        def done():
            for file in files:
                q = only or queries(file)
                for found in held:
                    found.look(q, slop)
            for found in held:
                yield found.batch()

        for batch in batches:
            for i in range(batch.num_rows):  # without a copy of the block
                row = {c: batch.column(k)[i].as_buffer() for k, c in enumerate(_INDEX_ARROW.names)}
                held.append(_Found(row))
                size += sum(x.size for x in row.values())
                if only or size >= most_bytes:
                    yield from done()
                    held, size = [], 0
        yield from done()

    return rows


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", length: int = 13, slop: int = 0, most_bytes: int = 16 << 20) -> DataFrame:
    """Looks up all windows of the items in every block; one row for each indexed document.

    Returns doc_id, n_words, spans of words inside an exact match, items with one, and
    near_items: those with proximity matches only: for some start s every term of a window stands
    in the document within `slop` words of s + its offset.  Items are stored in files of about
    `most_bytes` of text, that the tasks read one after another; a block gathers what all
    files find.  Rows of items with a null id are no items; repeated ones count once.
    """
    items = items.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stored = saved(items.repartition(max(1, math.ceil(size / most_bytes)), F.xxhash64("item_id", "text")), "items")
    return index.mapInArrow(_search(sorted(stored.inputFiles()), length, slop, 4 * most_bytes), _FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, share: int = 20, slop: int = 0) -> DataFrame:
    """Which words of each document stand inside a window of a test item, and whether too many do.

    Words are lower-cased runs of letters, digits and characters from 0x80.  contaminated:
    a word is hit, and share * hits >= words.  Null and empty texts have no words and are
    clean.  An item of fewer than `length` words, but not none, is one window.  Every input
    row gives one row, also repeated ones and those of a null id.  Other columns are ignored.
    """
    found = search(build_index(docs, id_col, text_col), items, length=length, slop=slop)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated"
    )


QUERIES = {"op5_decontamination": op5_decontamination}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT item_id, least(len(words), 13) AS n, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS s, words FROM b WHERE len(words) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS win FROM bw),
dw AS (SELECT doc_id, l.n AS n, unnest(range(1, len(words) - l.n + 2)) AS s, words FROM d, (SELECT DISTINCT n FROM bk) l WHERE len(words) >= l.n),
hits AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') AS win FROM dw) JOIN bk USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""
}
