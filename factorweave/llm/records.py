"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (8 bytes, little endian), masked checksum of those 8 bytes (4),
payload, masked checksum of the payload (4).  Payloads are little-endian unsigned ids, of 2
bytes if the vocabulary allows it, else 4.  The index of a shard holds the place of each
record as 8 bytes, so a reader can shuffle records and seek; a third file has each record's
document id and whether there is one.  Checksums are CRC-32, masked by a rotation and a
constant so that a checksum of checksums is not degenerate.
"""

from __future__ import annotations

import math
import posixpath
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorweave.llm.common import filesystem, saved, scratch, texts
from factorweave.llm.words import mix, pieces, text_buffer

_MASK_DELTA = 0xA282EAD8  # fixed value of the record format
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_CONTRACTIONS = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at a place, and the place of the next; both checksums must hold."""
    head = data[at : at + 8]
    n = int.from_bytes(head, "little")
    if masked_crc(head) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"length checksum of the record at {at} is wrong")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or masked_crc(payload) != int.from_bytes(data[at + 12 + n : at + 16 + n], "little"):
        raise ValueError(f"payload checksum of the record at {at} is wrong")
    return payload, at + 16 + n


class Encoder:
    """Byte-level BPE through the tokenizers library, each distinct word piece encoded once.

    The pre-tokenizer's pattern cuts a text at places that depend on character classes only,
    and BPE never crosses a cut.  So a batch is cut with whole-array operations, and only
    pieces not seen before go to the library.  The table of known pieces is emptied when it
    holds `most` pieces, so the memory is bounded.

    As in the library, the string of a special token in a text is that token's id; with
    special_as_text it is ordinary text.
    """

    def __init__(self, path: str, most: int = 1_500_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.most = most
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (special_as_text and t.special)}
        self.added = added
        self.added_pattern = re.compile(b"|".join(re.escape(x) for x in sorted(added, key=lambda x: -len(x)))) if added else None
        largest = max([self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, *added.values()])
        self.width = 2 if largest < 1 << 16 else 4
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.classes = np.zeros(0x110000, np.uint8)
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
            for m in regex.finditer(pattern, every):
                self.classes[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        self.classes[0x1C:0x20] = 0  # separators that the pattern's \s doesn't have
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # of the known pieces, ascending
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def cuts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start in the characters of all texts; first: the texts' own starts."""
        n = len(chars)
        kind = self.classes[chars]
        start = np.zeros(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[first] = True
        text_end = np.zeros(n + 1, bool)
        text_end[first] = True
        text_end[n] = True
        heads = np.flatnonzero(start[:n])
        ends = np.append(heads[1:], n)
        space = (kind[heads] == _SPACE) & ~text_end[ends]  # a run of white space with text behind it
        last = ends[space] - 1
        start[last] = True  # its last character stands alone, or goes with what follows
        glued = last[chars[last] == 0x20]
        start[glued + 1] = False
        quotes = np.flatnonzero((chars == 0x27) & start[:n])
        for q in quotes.tolist():
            stop = min(n, q + 3)
            more = np.flatnonzero(text_end[q + 1 : stop])
            tail = "".join(map(chr, chars[q + 1 : q + 1 + int(more[0]) if len(more) else stop]))
            k = _CONTRACTIONS.get(tail[:1]) or _CONTRACTIONS.get(tail[:2])
            if k:
                start[q + 1] = False
                if q + 1 + k < n:
                    start[q + 1 + k] = True
        return np.flatnonzero(start[:n])

    def _encoded(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, and how many each has.

        They are encoded as one text with line feeds between: the pattern cuts before and
        after such a line feed whatever stands there, so its id, which no other piece can
        have, parts the ids.  Pieces of white space are encoded one by one.
        """
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        blank = np.fromiter((x.isspace() for x in own), bool, len(own))
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(x for x, b in zip(own, blank, strict=True) if not b)], add_special_tokens=False)[0].ids, np.uint32)
        size = np.zeros(len(own), np.int64)
        if not blank.all():
            breaks = np.flatnonzero(ids == line[0])
            size[~blank] = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
            ids = np.delete(ids, breaks)
        for i in np.flatnonzero(blank).tolist():
            got = self.tokenizer.encode(own[i], add_special_tokens=False).ids
            at = int(size[:i].sum())
            size[i], ids = len(got), np.insert(ids, at, got)
        return ids, size

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        data, offsets = text_buffer(column)
        found = []  # (start, end, id) of the added tokens within a text
        if self.added_pattern:
            whole = data.tobytes()
            if self.added_pattern.search(whole):
                for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                    found += [(m.start(), m.end(), self.added[m[0]]) for m in self.added_pattern.finditer(whole, a, b)]
        if not found:
            return self.plain(data, offsets)
        start, end, own = (np.array(x, np.int64) for x in zip(*found, strict=True))
        cuts = np.unique(np.concatenate([offsets, start, end]))  # a text goes on after a token as a new one
        ids, count = self.plain(data, cuts)
        before = np.concatenate([[0], np.cumsum(count)])
        at = np.searchsorted(cuts, start)
        keep = np.ones(len(ids), bool)
        for k in at.tolist():
            keep[before[k] + 1 : before[k + 1]] = False
        ids = ids.copy()
        ids[before[at]] = own
        count[at] = 1
        return ids[keep], np.diff(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(cuts, offsets)])

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for bytes of texts without added tokens."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        lead = (data & 0xC0) != 0x80
        char_at = np.concatenate([[0], np.cumsum(lead)])
        first = char_at[offsets]
        text = data.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = self.cuts(chars, first[first < len(chars)])
        ends = np.append(heads[1:], len(chars))
        keys = _piece_keys(chars, heads, ends)
        distinct, where, of = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        i = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[i] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            flat, size = self._encoded([text[a:b] for a, b in zip(heads[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, flat])
            place = np.searchsorted(self.keys, distinct[new])
            self.keys, self.at, self.size = np.insert(self.keys, place, distinct[new]), np.insert(self.at, place, at), np.insert(self.size, place, size)
        i = np.searchsorted(self.keys, distinct)[of]
        size = self.size[i]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[i] - total + size, size) + np.arange(total[-1])]
        return ids, np.diff(np.concatenate([[0], total])[np.searchsorted(heads, first)])


_KEYED = np.random.Generator(np.random.PCG64(20240608)).integers(1, 2**63, (2, 1 << 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _piece_keys(chars: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece: the sum of a keyed value of each character times one of its place."""
    size = (ends - heads).astype(np.int32)
    place = np.arange(len(chars), dtype=np.int32) - np.repeat(heads.astype(np.int32), size)
    value = _KEYED[0][chars & 0xFFFF]
    high = np.flatnonzero(chars > 0xFFFF)
    value[high] += (chars[high] >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    far = place >> 16
    value *= _KEYED[1][place & 0xFFFF]
    if far.any():
        value = mix(value + far.astype(np.uint64))
    return mix(np.add.reduceat(value, heads) + size.astype(np.uint64))


_encoders: dict[tuple[str, bool], Encoder] = {}


def write_records(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, special_as_text: bool = False
) -> DataFrame:
    """Encodes and writes all texts in ascending id order; the stored manifest of the shards.

    A task sorts and writes one shard of about `shard_bytes` of text: NAME.rec with the
    records, NAME.idx with their places, NAME.ids with the documents' ids.  A retried task
    writes files of another name, and the manifest has those of the task that counted.
    Columns of the manifest: shard, file, records, tokens, width.  width: bytes of an id, by
    default 2 or 4 as the vocabulary needs; too small a one is an error.

    Null and empty texts give a record of the end id only; a null doc_id sorts first.  Rows
    of an equal doc_id are ordered by a hash of their text, and repeated rows each give a
    record.  Other columns are ignored; an empty table gives no shard.
    """
    rows_in = texts(docs, id_col, text_col)
    total = rows_in.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows_in.repartitionByRange(max(1, math.ceil(total / shard_bytes)), *keys).sortWithinPartitions(*keys).withColumn("shard", F.spark_partition_id())

    def rows(batches):
        encode = _encoders.get((tokenizer, special_as_text))
        if encode is None:
            encode = _encoders[tokenizer, special_as_text] = Encoder(tokenizer, special_as_text=special_as_text)
        size = width or (4 if end_id >= 1 << 16 else encode.width)
        if size < encode.width or end_id >= 1 << 8 * size:
            raise ValueError(f"ids of this vocabulary don't fit into {size} bytes")
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        name, records, tokens, place, shard = uuid.uuid4().hex, 0, 0, 0, None
        opened = [fs.open_output_stream(posixpath.join(base, f"{name}.{kind}")) for kind in ("rec", "idx", "ids")]
        rec, idx, ids_out = opened
        tail = np.array([end_id], f"<u{size}").tobytes()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 21):
                shard = part.column(2)[0].as_py()
                ids, count = encode(part.column(1))
                ids, ends = ids.astype(f"<u{size}"), np.cumsum(count)
                places = []
                for a, b in zip(ends - count, ends, strict=True):
                    record = frame(ids[a:b].tobytes() + tail)
                    rec.write(record)
                    places.append(place)
                    place += len(record)
                idx.write(np.array(places, "<u8").tobytes())
                doc = part.column(0)
                ids_out.write(np.stack([doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False)], 1).astype("<i8").tobytes())
                records, tokens = records + len(count), tokens + int(count.sum()) + len(count)
        for f in opened:
            f.close()
        if records:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([records]), pa.array([tokens]), pa.array([size], pa.int32())], names=["shard", "file", "records", "tokens", "width"])

    return saved(ordered.mapInArrow(rows, "shard int, file string, records long, tokens long, width int"), "record-manifest")


def read_records(manifest: DataFrame, path: str, part_bytes: int = 1 << 22) -> DataFrame:
    """Reads the shards of a manifest back: doc_id, start, n_tokens and ids (packed, 4 bytes each).

    start counts the ids of all records before this one, in shard order.  Every checksum is
    verified; a wrong one is an error.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    starts = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    shards = manifest.join(starts, "shard").select("file", "start", "records", "width")

    def rows(batches):
        fs, base = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                at = lambda kind: fs.open_input_file(posixpath.join(base, f"{row['file']}.{kind}"))  # noqa: B023, E731
                with at("idx") as f:
                    places = np.frombuffer(f.read(), "<u8").astype(np.int64)
                if len(places) != row["records"]:
                    raise ValueError(f"{row['file']} has {len(places)} records, the manifest {row['records']}")
                start = row["start"]
                with at("rec") as rec, at("ids") as ids_in:
                    ends = np.append(places[1:], rec.size())
                    a = 0
                    while a < len(places):
                        b = max(a + 1, int(np.searchsorted(ends, int(places[a]) + part_bytes, "right")))
                        data, size, payloads = memoryview(rec.read_at(int(ends[b - 1] - places[a]), int(places[a]))), [], []
                        for p in (places[a:b] - places[a]).tolist():
                            payload, _ = unframe(data, p)
                            size.append(len(payload) // row["width"])
                            payloads.append(np.frombuffer(payload, f"<u{row['width']}").astype("<u4").tobytes())
                        size = np.array(size, np.int64)
                        doc, known = np.frombuffer(ids_in.read_at(16 * (b - a), 16 * a), "<i8").reshape(-1, 2).T
                        yield pa.record_batch([pa.array(doc, mask=known == 0), pa.array(start + np.cumsum(size) - size), pa.array(size), pa.array(payloads, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        start, a = start + int(size.sum()), b

    # a number of partitions: by their own small size the manifest's rows would all go to one task
    return shards.repartition(max(1, manifest.count()), F.col("file")).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def op9_records(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path as vocabulary

    at = scratch(spark, "records")
    manifest = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), at, str(vocabulary("byte_bpe_50k.json")))
    return read_records(manifest, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_records": op9_records}
ORACLE_SQL: dict[str, str] = {}
