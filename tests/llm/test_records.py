import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factorweave.llm.common import scratch
from factorweave.llm.records import Encoder, frame, masked_crc, op9_records, read_records, unframe, write_records

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(plain):
    rng = random.Random(1)
    letters = "ab'st re ve ll d\n\t  12é.,!’漢字　'x\x1c\x85 \U0001f600\U0001d400 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a b", "é", ""]) for _ in range(8)) for _ in range(200)]
    texts += ["hi <|endoftext|> yo", "<|endoftext|>", "<|endof", "text|>", "<|endoftext|><|endoftext|>  x ", "", "it's we'll 'tis 'veab I'd", "a  b   c\n\n d \n", "<|endoftext|> x", "\n", "   ", "x" * 3000, "word " * 5000]
    for most in (1_500_000, 5):
        ids, count = Encoder(PATH, most)(pa.array(texts))
        ends = np.cumsum(count)
        for t, a, b in zip(texts, ends - count, ends):
            assert plain.encode(t, add_special_tokens=False).ids == ids[a:b].tolist(), t


def test_special_tokens_as_text():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    assert Encoder(PATH, special_as_text=True)(pa.array(["hi <|endoftext|> yo"]))[0].tolist() == t.encode("hi <|endoftext|> yo", add_special_tokens=False).ids


def test_frames():
    data = memoryview(frame(b"abc") + frame(b""))
    first, at = unframe(data, 0)
    second, end = unframe(data, at)
    assert (bytes(first), bytes(second), end) == (b"abc", b"", len(data))
    assert masked_crc(b"abc") != zlib.crc32(b"abc")
    for i in range(len(frame(b"abc"))):
        bad = bytearray(frame(b"abc"))
        bad[i] ^= 1
        with pytest.raises(ValueError):
            unframe(memoryview(bytes(bad)), 0)


@pytest.mark.parametrize(("width", "shard_bytes"), [(None, 1 << 24), (2, 3000), (4, 3000)])
def test_written_records_come_back(spark, docs, odd, plain, width, shard_bytes):
    rows = odd + [(40 + i, "some <|endoftext|> words " * i) for i in range(60)]
    at = scratch(spark, "test-records")
    manifest = write_records(docs(rows), at, PATH, width=width, shard_bytes=shard_bytes)
    assert (manifest.count() > 1) == (shard_bytes < 1 << 24) and {r.width for r in manifest.collect()} == {width or 2}
    got = sorted(read_records(manifest, at).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    texts, start = dict(rows), 0
    for r in got:
        want = [*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(want), want)
        start += len(want)


def test_ids_that_do_not_fit_are_refused(spark, docs):
    for more in ({"width": 1}, {"width": 2, "end_id": 1 << 16}):
        with pytest.raises(Exception, match="don't fit"):
            write_records(docs([(1, "a")]), scratch(spark, "test-records"), PATH, **more)


def test_empty_table(spark, docs):
    at = scratch(spark, "test-records")
    assert read_records(write_records(docs([]), at, PATH), at).collect() == []


def test_query(spark, sf, plain):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in op9_records(spark, sf).collect()}
    start = 0
    for i, t in texts:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
