import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from factorweave.llm import media


@pytest.mark.parametrize("shape", [(3, 5), (7, 9, 3), (1, 1), (2, 8)])
def test_encoded_images_come_back(shape):
    x = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.decode(media.encode_pgm(x) if x.ndim == 2 else media.encode_ppm(x)) == x).all()


def test_other_netpbm_forms():
    assert media.decode(b"P1\n# a\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 # c\n15\n0 15\n").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5 2 1 65535\n" + bytes([0, 0, 255, 255])).tolist() == [[0, 255]]


@pytest.mark.parametrize("data", [b"", b"P5", b"P5 2 2 255\n\x01", b"GIF89a", b"BM123", b"P9 1 1", b"P5 99999999999999999999 1 255\n\0", b"P5 1 1 0\n\0", b"P2 1 1 15 99", b"P2 1 1 255 99999999999999999999", b"P5 0 0 255\n"])
def test_bad_images(data):
    with pytest.raises((ValueError, ArithmeticError, LookupError, struct.error)):
        media.decode(data)


def test_huge_bmp_sizes_are_refused():
    data = bytearray(media.encode_bmp(np.zeros((4, 4), np.uint8)))
    data[18:26] = struct.pack("<ii", 2**31 - 1, 2**31 - 1)
    with pytest.raises(ValueError, match="BMP of"):
        media.decode(bytes(data))


@pytest.mark.parametrize(("h", "w", "strip"), [(10, 7, 3), (64, 64, 1 << 14), (3, 64, 2), (100, 5, 1)])
def test_area_resize_is_the_mean_over_areas(h, w, strip):
    x = np.random.default_rng(2).integers(0, 256, (h, w)).astype(float)
    fine = np.kron(x, np.ones((8, 9)))
    got = media.area_resize(x, 8, 9, strip)
    assert np.allclose(got, fine.reshape(8, h, 9, w).mean((1, 3)))


def test_stored_texts(docs, odd):
    rows = odd + [(30, "x" * 64), (31, "y" * 65), (32, "long " * 5000)]
    out = media.media_features(media.store_texts(docs(rows))).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t in rows}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r.n_bytes, bytes(r.samples), r.error) == (len(raw), padded, None)
        assert np.load(io.BytesIO(r.tile)).dtype == np.uint8 and len(r.dhash) == 16
    assert len({(r.dhash, hashlib.sha256(r.media).digest()) for r in out if texts[r.doc_id] == "a"}) == 1


def test_bad_media_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, b"nonsense"), (4, b"P5 99999999999999999999 1 255\n\0"), (5, b"P5 1 1 0\n\0"), (6, b"P2 1 1 255 x"), (3, media.encode_bmp(np.zeros((4, 4), np.uint8)))], "doc_id long, media binary")
    got = {r.doc_id: (r.tile is None, r.error is None) for r in media.media_features(df).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), 5: (True, False), 6: (True, False)}


def test_query_digests(spark, sf):
    rows = media.op2_media(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (r.payload_bytes - len(raw))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        assert r.media_sha256 == hashlib.sha256(media.encode_pgm(image)).hexdigest() and r.feature == media.difference_hash(image)
        tile = np.clip(np.rint(media.area_resize(image, min(32, len(image)), 32)), 0, 255).astype(np.uint8)
        assert r.tile_sha256 == hashlib.sha256(media.npy(tile)).hexdigest()


def test_tiles_are_written(spark, docs, tmp_path):
    written = media.write_tiles(media.media_features(media.store_texts(docs([(1, "abc"), (2, None)]))), str(tmp_path / "tiles"))
    assert written.columns == ["doc_id", "tile"]
    tiles = {r.doc_id: np.load(io.BytesIO(r.tile)) for r in spark.read.parquet(str(tmp_path / "tiles")).collect()}
    assert tiles[1].shape == (1, 32) and not tiles[2].any()


def test_columns_of_its_names_are_replaced_in_any_case(spark, docs):
    clash = media.store_texts(docs([(1, "abc")])).selectExpr("*", "'x' as Tile", "'x' as SAMPLES", "'x' as other")
    out = media.media_features(clash)
    assert [c.lower() for c in out.columns].count("tile") == 1 and out.select("tile", "other").first()["other"] == "x"
    assert isinstance(out.first()["tile"], bytes | bytearray)
