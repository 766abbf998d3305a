"""Media columns: Netpbm and BMP images in binary columns, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import scratch, texts
from factorweave.llm.words import pieces, text_buffer

#: Bytes of a payload are stored as the samples of a gray image of this width.
WIDTH = 64
_HEADER_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A gray (h, w) uint8 array as binary PGM (P5)."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    """An (h, w, 3) uint8 array as binary PPM (P6)."""
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A gray (h, w) or colour (h, w, 3) uint8 array as an uncompressed BMP of 8 or 24 bits."""
    h, w = samples.shape[:2]
    gray = samples.ndim == 2
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if gray else np.zeros(0, np.uint8)
    rows = samples if gray else samples[..., ::-1].reshape(h, w * 3)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))[::-1]
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if gray else 24, 0, rows.size, 2835, 2835, 256 if gray else 0, 0)
    return head + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 0x30, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEADER_FIELD.match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = (*fields, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    if not 0 < most < 1 << 16:
        raise ValueError(f"Netpbm samples of up to {most}")
    if not 0 < w * h * depth <= 8 * len(data):
        raise ValueError(f"Netpbm of {w} x {h} in {len(data)} bytes")
    if kind == 1:
        out = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[: w * h] - 0x30
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[: w * h * depth], dtype=np.int64)
    elif kind == 4:
        row = -(-w // 8)
        out = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * depth, at + 1)
    if out.size != w * h * depth:
        raise ValueError("Netpbm samples are cut short")
    if out.max() > most:
        raise ValueError("Netpbm samples beyond their maximum")
    if kind in (1, 4):
        out = 1 - out  # 1 is black
    if most != 255:
        out = (out.astype(np.int64) * 255 + most // 2) // most
    return out.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    row = -(-w * bits // 32) * 4
    if w <= 0 or not 0 < row * abs(h) <= len(data):
        raise ValueError(f"BMP of {w} x {h} in {len(data)} bytes")
    raw = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    raw = raw[::-1] if h > 0 else raw
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., 2::-1])
    if bits < 8:
        raw = np.unpackbits(raw, axis=1).reshape(abs(h), -1, bits)
        raw = (raw * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((256, 3), np.uint8)
    palette[:colours] = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    out = palette[raw[:, :w]]
    return out[..., 0].copy() if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1-P6 or uncompressed BMP to a uint8 array of shape (h, w) or (h, w, 3)."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[0] == 0x50 and data[1] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _at(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Running sums at fractional edges: linear between whole ones, as samples are boxes."""
    whole = np.minimum(edges.astype(np.int64), len(sums) - 2)
    part = (edges - whole).reshape(-1, *[1] * (sums.ndim - 1))
    return sums[whole] * (1 - part) + sums[whole + 1] * part


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 1 << 14) -> np.ndarray:
    """Mean over each target cell's area, as float64, from the integral image.

    The integral image is taken in strips of rows and kept only at the cells' edges, so
    the memory doesn't grow with the image.
    """
    h, w = image.shape[:2]
    xs, ys = np.arange(width + 1) * (w / width), np.arange(height + 1) * (h / height)
    at_edges = np.zeros((height + 1, width + 1, *image.shape[2:]))
    above = np.zeros((width + 1, *image.shape[2:]))
    for a in range(0, h, strip):
        part = image[a : a + strip].astype(np.float64)
        across = np.zeros((w + 1, len(part), *image.shape[2:]))
        np.cumsum(np.swapaxes(part, 0, 1), axis=0, out=across[1:])
        rows = np.swapaxes(_at(across, xs), 0, 1)
        down = np.concatenate([above[None], above + np.cumsum(rows, axis=0)])
        inside = (ys > a) & (ys <= a + len(part))
        at_edges[inside] = _at(down, ys[inside] - a)
        above = down[-1]
    cells = np.diff(np.diff(at_edges, axis=0), axis=1)
    return cells * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hex digits: is each cell of an 8 x 9 resize darker than its right neighbour?"""
    gray = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a gray image of width 64.

    Zero bytes are appended up to a positive multiple of 64, so null and empty texts give
    one black row.  Every input row gives one row.
    """

    def rows(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                media = []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    h = max(1, -(-int(b - a) // WIDTH))
                    samples = np.zeros(h * WIDTH, np.uint8)
                    samples[: b - a] = data[a:b]
                    media.append(encode_pgm(samples.reshape(h, WIDTH)))
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def media_features(images: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile: int = 32) -> DataFrame:
    """Decodes a media column; adds samples, tile (NPY, at most tile x tile) and dhash.

    Null media, or media that can't be decoded: samples, tile and dhash are null and `error`
    says why.  Columns of these four names, in any case, are replaced; all others are kept.
    """
    own = [c for c in images.columns if c.lower() not in ("samples", "tile", "dhash", "error")]
    images = images.select(*[F.col(f"`{c}`") for c in own])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", samples binary, tile binary, dhash string, error string"

    def rows(batches):
        for batch in batches:
            at = batch.schema.names.index(media_col)
            for part in pieces(batch, media_col):
                out = {"samples": [], "tile": [], "dhash": [], "error": []}
                for data in part.column(at).to_pylist():
                    try:
                        if data is None:
                            raise ValueError("no media")
                        image = decode(data)
                        small = np.clip(np.rint(area_resize(image, min(tile, image.shape[0]), min(tile, image.shape[1]))), 0, 255)
                        got = (image.tobytes(), npy(small.astype(np.uint8)), difference_hash(image), None)
                    except (ValueError, struct.error, ArithmeticError, LookupError) as e:
                        got = (None, None, None, str(e))
                    for c, v in zip(out.values(), got, strict=True):
                        c.append(v)
                kinds = (pa.binary(), pa.binary(), pa.string(), pa.string())
                yield pa.record_batch([*part.columns, *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=[*own, *out])

    return images.mapInArrow(rows, schema)


def write_tiles(features: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """Writes the NPY tiles with other columns, by default doc_id, as Parquet at path; that table."""
    tiles = features.select(*(columns or ["doc_id"]), "tile")
    tiles.write.mode("overwrite").parquet(path)
    return tiles.sparkSession.read.schema(tiles.schema).parquet(path)


def op2_media(spark, sf_dir: str) -> DataFrame:
    out = media_features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = out.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), "tile",
    )
    tiles = write_tiles(out, scratch(spark, "tiles"), [c for c in out.columns if c != "tile"])
    return tiles.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def media_digests(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_media, which also gives a CRC and image features."""
    return op2_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


QUERIES = {"op2_media": op2_media, "media_digests": media_digests}
ORACLE_SQL = {
    "media_digests": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
n AS (SELECT doc_id, raw, octet_length(raw) AS n_bytes, greatest(1, (octet_length(raw) + 63) // 64) AS h FROM d),
p AS (SELECT doc_id, n_bytes, h, raw || unhex(repeat('00', (64 * h - n_bytes)::INT)) AS payload FROM n),
m AS (SELECT *, encode('P5' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10)) || payload AS media FROM p)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256 FROM m"""
}
