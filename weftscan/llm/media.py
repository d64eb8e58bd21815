"""Netpbm and BMP pictures as columns: decode to arrays, area-resize by integral images, NPY tiles, difference hashes.

Decoders take P1 to P6 (8 and 16 bit) and uncompressed BMP of 1, 4, 8, 24 and 32 bits, top-down or bottom-up.
Pictures that cannot be decoded, and nulls, give null results, never an exception in a task.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import narrow_batches

#: Samples a row in a stored payload.
WIDTH = 64
TILE = 32
HASH_W, HASH_H = 9, 8


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette, rows bottom-up and padded to four bytes."""
    h, w = samples.shape
    stride = -(-w // 4) * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, :w] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    grey[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 54 + 1024 + body.size, 0, 0, 54 + 1024)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + info + grey.tobytes() + body.tobytes()


_SPACE = re.compile(rb"(?:\s|#[^\r\n]*)*")


def _number(data: bytes, at: int) -> tuple[int, int]:
    at = _SPACE.match(data, at).end()
    m = re.compile(rb"\d+").match(data, at)
    if not m:
        raise ValueError("a Netpbm header lacks a number")
    return int(m[0]), m.end()


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """(height, width) or (height, width, 3), and the maximum of a sample.

    16-bit samples are kept as such, bitmaps become 0 and 255; a sample above the maximum is an error.
    """
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm picture")
    w, at = _number(data, 2)
    h, at = _number(data, at)
    top = 1
    if kind not in (b"P1", b"P4"):
        top, at = _number(data, at)
        if not 0 < top < 65536:
            raise ValueError("a Netpbm maximum out of range")
    bands = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * bands
    if kind == b"P1":
        bits = re.sub(rb"#[^\r\n]*|\s", b"", data[at:])[:n]
        if bits.strip(b"01"):
            raise ValueError("a bitmap holds something else than 0 and 1")
        out = 255 - 255 * (np.frombuffer(bits, np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], np.int64)
    else:
        at += 1
        if kind == b"P4":
            row = -(-w // 8)
            raw = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
            out = 255 - 255 * np.unpackbits(raw, axis=1)[:, :w].ravel()
        else:
            out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    if out.size != n:
        raise ValueError("a Netpbm picture is cut short")
    top = 255 if kind in (b"P1", b"P4") else top
    if out.size and (out.max() > top or out.min() < 0):
        raise ValueError("a Netpbm sample is above the maximum")
    out = out.astype(np.uint8 if top < 256 else np.uint16)
    return out.reshape((h, w, 3) if bands == 3 else (h, w)), top


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width) where the palette is grey or absent, else (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    offset, size, w, h = struct.unpack_from("<IIii", data, 10)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if packing or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a BMP of an unsupported kind")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    if h > 0:
        raw = raw[::-1]
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = raw[:, :w]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :w]
    else:
        index = np.unpackbits(raw, axis=1)[:, :w]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((256, 3), np.uint8)
    palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    out = palette[index]
    return out[:, :, 0] if (palette[:, :1] == palette).all() else out


def decode_scaled(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of a picture, and the largest that a sample could be."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def decode(data: bytes) -> np.ndarray:
    return decode_scaled(data)[0]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, by differences of an interpolated integral image; floats, greys averaged."""
    grey = image.mean(axis=2) if image.ndim == 3 else image.astype(np.float64)
    h, w = grey.shape
    if not h or not w:
        return np.zeros((height, width))
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=total[1:, 1:])

    def at(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * n / cells
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    (y, fy), (x, fx) = at(h, height), at(w, width)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    both = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    cell = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return cell / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 8 cells is brighter than its right neighbour."""
    small = np.round(area_resize(image, HASH_H, HASH_W), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE, top: int = 255) -> bytes:
    """The picture in ``size`` x ``size`` samples of 0 to 255, as NPY; ``top`` is what its own samples reach at most."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, size, size) * (255 / top)), 0, 255).astype(np.uint8))
    return out.getvalue()


def store_text(text: bytes) -> tuple[bytes, bytes]:
    """(payload, picture): bytes with zeros up to a positive multiple of 64, and a lossless grey picture of them.

    The payload's checksum decides between PGM and BMP, so that equal texts are stored alike.
    """
    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return payload, (encode_bmp if zlib.crc32(payload) & 1 else encode_pgm)(samples)


MEDIA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()),
])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every whole text; null texts count as empty, repeated rows are stored each."""
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            media = [store_text(x)[1] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=MEDIA.names)

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("b")).mapInArrow(run, MEDIA)


FEATURES = T.StructType([
    T.StructField("height", T.LongType()), T.StructField("width", T.LongType()), T.StructField("samples", T.BinaryType()),
    T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType()),
])


def features(media: DataFrame, column: str = "media", tile: int = TILE) -> DataFrame:
    """Decode pictures and add height, width, samples (raw, for grey ones row by row), tile (NPY) and dhash.

    Nulls and what is no picture get nulls; other columns stay as they are, and of a clashing name the new one wins.
    """
    media = media.drop(*[c for c in FEATURES.names if c in media.columns])
    schema = T.StructType([*media.schema, *FEATURES])
    at = media.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for data in batch.column(at).to_pylist():
                try:
                    image, top = decode_scaled(data)
                    rows.append((*image.shape[:2], image.tobytes(), npy_tile(image, tile, top), difference_hash(image)))
                except (ValueError, TypeError, ArithmeticError, IndexError, struct.error):
                    rows.append((None,) * len(kinds))
            more = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return media.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    d = features(store_media(docs))
    return d.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, octet_length(samples) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
