"""Media columns: Netpbm and BMP images to arrays, area-resized tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

#: An image made from text is 64 pixels wide: 192 bytes of 8-bit RGB a row.
ROW_BYTES = 192


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit bottom-up BMP; rows are padded to four bytes."""
    height, width = pixels.shape[:2]
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    fields, at = [], 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("netpbm header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    if not (width and height and 0 < top < 65536):
        raise ValueError(f"netpbm image of {width} x {height} pixels and {top} levels")
    bands = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * bands
    if kind in (b"P1", b"P2", b"P3"):
        found = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", re.sub(rb"#[^\n]*", b"", data[at:]))[:n]
        samples = np.array([int(x) for x in found])
    elif kind == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        samples = bits[:, :width].reshape(-1)
    elif kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    else:
        raise ValueError(f"not a netpbm image: {kind!r}")
    if len(samples) < n:
        raise ValueError("netpbm samples are cut short")
    if kind in (b"P1", b"P4"):
        samples = 1 - samples
    if top != 255:
        samples = np.rint(samples * (255 / top))
    return samples.astype(np.uint8).reshape(height, width, bands)


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError(f"BMP with {depth} bits and compression {packing} is not supported")
    if width < 1 or not height:
        raise ValueError(f"BMP of {width} x {height} pixels")
    rows, stride = abs(height), -(-width * depth // 32) * 4
    samples = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * depth // 8]
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        pixels = palette[samples]
    else:
        pixels = samples.reshape(rows, width, depth // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes) -> np.ndarray:
    """Height x width x bands, 8-bit. Raises ValueError for anything but Netpbm (P1-P6) and BMP (8, 24, 32 bits)."""
    if data[:2] == b"BM":
        return _bmp(data)
    return _netpbm(data)


def _edges(integral: np.ndarray, n: int) -> np.ndarray:
    """The integral image read at n+1 evenly spaced, fractional places along its first axis."""
    at = np.linspace(0, len(integral) - 1, n + 1)
    low = np.minimum(at.astype(int), len(integral) - 2)
    part = (at - low).reshape(-1, *[1] * (integral.ndim - 1))
    return integral[low] * (1 - part) + integral[low + 1] * part


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from one integral image."""
    integral = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    integral[1:, 1:] = grey.cumsum(0, dtype=float).cumsum(1)
    sums = np.diff(np.diff(_edges(_edges(integral, height).T, width).T, axis=0), axis=1)
    return sums * (height * width / (grey.shape[0] * grey.shape[1]))


def difference_hash(grey: np.ndarray, side: int = 8) -> str:
    """Bits that say whether a cell is darker than its right neighbour, as hexadecimal."""
    small = area_resize(grey, side, side + 1)
    bits = np.packbits((small[:, :-1] + 1e-6 < small[:, 1:]).reshape(-1))
    return bits.tobytes().hex()


def tile(data: bytes, side: int = 16) -> tuple[np.ndarray, bytes, str]:
    """Decoded pixels, the resized grey tile as NPY bytes, and the difference hash."""
    pixels = decode(data)
    grey = pixels.mean(axis=2)
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey, side, side)), 0, 255).astype(np.uint8))
    return pixels, out.getvalue(), difference_hash(grey)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES
    return len(raw), raw.ljust(n, b" ")


def store(payload: bytes) -> bytes:
    """BMP for payloads of odd CRC, else PPM: a property of the bytes, so equal texts are stored alike."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    return encode_bmp(pixels) if zlib.crc32(payload) & 1 else encode_ppm(pixels)


MEDIA = pa.schema(
    [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
     ("feature", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("tile_npy", pa.binary()), ("media", pa.binary())]
)


def _as_batch(ids: pa.Array, name: str, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The ids as they came, and the columns of ``rows``."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)]], names=[name, *schema.names])


def _with_id(id_type: T.DataType, name: str, schema: pa.Schema) -> T.StructType:
    return T.StructType([T.StructField(name, id_type), *from_arrow_schema(schema).fields])


def text_media(docs: DataFrame, *, keep_media: bool = True) -> DataFrame:
    """Store each whole text as the samples of an image, read it back, and describe what was read.

    Columns: doc_id (any type, as it is) and those of MEDIA; ``media`` is null unless ``keep_media``. Null and empty texts are one row of spaces;
    equal texts have equal values, and repeated rows and ids give a row each. Other columns are left out, whatever their names.
    Works a document at a time inside Arrow batches, without a shuffle; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n, payload = payload_of(text)
                media = store(payload)
                pixels, npy, feature = tile(media)
                back = pixels.tobytes()
                out.append(
                    (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, "bmp" if media[:2] == b"BM" else "ppm",
                     pixels.shape[1], pixels.shape[0], npy, media if keep_media else None)
                )
            yield _as_batch(batch.column(0), "doc_id", out, MEDIA)

    return docs.select("doc_id", "text").mapInArrow(rows, _with_id(docs.schema["doc_id"].dataType, "doc_id", MEDIA))


IMAGE = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("bands", pa.int32()), ("tile_npy", pa.binary()), ("feature", pa.string()), ("error", pa.string())])


def image_tiles(images: DataFrame, *, key: str = "id", content: str = "content", side: int = 16) -> DataFrame:
    """Tiles and difference hashes of a binary column of Netpbm or BMP files, with the id as it is.

    What is no such file, is cut short, or has no pixels or levels gives its error and nulls; so do nulls. Repeated rows give a row each.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    pixels, npy, feature = tile(bytes(data or b""), side)
                    out.append((pixels.shape[1], pixels.shape[0], pixels.shape[2], npy, feature, None))
                except (ValueError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, None, str(e) or type(e).__name__))
            yield _as_batch(batch.column(0), "id", out, IMAGE)

    return images.select(images[key].alias("id"), images[content].alias("content")).mapInArrow(rows, _with_id(images.schema[key].dataType, "id", IMAGE))
