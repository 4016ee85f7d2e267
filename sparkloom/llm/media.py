"""Media columns: Netpbm and BMP to numpy arrays, NPY tiles, difference hashes.

Images are decoded in numpy, resized by area with an integral image, and kept as
NPY tiles with a difference hash.  Bytes of any kind can be stored as an 8-bit
image and read back without loss.  A null text or image counts as empty; what is
no image of a known kind decodes to nothing, and its tile and hash are null.
Equal texts have equal results, and repeated rows stay; a text of any length is
one image.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_slices

#: Samples in a row of a stored payload.
WIDTH = 64
#: Height and width of tiles; a difference hash compares neighbours in a row, so it has 64 bits.
TILE = (8, 9)
#: Netpbm's kinds, as channels and whether the samples are text.
KINDS = {b"P1": (0, True), b"P2": (1, True), b"P3": (3, True), b"P4": (0, False), b"P5": (1, False), b"P6": (3, False)}


def decode_netpbm(data: bytes) -> np.ndarray | None:
    """PBM, PGM or PPM, plain or raw, as (height, width) or (height, width, 3) of uint8, or uint16 where samples go beyond 255.

    Samples are scaled so that the file's largest value is the type's. A sample above that value breaks an image, as a missing one does.
    """
    if data[:2] not in KINDS:
        return None
    channels, plain = KINDS[data[:2]]
    head, at = [], 2
    while len(head) < (3 if channels else 2):
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                at = (data.find(b"\n", at) + 1) or len(data)
            else:
                at += 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        head.append(int(data[at:end]))
        at = end
    width, height, most = (*head, 1)[:3]
    shape = (height, width, 3) if channels == 3 else (height, width)
    n = math.prod(shape)
    if not 0 < most <= 0xFFFF or n > 8 * len(data):  # a sample takes a bit at least
        return None
    kind = np.dtype(">u2") if most > 255 else np.dtype("u1")
    if plain:
        body = b" ".join(x.partition(b"#")[0] for x in data[at:].split(b"\n"))
        found = [x - 48 for x in body if x in b"01"] if not channels else body.split()[:n]
        if channels and not all(x.isdigit() and len(x) <= 5 for x in found):
            return None
        out = np.array(found[:n], np.int64)
    elif at >= len(data):
        return None
    elif not channels:
        row = -(-width // 8)
        if len(data) - at - 1 < row * height:
            return None
        out = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1)).reshape(height, row * 8)[:, :width].ravel()
    else:
        out = np.frombuffer(data, kind, min(n, (len(data) - at - 1) // kind.itemsize), at + 1)
    if len(out) < n or (channels and n and out.max() > most):
        return None
    if not channels:
        return (1 - out.reshape(shape)).astype(np.uint8) * np.uint8(255)
    full = 0xFFFF if most > 255 else 0xFF
    out = out if most == full else (out.astype(np.int64) * full + most // 2) // most
    return out.astype(np.uint16 if most > 255 else np.uint8).reshape(shape)


def encode_pgm(samples: np.ndarray) -> bytes:
    """A (height, width) array of uint8 as a raw PGM."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def _field(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as values from 0 to 255."""
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((((pixels & mask) >> low) * 255 + most // 2) // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray | None:
    """An uncompressed BMP of 8, 16, 24 or 32 bits a pixel; a grey palette gives (height, width), else RGB. Bit fields are scaled to 8 bits; alpha is left out."""
    if data[:2] != b"BM" or len(data) < 54:
        return None
    start, size, width, height, _, bits, packed, _, _, _, colours = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    row, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    if size < 40 or (bits, packed) not in ((8, 0), (16, 0), (16, 3), (24, 0), (32, 0), (32, 3)) or width <= 0 or not rows or len(data) < start + row * rows or start < 14 + size:
        return None
    body = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)[:: -1 if height > 0 else 1]
    if bits == 8:
        most = colours or 256
        if most > 256 or 14 + size + 4 * most > start:
            return None
        palette = np.frombuffer(data, np.uint8, 4 * most, 14 + size).reshape(-1, 4)[:, 2::-1]
        if body[:, :width].max() >= most:
            return None
        out = palette[body[:, :width]]
        return np.ascontiguousarray(out[:, :, 0] if (palette == palette[:, :1]).all() else out)
    if bits == 16 or packed == 3:
        if packed == 3 and start < 66:
            return None
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x03E0, 0x001F)
        if not all(masks) or any(m >> bits or (m // (m & -m)) & (m // (m & -m) + 1) for m in masks):  # each must be bits in a row
            return None
        pixels = np.ascontiguousarray(body[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        return np.stack([_field(pixels, m) for m in masks], axis=2)
    return np.ascontiguousarray(body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])


def encode_bmp(samples: np.ndarray) -> bytes:
    """(height, width) as 8 bits with a grey palette, (height, width, 3) as 24 bits."""
    height, width, bits = *samples.shape[:2], 8 if samples.ndim == 2 else 24
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    body = samples[::-1] if bits == 8 else samples[::-1, :, ::-1].reshape(height, width * 3)
    body = np.pad(body, ((0, 0), (0, -body.shape[1] % 4))).tobytes()
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(body), 0, 0, start, 40, width, height, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0) + palette + body


def decode(data: bytes | None) -> np.ndarray | None:
    """The image, or nothing if the bytes are none, or a broken or cut one."""
    return decode_netpbm(data or b"") if (data or b"")[:1] == b"P" else decode_bmp(data or b"")


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area under each new sample, by one integral image, rounded to uint8."""
    grey = samples.astype(np.int64) if samples.ndim == 2 else samples.astype(np.int64).sum(axis=2)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=sums[1:, 1:])

    def at_edges(table: np.ndarray, n: int) -> np.ndarray:
        """n times the table's values at n + 1 edges: whole numbers, so that halves are rounded as halves."""
        edges = np.arange(n + 1) * (len(table) - 1)
        low = np.minimum(edges // n, len(table) - 2)
        return table[low] * n + (edges - low * n)[:, None] * (table[low + 1] - table[low])

    boxes = np.diff(np.diff(at_edges(at_edges(sums, height).T, width).T, axis=0), axis=1)
    whole = grey.size * (257 if samples.dtype == np.uint16 else 1) * (1 if samples.ndim == 2 else samples.shape[2])
    return np.clip(np.rint(boxes / whole), 0, 255).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """A bit for each pair of neighbours in a row: the right one is brighter."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def to_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's payload as a raw PGM, WIDTH samples wide."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [payload(t) for t in batch.column("text").to_pylist()]
        media = [encode_pgm(np.frombuffer(x, np.uint8).reshape(-1, WIDTH)) for _, x in each]
        return pa.record_batch([batch.column("doc_id"), pa.array([n for n, _ in each], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(step), "doc_id long, n_bytes long, media binary")


def tiles(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, height, width, tile (NPY of TILE samples) and hash of every image in the column media."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [decode(x) for x in batch.column("media").to_pylist()]
        found = [x if x is not None and x.size else None for x in found]
        small = [area_resize(x, *TILE) if x is not None else None for x in found]
        columns = [
            batch.column(key),
            pa.array([x.shape[0] if x is not None else None for x in found], pa.int32()),
            pa.array([x.shape[1] if x is not None else None for x in found], pa.int32()),
            pa.array([npy(x) if x is not None else None for x in small], pa.binary()),
            pa.array([difference_hash(x) if x is not None else None for x in small], pa.string()),
        ]
        return pa.record_batch(columns, [key, "height", "width", "tile", "hash"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "media").mapInArrow(by_slices(step), f"{key} {kind}, height int, width int, tile binary, hash string")


def digests(docs: DataFrame) -> DataFrame:
    """Every text stored as an image in a column, read back from the stored bytes, and described.

    The feature is the difference hash of the tile and the CRC-32 of the tile's NPY form, which is the column tile.
    """

    def one(n: int, media: bytes) -> tuple:
        read = decode(media)
        back = read.tobytes()
        tile = npy(small := area_resize(read, *TILE))
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(small)}:{zlib.crc32(tile):08x}", tile

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*map(one, batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()), strict=True)) or [[]] * len(names)
        kinds = [pa.string() if "sha256" in n or n == "feature" else pa.binary() if n == "tile" else pa.int64() for n in names]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return to_images(docs).mapInArrow(by_slices(step), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
