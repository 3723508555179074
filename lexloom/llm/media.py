"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays, resized and fingerprinted.

`describe_media` adds to each row the decoded shape, an NPY tile (area-resized by integral images) and a difference hash.
`texts_as_media` stores any text losslessly as a grey Netpbm image. Images are handled one row at a time inside Arrow
batches; resizing sums samples between its cuts only, so memory is a few copies of the largest image.

Defined results: null or damaged media have null shape, tile and hash and an `error`; an empty text is one row of 64 zero
bytes; repeated rows give equal values; an empty table gives an empty result; other columns pass through untouched, those
named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, BinaryType

from lexloom.llm.common import lean, materialise, text_of

ROW = 64  # bytes of payload in a row of a stored text's image
TILE = 16  # side of a tile
HASH = 8  # a difference hash has HASH x HASH bits
SMALL = 1 << 16  # samples of which the whole integral image is made


# ---- formats ---------------------------------------------------------------------------------------------------


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey 8-bit image (height x width) as binary Netpbm."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after the magic, with comments skipped; the place after them."""
    found, at = [], 2
    while len(found) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        stop = at
        while stop < len(data) and data[stop : stop + 1].isdigit():
            stop += 1
        if stop == at:
            raise ValueError("bad header")
        found.append(int(data[at:stop]))
        at = stop
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, as uint8 or (samples above 255) uint16; height x width, or height x width x 3."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bits, deep = kind in (b"P1", b"P4"), kind in (b"P3", b"P6")
    numbers, at = _header(data, 2 if bits else 3)
    width, height, most = numbers[0], numbers[1], 1 if bits else numbers[2]
    if not (width > 0 and height > 0 and 0 < most < 65536):
        raise ValueError("bad size")
    shape = (height, width, 3) if deep else (height, width)
    count = height * width * (3 if deep else 1)
    if kind == b"P4":
        line = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, height * line, at + 1).reshape(height, line)
        return ((1 - np.unpackbits(raw, axis=1)[:, :width]) * 255).astype(np.uint8)
    if kind == b"P1":
        body = bytes(c for c in data[at:] if c in b"01")
        if len(body) < count:
            raise ValueError("too short")
        return ((1 - (np.frombuffer(body, np.uint8, count) - 48)) * 255).astype(np.uint8).reshape(shape)
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at:].split()[:count], dtype=np.int64)
        if len(samples) < count:
            raise ValueError("too short")
        return samples.astype(np.uint8 if most < 256 else np.uint16).reshape(shape)
    if most < 256:
        return np.frombuffer(data, np.uint8, count, at + 1).reshape(shape)
    return np.frombuffer(data, ">u2", count, at + 1).astype(np.uint16).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: height x width x 3, or height x width where the palette is grey."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    word = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, width, height, depth, packed = word(10), word(14), word(18, signed=True), word(22, signed=True), word(28, 2), word(30)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    rows, line = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * line, start).reshape(rows, line)
    if height > 0:
        raw = raw[::-1]  # stored from the bottom
    if depth >= 24:
        step = depth // 8
        return np.ascontiguousarray(raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1])
    n = word(46) or 1 << depth
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
    if depth == 8:
        index = raw[:, :width]
    elif depth == 4:
        index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    image = palette[index]
    return np.ascontiguousarray(image[:, :, 0]) if (palette == palette[:, :1]).all() else image


def encode_bmp(samples: np.ndarray) -> bytes:
    """Grey (palette) or RGB 8-bit samples as an uncompressed BMP."""
    grey = samples.ndim == 2
    height, width = samples.shape[:2]
    depth = 8 if grey else 24
    line = (width * depth + 31) // 32 * 4
    body = np.zeros((height, line), np.uint8)
    body[:, : width * depth // 8] = samples[::-1] if grey else samples[::-1, :, ::-1].reshape(height, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.size
    le = lambda v, n=4: int(v).to_bytes(n, "little")
    head = b"BM" + le(start + body.size) + le(0) + le(start) + le(40) + le(width) + le(height) + le(1, 2) + le(depth, 2) + le(0) + le(body.size) + le(2835) + le(2835) + le(len(palette)) + le(0)
    return head + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---- features --------------------------------------------------------------------------------------------------


def _cuts(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of `out` equal parts of 0..size: whole part and fraction (in out-ths)."""
    at = np.arange(out + 1, dtype=np.int64) * size
    return at // out, at % out


def _integral(grey: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The integral image at the given rows and columns only (ascending, from 0). Beyond SMALL samples they are summed between
    cuts, along the longer side first, so the most that is held is some cuts times the shorter side."""
    if grey.size <= SMALL:
        table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), dtype=np.int64)
        table[1:, 1:] = grey.astype(np.int64).cumsum(0).cumsum(1)
        return table[rows[:, None], columns]
    if grey.shape[0] < grey.shape[1]:
        return _integral(grey.T, columns, rows).T
    bands = np.zeros((len(rows), grey.shape[1]), dtype=np.int64)
    for i in range(1, len(rows)):
        bands[i] = grey[rows[i - 1] : rows[i]].sum(axis=0, dtype=np.int64)
    table = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i in range(1, len(columns)):
        table[:, i] = bands[:, columns[i - 1] : columns[i]].sum(axis=1)
    return table.cumsum(0).cumsum(1)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell's exact area, cells cutting through samples included, from the integral image; whole numbers throughout."""
    ys, fy = _cuts(grey.shape[0], height)
    xs, fx = _cuts(grey.shape[1], width)
    y1, x1 = np.minimum(ys + 1, grey.shape[0]), np.minimum(xs + 1, grey.shape[1])
    rows, columns = np.unique([*ys, *y1]), np.unique([*xs, *x1])
    table = _integral(grey, rows, columns)
    at = lambda of, places: np.searchsorted(of, places)
    table = table[at(rows, ys)] * (height - fy)[:, None] + table[at(rows, y1)] * fy[:, None]  # the integral at fractional heights, times `height`
    full = table[:, at(columns, xs)] * (width - fx) + table[:, at(columns, x1)] * fx
    sums = full[1:, 1:] - full[:-1, 1:] - full[1:, :-1] + full[:-1, :-1]
    area = grey.shape[0] * grey.shape[1]
    return ((2 * sums + area) // (2 * area)).astype(np.uint16)  # a cell holds area / (height * width); sums carry height * width


def grey_of(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image by whole-number weights (Rec. 601)."""
    if image.ndim == 2:
        return image
    out = np.empty(image.shape[:2], image.dtype)
    step = max(1, (1 << 18) // image.shape[1])
    for at in range(0, len(image), step):  # some rows at a time, as 32-bit numbers take more room than the image
        c = image[at : at + step].astype(np.uint32)
        out[at : at + step] = (299 * c[:, :, 0] + 587 * c[:, :, 1] + 114 * c[:, :, 2] + 500) // 1000
    return out


def difference_hash(grey: np.ndarray, side: int = HASH) -> str:
    """A bit for each cell of a side x (side + 1) grid that is darker than its right neighbour; as hex."""
    cells = area_resize(grey, side, side + 1)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def tile_npy(grey: np.ndarray, side: int = TILE) -> bytes:
    """The resized image as an NPY file (uint8, or uint16 for deep images)."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(area_resize(grey, side, side), grey.dtype), allow_pickle=False)
    return out.getvalue()


# ---- columns ---------------------------------------------------------------------------------------------------


def describe_media(table: DataFrame, media: str = "media", tile: int = TILE) -> DataFrame:
    """table's columns plus height, width, channels (int), tile (binary, NPY), dhash (string) and error (string)."""
    kept = table.drop(*[c for c in ("height", "width", "channels", "tile", "dhash", "error") if c != media])
    schema = StructType([*kept.schema.fields, *[StructField(c, IntegerType()) for c in ("height", "width", "channels")], StructField("tile", BinaryType()), StructField("dhash", StringType()), StructField("error", StringType())])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, "null media"
        try:
            image = decode(data)
            grey = grey_of(image)
            return *image.shape[:2], 1 if image.ndim == 2 else 3, tile_npy(grey, tile), difference_hash(grey), None
        except (ValueError, IndexError, OverflowError) as e:
            return None, None, None, None, None, str(e)[:80] or type(e).__name__

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(media)
            found = [one(x.as_py()) for x in batch.column(at)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return kept.mapInArrow(lean(run), schema)


def payload_of(image: np.ndarray) -> bytes:
    return image.tobytes()


def texts_as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (long) and media: the text's UTF-8, padded by bytes 0 to a positive multiple of 64, as a grey image 64 samples wide."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).cast("binary").alias("__ll_b"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            media, sizes = [], []
            for x in batch.column(1):
                data = x.as_py()
                padded = data + bytes(-len(data) % ROW if data else ROW)
                media.append(encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW)))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, media binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """What the stored media hold, computed from their bytes alone: payload and media digests, and describe_media's hash and
    tile. Each image is decoded once."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def one(media: bytes) -> tuple:
        image = decode(media)
        payload = payload_of(image)
        grey = grey_of(image)
        feature = f"{difference_hash(grey)}:{zlib.crc32(tile_npy(grey)):08x}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            found = [one(m.as_py()) for m in batch.column(2)]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def store_media(media: DataFrame) -> DataFrame:
    """Write a media table to the shared folder (Parquet, zstd) and read it back."""
    return materialise(media, "media")
