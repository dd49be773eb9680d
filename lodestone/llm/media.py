"""Netpbm and BMP columns: decode to numpy, area-resize, NPY tiles, difference hashes.

Images are stored as binary columns of a written table, so any store that Spark
writes will do, and read back from there. Decoders take P1 to P6 and uncompressed
1, 8, 24 and 32 bit BMP. Resizing averages the exact source area of each target
pixel with integral images (summed-area tables) of one strip of rows after the
other, in integers until the last division, so that equal pixels give equal tiles
on every machine and a very long text costs a strip beyond its own bytes.
``write_tiles`` puts tiles into NPY files, many to a file, with an index.

Cases: null texts count as empty; an empty text still has one row of padding
and so an image; null or damaged image bytes give null tiles and hashes and
never an exception; extra columns pass through, those named as outputs are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import map_rows, staged, strings, trimmed, write_files

ROW_BYTES = 576  # 192 pixels of three samples: no row needs padding in either format


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 for a height x width array, P6 for height x width x 3, 8-bit samples."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    found, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    for _ in range(fields):
        m = token.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """uint8 pixels; samples of other depths are scaled to 0..255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bits = kind in (b"P1", b"P4")
    (width, height, *depth), at = _header(data, 2 if bits else 3)
    top, planes = (depth[0] if depth else 1), 3 if kind in (b"P3", b"P6") else 1
    if not 0 < top < 65536:
        raise ValueError("broken Netpbm depth")
    count = width * height * planes
    if kind == b"P1":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        samples = np.frombuffer(re.sub(rb"[^01]", b"", body), np.uint8)[:count] - 48
    elif kind in (b"P2", b"P3"):
        samples = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count], dtype=np.int64)
    elif kind == b"P4":
        packed = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1)
        samples = np.unpackbits(packed.reshape(height, -1), axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    if samples.size != count:
        raise ValueError("short Netpbm")
    if bits:
        samples = np.where(samples == 1, 0, 255)
    elif top != 255:
        samples = (np.minimum(samples.astype(np.int64), top) * 255 * 2 + top) // (2 * top)
    shape = (height, width) if planes == 1 else (height, width, 3)
    return samples.astype(np.uint8).reshape(shape)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, or 8-bit with a grey palette, bottom row first."""
    height, width = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = pixels if grey else pixels[:, :, ::-1]
    line = rows.reshape(height, -1)[::-1].astype(np.uint8)
    line = np.pad(line, ((0, 0), (0, -line.shape[1] % 4)))
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    body = line.tobytes()
    return struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0) + palette + body


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, tall, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or depth not in (1, 8, 24, 32) or width <= 0:
        raise ValueError("BMP kind not supported")
    height = abs(tall)
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    rows = rows if tall < 0 else rows[::-1]
    if depth in (24, 32):
        return np.ascontiguousarray(rows[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1])
    (used,) = struct.unpack_from("<I", data, 46)
    index = np.unpackbits(rows, axis=1)[:, :width] if depth == 1 else rows[:, :width]
    palette = np.zeros((256, 4), np.uint8)
    listed = np.frombuffer(data, np.uint8, 4 * (used or 1 << depth), 14 + head).reshape(-1, 4)
    palette[: len(listed)] = listed
    picked = palette[index][:, :, 2::-1]
    same = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return np.ascontiguousarray(picked[:, :, 0] if same else picked)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


STRIP = 1 << 19  # samples that are widened at once


def _integral(summed: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """Weighted area sums along the first axis between edges, in units of 1/size of a source row."""
    whole, part = edges // size, edges % size
    ext = np.concatenate([summed, summed[-1:]])
    at = ext[whole] * size + (ext[whole + 1] - ext[whole]) * part.reshape((-1,) + (1,) * (summed.ndim - 1))
    return np.diff(at, axis=0)


def _sums(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *a.shape[1:]), np.int64), a.cumsum(axis=0, dtype=np.int64)])


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's exact source area, rounded half up."""
    h, w = pixels.shape[:2]
    out = np.empty((height, width, *pixels.shape[2:]), np.uint8)
    edges, across = np.arange(height + 1, dtype=np.int64) * h, np.arange(width + 1, dtype=np.int64) * w
    step = max(1, STRIP * height // max(1, pixels.size))
    for i in range(0, height, step):
        own = edges[i : i + step + 1]
        top, end = own[0] // height, -(-own[-1] // height)
        rows = 0
        part = max(1, STRIP // max(1, pixels[0].size))
        if end - top <= part or len(own) > 2:
            rows = _integral(_sums(pixels[top:end]), own - top * height, height)
        else:  # one target row of very many source rows
            for at in range(top, end, part):
                upto = min(end, at + part)
                inside = np.clip(own, at * height, upto * height) - at * height
                rows = rows + _integral(_sums(pixels[at:upto]), inside, height)
        both = np.swapaxes(_integral(_sums(np.swapaxes(rows, 0, 1)), across, width), 0, 1)
        out[i : i + step] = (both * 2 + h * w) // (2 * h * w)
    return out


def grey(pixels: np.ndarray) -> np.ndarray:
    """Integer luma of three-plane pixels."""
    if pixels.ndim == 2:
        return pixels
    out = np.empty(pixels.shape[:2], np.uint8)
    step = max(1, STRIP // max(1, pixels[0].size))
    for at in range(0, len(pixels), step):
        p = pixels[at : at + step].astype(np.uint32)
        out[at : at + step] = (299 * p[:, :, 0] + 587 * p[:, :, 1] + 114 * p[:, :, 2] + 500) // 1000
    return out


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """side x side bits, row by row: is a cell darker than the one to its right."""
    small = area_resize(grey(pixels), side, side + 1)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_bytes(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(pixels), allow_pickle=False)
    return out.getvalue()


def text_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with 255s up to a positive multiple of a row."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % ROW_BYTES if raw else ROW_BYTES)


def payload_image(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)


def text_images(docs: DataFrame, text: str = "text", form: str = "netpbm") -> DataFrame:
    """Each text stored losslessly as an image: adds ``n_bytes`` and ``media``."""
    encode = encode_bmp if form == "bmp" else encode_netpbm

    def make():
        def step(batch):
            found = [text_payload(t) for t in strings(batch, text)]
            return {"n_bytes": [n for n, _ in found], "media": [encode(payload_image(p)) for _, p in found]}

        return step

    return map_rows(docs, make, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), keep=[c for c in docs.columns if c != text], rows=128)


def _read(data: bytes | None, side: int, samples: bool) -> tuple:
    """tile, height, width, feature, samples of stored bytes; nulls if they are damaged."""
    try:
        pixels = decode(bytes(data))
        return npy_bytes(area_resize(pixels, side, side)), pixels.shape[0], pixels.shape[1], difference_hash(pixels), pixels.tobytes() if samples else None
    except (ValueError, TypeError, IndexError, struct.error, OverflowError):
        return (None,) * 5


_TILE = [T.StructField("tile", T.BinaryType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("feature", T.StringType())]


def tiles(images: DataFrame, media: str = "media", side: int = 32, samples: bool = False) -> DataFrame:
    """Adds ``tile`` (NPY bytes of a side x side area-resized image), ``height``, ``width`` and
    ``feature`` (difference hash); with ``samples``, the pixels that were read from the stored bytes."""
    fields = [*_TILE, T.StructField("samples", T.BinaryType())] if samples else _TILE

    def make():
        def step(batch):
            found = [_read(x, side, samples) for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
            return {f.name: [x[i] for x in found] for i, f in enumerate(fields)}

        return step

    return map_rows(images, make, *fields, rows=128)


def text_tiles(docs: DataFrame, text: str = "text", form: str = "netpbm", side: int = 32) -> DataFrame:
    """Texts stored as images in a written table, and :func:`tiles` of what is read back from it."""
    return tiles(staged(text_images(docs, text, form), "images", "zstd"), side=side, samples=True)


def write_tiles(images: DataFrame, root: str, key: str = "doc_id", media: str = "media", side: int = 32, each: int = 1024) -> DataFrame:
    """Tiles as NPY files below the new folder ``root``, of up to ``each`` tiles (n x side x side x 3).

    Returns the index (key, stack, place, feature): a tile is row ``place`` of the
    file in ``root/stack=<stack>``. Images that cannot be read have a null stack.
    """
    member = T.StructType([images.schema[key], T.StructField("place", T.IntegerType()), T.StructField("feature", T.StringType())])
    schema = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("members", T.ArrayType(member))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[np.ndarray] = []
        told: list[dict] = []

        def stack():
            data = npy_bytes(np.stack(held)) if held else None
            return pa.RecordBatch.from_pylist([{"data": data, "members": told}], schema=arrow)

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                tile, _, _, feature, _ = _read(x.as_py(), side, False)
                told.append({key: k, "place": None if tile is None else len(held), "feature": feature})
                if tile is not None:
                    own = np.load(io.BytesIO(tile))
                    held.append(own if own.ndim == 3 else np.repeat(own[:, :, None], 3, axis=2))
                if len(told) >= each:
                    yield stack()
                    held, told = [], []
        if told:
            yield stack()

    stacks = images.select(key, media).mapInArrow(trimmed(run), schema)
    name = F.when(F.col("data").isNotNull(), F.concat(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"), F.lit(".npy")))
    stacks = staged(stacks.withColumn("stack", name), "stacks")
    write_files(stacks.where("stack is not null"), root, "stack", "data")
    listed = stacks.select("stack", F.explode("members").alias("m"))
    return listed.select(F.col("m")[key].alias(key), F.when(F.col("m.place").isNotNull(), F.col("stack")).alias("stack"), "m.place", "m.feature")
