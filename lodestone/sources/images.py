"""Chips from image folders, through Spark's own readers only."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chips(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images below a folder as (path, filename, height, width, channels, data); bytes are BGR rows."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    i = F.col("image")
    return read.select(i.origin.alias("path"), F.regexp_extract(i.origin, r"([^/]+)$", 1).alias("filename"), i.height.alias("height"), i.width.alias("width"), i.nChannels.alias("channels"), i.data.alias("data"))


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, filename) of every file; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return read.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"))


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file below a folder; Spark's reader gives no row for an empty one."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return read.select("path", "length", F.sha2("content", 256).alias("sha256"))


def to_pixels(images: DataFrame, *keep: str) -> DataFrame:
    """Pixel layout of decoded chips: (keep, y, x, r, g, b). For tests and aggregates."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                px = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, -1).astype(np.int32)
                px = np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px
                y, x = np.indices(px.shape[:2])
                yield pd.DataFrame({**{k: getattr(row, k) for k in keep}, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "r": px[:, :, 2].ravel(), "g": px[:, :, 1].ravel(), "b": px[:, :, 0].ravel()})

    schema = T.StructType([images.schema[k] for k in keep] + [T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b")])
    return images.select(*keep, "height", "width", "data").mapInPandas(run, schema)


def tiff_bounds(data: bytes) -> tuple[float, float, float, float] | None:
    """Bounds of a GeoTIFF in degrees from its scale and tie point, else null."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        (at,) = struct.unpack_from(order + "I", data, 4)
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(count):
            tag, kind, n, place = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            if kind == 12:
                tags[tag] = struct.unpack_from(f"{order}{n}d", data, place)
            elif kind in (3, 4):
                inline = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)
                tags[tag] = inline if n == 1 else struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", data, place)
        width, height, scale, tie = tags[256][0], tags[257][0], tags[33550], tags[33922]
        keys = tags.get(34735, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
        if codes.get(2048, 4326) != 4326 or 3072 in codes:
            return None
        west, north = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        return west, north - height * scale[1], west + width * scale[0], north
    except (KeyError, IndexError, struct.error):
        return None


BOUNDS = ("min_lon", "min_lat", "max_lon", "max_lat")


def bounds(spark: SparkSession, root: str, pattern: str = "*.tif*") -> DataFrame:
    """(path, filename, min_lon, min_lat, max_lon, max_lat) of GeoTIFFs below a folder; null where a file tells none."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "filename")] + [T.StructField(c, T.DoubleType()) for c in BOUNDS])
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [tiff_bounds(x.as_py()) or (None,) * 4 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], pa.float64()) for i in range(4))], names=schema.names)

    return read.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content").mapInArrow(run, schema)
