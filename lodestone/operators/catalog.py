"""Tiles from paths: layers, dates, bands, bounds, caches and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text

# Endings of image files and the words that name a layer's folder.
ENDINGS = (".png", ".jpg", ".jpeg", ".tif")
MORE_ENDINGS = (*ENDINGS, ".tiff", ".bmp")
LAYER_WORDS = {
    "True_Color": ("true_color", "true-color", "rgb", "truecolor"),
    "False_Color": ("false_color", "false-color", "nir", "falsecolor"),
    "Agriculture_SWIR": ("swir", "agriculture", "agriculture_swir"),
}


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for e in endings:
        hit = hit | low.endswith(e)
    return hit


def _folder(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"/[^/]*$", ""))


def _place(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^[^/]+/([^/]+)/", 1), F.lit("")), F.lit("Unknown_Location"))


def records(files: DataFrame, layer: str) -> DataFrame:
    """Image files below a folder of the layer, with place and date."""
    hit = F.locate(layer, _folder(F.col("path"))) > 0
    return files.where(_ends(F.col("filename"), ENDINGS) & hit).select("path", "filename", _place(F.col("path")).alias("placename"), text.date_in_name(F.col("filename")).alias("acq_date"), F.lit(layer).alias("layer_source"))


def records_or_all(files: DataFrame, layer: str) -> DataFrame:
    """By the wider words of a layer; every image, as Fallback, if none has them."""
    images = files.where(_ends(F.col("filename"), MORE_ENDINGS))
    hit = F.lit(False)
    for word in LAYER_WORDS.get(layer, ("true_color",)):
        hit = hit | _folder(F.col("path")).contains(word)
    told = images.withColumn("hit", hit)
    some = told.agg(F.coalesce(F.max("hit"), F.lit(False)).alias("some"))
    kept = told.crossJoin(F.broadcast(some)).where("hit or not some")  # the other side is one row
    return kept.select("path", "filename", _place(F.col("path")).alias("placename"), F.when(F.col("some"), layer).otherwise("Fallback").alias("layer_source"))


def bands(files: DataFrame) -> DataFrame:
    """One row a place and tile name: its bands and the path that stands for it."""
    told = files.where(_ends(F.col("filename"), MORE_ENDINGS)).select(_place(F.col("path")).alias("placename"), text.without_band(F.col("filename")).alias("base_name"), text.layer_of(F.col("path")).alias("layer"), "path")
    one = told.groupBy("placename", "base_name", "layer").agg(F.max("path").alias("path"))
    held = one.groupBy("placename", "base_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "path")))).alias("bands"))
    return held.withColumn("primary_path", F.coalesce(F.element_at("bands", F.lit("true_color")), F.element_at(F.map_values("bands"), 1)))


def first_of_layer(files: DataFrame) -> DataFrame:
    """The first file by path of each date and layer."""
    dated = files.where(_ends(F.col("filename"), ENDINGS)).select("path", text.layer_of(F.col("path")).alias("layer"), text.date_in_name(F.col("filename")).alias("acq_date")).where("acq_date is not null")
    return dated.groupBy("acq_date", "layer").agg(F.min("path").alias("path"))


def with_bounds(tiles: DataFrame, bounds: DataFrame, on: str = "placename") -> DataFrame:
    """A file's own bounds, else its data set's, else null. ``bounds``: a row a data set.

    No hint: Spark broadcasts the bounds while they are below its threshold.
    """
    told = bounds.withColumnsRenamed({c: f"d_{c}" for c in bounds.columns if c != on})
    joined = tiles.join(told, on, "left")
    return joined.select(*[c for c in tiles.columns if c not in ("min_lon", "min_lat")], *(F.coalesce(c, f"d_{c}").alias(c) for c in ("min_lon", "min_lat")))


def missing(current: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What the cache lacks: the only rows to encode."""
    return current.join(cached.select(key), key, "left_anti")


def kept(cached: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The cache without rows whose file is gone."""
    return cached.join(current.select(key), key, "left_semi")


def add_to_index(index: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The index with new paths once each; known ones are left as they are."""
    return index.unionByName(missing(batch, index, key).dropDuplicates([key]))


def seed(tiles: DataFrame, name: str, *columns: str, order: str = "path") -> DataFrame:
    """The first row that any of the columns names."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.col(c) == name)
    return tiles.where(hit).orderBy(order).limit(1)


def latest_first(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("rn", rn).where("rn = 1").drop("rn")
