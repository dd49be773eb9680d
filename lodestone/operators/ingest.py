"""Choosing scenes to fetch: by cloud, month, date and what is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo


def cloud(c: str = "cloud_cover") -> Column:
    """Cloud cover with an unknown one as complete."""
    return F.coalesce(c, F.lit(100.0))


def catalog(scenes: DataFrame, first: str, last: str, most: float = 10.0, area=None, collection: str | None = None) -> DataFrame:
    """Scenes of a collection whose box meets an area, in a range of time, below a cloud cover."""
    box = (F.col("min_lon"), F.col("min_lat"), F.col("min_lon") + F.lit(0.045), F.col("min_lat") + F.lit(0.045))
    if collection:
        scenes = scenes.where(F.col("collection") == collection)
    if area:
        scenes = scenes.where(geo.intersects(box, area))
    return scenes.where((F.col("acq_ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("acq_ts") <= F.lit(last).cast("timestamp_ntz")) & (cloud() < most))


def best_of_month(scenes: DataFrame) -> DataFrame:
    """The clearest scene of each place and month, the first of equals."""
    clear = scenes.withColumns({"cloud_cover": cloud(), "month": F.date_format("acq_ts", "yyyy-MM")}).where("cloud_cover < 10")
    rn = F.row_number().over(W.partitionBy("place", "month").orderBy("cloud_cover", "item_id"))
    return clear.withColumn("rn", rn).where("rn = 1").drop("rn")


def nearest_first(scenes: DataFrame, target: str) -> DataFrame:
    """Each place's scene nearest to a moment."""
    away = F.abs(F.timestamp_diff("SECOND", F.col("acq_ts"), F.lit(target).cast("timestamp_ntz")))
    rn = F.row_number().over(W.partitionBy("place").orderBy("away", "item_id"))
    return scenes.withColumn("away", away).withColumn("rn", rn).where("rn = 1").drop("rn")


def evenly(scenes: DataFrame, k: int) -> DataFrame:
    """k scenes of each place spread over its time line, both ends among them."""
    place = W.partitionBy("place")
    told = scenes.withColumns({"i": F.row_number().over(place.orderBy("acq_ts", "item_id")) - 1, "n": F.count("*").over(place)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("n") - 1) / F.lit(max(k - 1, 1)), 0).cast("long"))
    return told.where((F.col("n") <= k) | F.array_contains(picks, F.col("i").cast("long"))).drop("i", "n")


def remaining(available: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    out = available
    for d in done:
        out = out.join(d.select(key), key, "left_anti")
    return out


def place_name(*parts: str) -> Column:
    """The most local name known, else "location"."""
    return F.coalesce(*(F.nullif(F.col(p), F.lit("")) for p in parts), F.lit("location"))
