"""Change events from masks: relational parts; shapes come from ``kernels``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import raster


def pairs(observations: DataFrame, key: str = "site_id") -> DataFrame:
    """Consecutive observations of a site."""
    nxt = F.lead("ts").over(W.partitionBy(key).orderBy("ts", "obs_id"))
    return observations.withColumn("t2", nxt).where("t2 is not null").select(key, F.col("ts").alias("t1"), "t2")


def earliest(observations: DataFrame, limit: float = raster.SSIM_LIMIT) -> DataFrame:
    """The last observation of the leading run unlike the latest, else the one before the last.

    Sites of fewer than three observations have the one before the last, or null.
    """
    first = observations.groupBy("site_id").agg(F.max("n").alias("m"), F.min(F.when((F.col("sim") >= limit) & (F.col("rn") < F.col("n")), F.col("rn"))).alias("similar"))
    pick = F.when((F.col("similar") == 1) | (F.col("m") < 3), F.col("m") - 1).otherwise(F.coalesce(F.col("similar") - 1, F.col("m") - 1))
    chosen = first.select(F.col("site_id").alias("s"), pick.alias("pick"))
    held = observations.select("site_id", "rn", "obs_id")
    return chosen.join(held, (F.col("site_id") == F.col("s")) & (F.col("rn") == F.col("pick")), "left").select(F.col("s").alias("site_id"), "obs_id")


def keep(shapes: DataFrame, strict: bool = False, width: int = 800, height: int = 800) -> DataFrame:
    """Shapes large enough, away from the edges and, if built up, full enough."""
    e = raster.EDGE
    inside = (F.col("x") > e) & (F.col("y") > e) & (F.col("x") + F.col("w") < width - e) & (F.col("y") + F.col("h") < height - e)
    full = (F.col("category") != "Construction") | (F.col("extent") >= (0.40 if strict else 0.25))
    return shapes.where((F.col("area") > raster.MIN_AREA * (2 if strict else 1)) & inside & full)


def classify(shapes: DataFrame) -> DataFrame:
    """Final type: cleared fields are harvest, thin built shapes are roads."""
    harvest = F.col("category").contains("Clearance") & (F.col("solidity") > 0.5) & (F.col("area") > 1000)
    road = (F.col("category") == "Construction") & F.col("is_linear") & (F.col("aspect") >= 3.0) & (F.col("compactness") <= 0.20)
    return shapes.withColumn("type", F.when(harvest, "Agricultural Harvest").when(road, "Road Development").otherwise(F.col("category")))


def confidence():
    """0.4 and up to 0.3 each for solidity and area; the billionth settles ties upwards."""
    return F.round(F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.3) * F.least("solidity", F.lit(1.0)) + F.lit(0.3) * F.least(F.col("area") / 5000, F.lit(1.0))) + F.lit(1e-9), 3)


def legend(events: DataFrame) -> DataFrame:
    """Zones and area of each type, and whether any of it is a global marker."""
    return events.groupBy("type").agg(F.count("*").alias("count"), F.sum(F.col("area").cast("long")).alias("area"), F.bool_or("is_global").alias("is_global"))
