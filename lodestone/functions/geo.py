"""Boxes, rings and grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def intersects(box: tuple[Column, Column, Column, Column], area: tuple[float, float, float, float] | None) -> Column:
    """Boxes (min_lon, min_lat, max_lon, max_lat) that touch; unknown boxes pass."""
    if area is None:
        return F.lit(True)
    apart = (box[2] < area[0]) | (box[0] > area[2]) | (box[3] < area[1]) | (box[1] > area[3])
    return F.coalesce(~apart, F.lit(True))


def in_dates(day: Column, first: str | None, last: str | None) -> Column:
    """Between both days, ends included; a null day passes, a null end is open."""
    ok = F.lit(True)
    if first:
        ok = ok & (day >= F.lit(first).cast("date"))
    if last:
        ok = ok & (day <= F.lit(last).cast("date"))
    return F.coalesce(ok, F.lit(True))


def pixel_to_lonlat(x: Column, y: Column, width: Column, height: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Affine place of a pixel, rows running south."""
    lon = box[0] + x / width * (box[2] - box[0])
    lat = box[3] - y / height * (box[3] - box[1])
    return F.round(lon, 6), F.round(lat, 6)


def box_around(lon: Column, lat: Column, km: float) -> tuple[Column, Column, Column, Column]:
    """A box of ``km`` on each side around a centre, 111 km a degree."""
    up = F.lit(km / 2 / 111)
    side = F.lit(km / 2) / (F.lit(111.0) * F.cos(F.radians(lat)))
    return lon - side, lat - up, lon + side, lat + up


def ring(box: tuple[Column, Column, Column, Column]) -> Column:
    """Closed ring of five points, or null for an unknown box."""
    a, b, c, d = box
    points = F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))))
    return F.when(a.isNotNull(), points)


def closed(points: Column) -> Column:
    """The ring closed at its first point; null for fewer than three points."""
    shut = F.when(F.element_at(points, -1) == F.element_at(points, 1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.when(F.size(points) >= 3, shut)


def grid(spark: SparkSession, area: tuple[float, float, float, float], step: float = 0.045) -> DataFrame:
    """Cells of a grid over an area by row and column, the last ones clipped."""
    across, up = (max(1, int(-(-(area[i + 2] - area[i] - 1e-9) // step))) for i in (0, 1))
    cells = spark.range(across * up).select((F.col("id") / across).cast("long").alias("row"), (F.col("id") % across).alias("col"))
    corner = lambda at, low: F.lit(low) + F.col(at) * F.lit(step)
    end = lambda at, low, most: F.least(F.lit(low) + (F.col(at) + 1) * F.lit(step), F.lit(most))
    return cells.select(
        "row", "col",
        F.round(corner("col", area[0]), 6).alias("min_lon"), F.round(corner("row", area[1]), 6).alias("min_lat"),
        F.round(end("col", area[0], area[2]), 6).alias("max_lon"), F.round(end("row", area[1], area[3]), 6).alias("max_lat"),
    )
