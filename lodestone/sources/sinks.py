"""GeoJSON and index sinks, written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature; ``geometry`` is a closed ring of (lon, lat) or null."""
    ring = F.transform(geometry, lambda p: F.array(p["lon"], p["lat"]))
    shape = F.when(geometry.isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties")), {"ignoreNullFields": "false"})


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line: a file of any size stays splittable."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def collection(features: DataFrame, column: str = "feature", order: str | None = None, name: str | None = None) -> DataFrame:
    """A FeatureCollection of a page of features as one row, with a name if there is one."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order or column).alias("o"), F.col(column).alias("f"))))
    body = F.array_join(F.transform(held, lambda e: e["f"]), ",")
    called = f'"name":{json.dumps(name)},' if name is not None else ""
    head = F.lit('{"type":"FeatureCollection",' + called + '"crs":{"type":"name","properties":{"name":"' + CRS84 + '"}},"features":[')
    return features.agg(F.concat(head, body, F.lit("]}")).alias("geojson"))


AUDIT = T.StructType([T.StructField("id", T.StringType()), T.StructField("at", T.LongType()), T.StructField("decision", T.StringType()), T.StructField("note", T.StringType())])


def append_audit(decisions: DataFrame, path: str) -> None:
    """Decisions as lines of JSON; what is there stays, so the log is the history."""
    decisions.select(*(F.col(f.name).cast(f.dataType) if f.name in decisions.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in AUDIT)).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All decisions ever appended; feed them to ``review.state``."""
    return spark.read.schema(AUDIT).json(path)
