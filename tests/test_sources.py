"""Images, GeoTIFF headers, GeoJSON, the streaming index, entry points."""

import hashlib
import json
import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import geo
from lodestone.operators import review
from lodestone.sources import images, sinks
from lodestone.streaming import index


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_chips(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    folder = tmp_path / "place" / "true_color"
    os.makedirs(folder)
    (folder / "2024-01-05_a.png").write_bytes(png(px))
    (folder / "broken.png").write_bytes(b"no image")
    chips = images.chips(spark, str(tmp_path))
    rows = images.to_pixels(chips, "filename").collect()
    assert {r["filename"] for r in rows} == {"2024-01-05_a.png"}
    assert all((r["r"], r["g"], r["b"]) == tuple(px[r["y"], r["x"]].tolist()) for r in rows) and len(rows) == 30
    assert images.files(spark, str(tmp_path)).count() == 2


def test_tiff_bounds(spark, tmp_path):
    scale, tie = struct.pack("<3d", 0.001, 0.002, 0), struct.pack("<6d", 0, 0, 0, 80.3, 26.5, 0)
    tags = [(256, 4, 1, 50), (257, 4, 1, 25), (33550, 12, 3, 200), (33922, 12, 6, 224)]
    head = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
    found = images.tiff_bounds(head.ljust(200, b"\0") + scale + tie)
    assert np.allclose(found, (80.3, 26.45, 80.35, 26.5))
    assert images.tiff_bounds(b"nothing") is None
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.tif").write_bytes(head.ljust(200, b"\0") + scale + tie)
    (tmp_path / "b.tiff").write_bytes(b"nothing")
    told = {r["filename"]: [r[c] for c in images.BOUNDS] for r in images.bounds(spark, str(tmp_path)).collect()}
    assert np.allclose(told["a.tif"], (80.3, 26.45, 80.35, 26.5)) and told["b.tiff"] == [None] * 4


def test_geojson(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 80.3), (2, None)], "id int, lon double")
    ring = geo.ring((F.col("lon"), F.lit(26.4), F.col("lon") + 0.1, F.lit(26.5)))
    told = boxes.select("id", sinks.feature(ring, id=F.col("id")).alias("feature"))
    body = json.loads(sinks.collection(told, order="id").first()[0])
    assert [f["properties"]["id"] for f in body["features"]] == [1, 2]
    coords = body["features"][0]["geometry"]["coordinates"][0]
    assert len(coords) == 5 and coords[0] == coords[-1]
    assert body["features"][1]["geometry"] is None
    sinks.write_features(told, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_index_follows_a_folder(spark, tmp_path):
    source, held = str(tmp_path / "in"), str(tmp_path / "index")
    rows = lambda *ids: spark.createDataFrame([(f"p{i}", i) for i in ids], "path string, v long")
    rows(1, 2, 2).write.parquet(source)
    schema = rows(1).schema
    run = lambda: index.follow(spark, source, schema, held, str(tmp_path / "check")).awaitTermination(60)
    run()
    rows(2, 3).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r["path"] for r in index.read_index(spark, f"{held}/batch=*", schema).collect()) == ["p1", "p2", "p3"]


def test_review_takes_the_latest_decision(spark):
    c = spark.createDataFrame([("c1", "x"), ("c2", "y")], "id string, label string")
    d = spark.createDataFrame([("c1", 1, "confirmed"), ("c1", 2, "rejected"), ("c9", 3, "confirmed")], "id string, at int, decision string")
    assert {r["id"]: r["status"] for r in review.state(c, d).collect()} == {"c1": "rejected", "c2": "pending"}


def test_audit_is_appended_and_resumed(spark, tmp_path):
    path = str(tmp_path / "audit")
    for at, decision in ((1, "confirmed"), (2, "rejected")):
        sinks.append_audit(spark.createDataFrame([("c1", at, decision)], "id string, at int, decision string"), path)
    held = sinks.read_audit(spark, path)
    assert [(r["at"], r["decision"]) for r in held.orderBy("at").collect()] == [(1, "confirmed"), (2, "rejected")]
    c = spark.createDataFrame([("c1", "x"), ("c2", "y")], "id string, label string")
    assert {r["id"]: r["status"] for r in review.state(c, held).collect()} == {"c1": "rejected", "c2": "pending"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_change_queries_find_shapes(spark):
    found = {n: entry.queries()[n](spark, "/root/testdata/sf0.001").collect() for n in ("change_events", "change_events_strict", "change_timeline", "search_geojson")}
    assert all(found.values())
    assert all(json.loads(r["feature"])["type"] == "Feature" for n in ("change_timeline", "search_geojson") for r in found[n])


def test_digests_of_files(spark, tmp_path):
    (tmp_path / "weights").mkdir()
    (tmp_path / "weights" / "a.pt").write_bytes(b"abc")
    (tmp_path / "weights" / "empty.pt").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in images.digests(spark, str(tmp_path), "*.pt").collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.pt", b"abc"),)}  # no row for an empty file


def test_collection_has_its_name(spark):
    told = spark.createDataFrame([('{"type":"Feature"}',)], "feature string")
    assert json.loads(sinks.collection(told, name='Discovered "x"').first()["geojson"])["name"] == 'Discovered "x"'
