"""Views over the driver's tables in the shapes that the operators read.

The text of a view runs on both engines; ``{name}`` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "tile_catalog": """
        SELECT vec_id AS tile_id, label, embedding,
          CASE WHEN vec_id % 7 = 6 THEN 'data_unmapped_5km' WHEN label < 5 THEN 'data_alpha_5km' ELSE 'data_beta_5km' END AS placename,
          CASE vec_id % 3 WHEN 0 THEN 'true_color' WHEN 1 THEN 'false_color_nir' ELSE 'agriculture_swir' END AS layer,
          CASE WHEN vec_id % 11 = 10 THEN NULL ELSE DATE '2024-01-05' + CAST((vec_id % 24) * 15 AS INT) END AS acq_date,
          CASE WHEN vec_id % 7 = 6 THEN NULL ELSE CAST(80.3 AS DOUBLE) + CAST(0.045 AS DOUBLE) * (vec_id % 25) END AS min_lon,
          CASE WHEN vec_id % 7 = 6 THEN NULL ELSE CAST(26.4 AS DOUBLE) + CAST(0.045 AS DOUBLE) * CAST(FLOOR(vec_id / 25) AS INT) END AS min_lat
        FROM {embeddings}""",
    "scenes": """
        SELECT o_orderkey AS item_id, o_orderdate AS acq_ts, CONCAT('place_', CAST(o_custkey % 20 AS STRING)) AS place,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / CAST(5000 AS DOUBLE) END AS cloud_cover,
          CASE WHEN o_orderkey % 3 = 0 THEN 'sentinel-1-grd' ELSE 'sentinel-2-l2a' END AS collection,
          CAST(80.3 AS DOUBLE) + CAST(0.045 AS DOUBLE) * (o_custkey % 25) AS min_lon, CAST(26.4 AS DOUBLE) + CAST(0.045 AS DOUBLE) * (o_custkey % 21) AS min_lat
        FROM {orders}""",
    "pixels": """
        SELECT tile_id, t, y, x,
          CASE WHEN blk = 1 THEN 0 WHEN cld = 1 THEN 230 ELSE r0 END AS r,
          CASE WHEN blk = 1 THEN 0 WHEN cld = 1 THEN 228 ELSE g0 END AS g,
          CASE WHEN blk = 1 THEN 0 WHEN cld = 1 THEN 226 ELSE b0 END AS b, nir
        FROM (SELECT s_suppkey AS tile_id, t.t AS t, y.y AS y, x.x AS x,
            CASE WHEN s_suppkey % 5 = 4 AND (y.y = 0 OR y.y = 31) THEN 1 ELSE 0 END AS blk,
            CASE WHEN s_suppkey % 4 = 3 AND t.t = 1 AND y.y BETWEEN 10 AND 19 THEN 1 ELSE 0 END AS cld,
            CAST((x.x*7 + y.y*13 + s_suppkey*5 + t.t*29*(CASE WHEN x.x BETWEEN 8 AND 20 AND y.y BETWEEN 6 AND 18 THEN 1 ELSE 0 END)) % 256 AS INT) AS r0,
            CAST((x.x*3 + y.y*11 + s_suppkey*17 + t.t*(x.x % 5)) % 256 AS INT) AS g0,
            CAST((x.x*19 + y.y*2 + s_suppkey*23) % 256 AS INT) AS b0,
            CAST((x.x*5 + y.y*9 + s_suppkey*31 + t.t*97*(CASE WHEN x.x > 16 THEN 1 ELSE 0 END)) % 256 AS INT) AS nir
          FROM {supplier}, range(0,2) AS t(t), range(0,32) AS y(y), range(0,32) AS x(x)) p""",
    "observations": """
        SELECT user_id AS site_id, event_id AS obs_id, ts,
          LEAST(CAST(1 AS DOUBLE), value / CAST(60 AS DOUBLE)) * CASE WHEN user_id % 10 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sim,
          CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn, COUNT(*) OVER (PARTITION BY user_id) AS n
        FROM {events}""",
    "candidates": """
        SELECT event_id AS seq, CONCAT('c', CAST(event_id + 1 AS STRING)) AS id, event_type AS label, FLOOR(value) / CAST(500 AS DOUBLE) AS confidence,
          CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status
        FROM {events}""",
    "files": """
        SELECT path, regexp_replace(path, '^.*/', '') AS filename FROM (
          SELECT CONCAT('tiles/', CASE c_custkey % 4 WHEN 0 THEN 'Alpha 5km' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END, '/',
            CASE c_custkey % 5 WHEN 0 THEN 'true_color' WHEN 1 THEN 'false_color_nir' WHEN 2 THEN 'agriculture_swir' WHEN 3 THEN 'rgb' ELSE 'other' END, '/',
            CASE WHEN c_custkey % 17 = 0 THEN 'undated' WHEN c_custkey % 19 = 0 THEN '2024-13-45' ELSE CONCAT('2024-0', CAST(1 + c_nationkey % 9 AS STRING), '-1', CAST(c_custkey % 10 AS STRING)) END,
            '_tile', CAST(c_custkey % 50 AS STRING), CASE c_custkey % 3 WHEN 0 THEN '_TRUE_COLOR' WHEN 1 THEN '_nir' ELSE '_swir' END,
            CASE c_custkey % 7 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.tif' WHEN 3 THEN '.bmp' WHEN 4 THEN '.txt' ELSE '.jpg' END) AS path
          FROM {customer}) f""",
    "shapes": """
        SELECT p_partkey AS event_id, CASE p_partkey % 4 WHEN 0 THEN 'Land Clearance' WHEN 1 THEN 'Construction' WHEN 2 THEN 'Flooding' ELSE 'Afforestation / Crop Growth' END AS category,
          CAST(p_size AS DOUBLE) * 45 AS area, CAST(p_partkey % 100 AS DOUBLE) / 100 AS solidity, CAST(p_partkey % 7 AS DOUBLE) AS aspect,
          CAST(p_partkey % 40 AS DOUBLE) / 100 AS compactness, CAST(p_partkey % 90 AS DOUBLE) / 100 AS extent, p_partkey % 2 = 0 AS is_linear, p_partkey % 11 = 0 AS is_global,
          CAST(p_partkey % 750 AS INT) AS x, CAST(p_partkey % 611 AS INT) AS y, CAST(10 + p_size AS INT) AS w, CAST(12 + p_partkey % 30 AS INT) AS h
        FROM {part}""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str, rows: int | None = None) -> DataFrame:
    """The view as a DataFrame; only the columns that are asked for are read.

    ``rows`` deals the base tables out first, some so many rows a task, for views that make thousands of rows of one.
    """
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)}
    if rows:
        frames = {t: f.repartition(f.count() // rows + 1) for t, f in frames.items()}
    if name == "files":  # a row's literals would need other quoting in each engine
        sql = sql.replace("'^.*/'", "r'^.*/'")
    return spark.sql(sql, **frames)


def oracle(sql: str, *names: str) -> str:
    """SQL for the second engine with views in front."""
    parts = ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n])})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {parts}, {body[5:]}" if parts else body
    return f"WITH {parts} {body}" if parts else body
