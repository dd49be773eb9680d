"""The same results in SQL for the second engine, written on their own."""

from __future__ import annotations

import re

from ..functions import text
from ..sources.views import oracle
from .queries import ASKED, NAMES

AOI = "(min_lon IS NULL OR NOT (min_lon + 0.045::DOUBLE < 80.5 OR min_lon > 80.9 OR min_lat + 0.045::DOUBLE < 26.5 OR min_lat > 26.9))"
DOT = "list_inner_product({a}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {id}))"
GREY = "round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
VALUE = "greatest(r, g, b)"
SAT = f"CASE WHEN {VALUE} = 0 THEN 0::DOUBLE ELSE round(({VALUE} - least(r, g, b)) * 255::DOUBLE / {VALUE}) END"
IMAGE = "regexp_matches(lower(filename), '\\.(png|jpg|jpeg|tif)$')"
IMAGE_MORE = "regexp_matches(lower(filename), '\\.(png|jpg|jpeg|tif|tiff|bmp)$')"
FOLDER = "lower(regexp_replace(path, '/[^/]*$', ''))"
PLACE = "split_part(path, '/', 2)"
DAY = "try_cast(nullif(regexp_extract(filename, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE)"
LAYER = f"CASE WHEN {FOLDER} LIKE '%nir%' OR {FOLDER} LIKE '%false_color%' THEN 'false_color_nir' WHEN {FOLDER} LIKE '%swir%' OR {FOLDER} LIKE '%agriculture%' THEN 'agriculture_swir' ELSE 'true_color' END"
CHIP = "tile_id, t, y, x"


def dot(i: int, column: str = "embedding") -> str:
    return DOT.format(a=column, id=i)


def quoted(words: tuple[str, ...]) -> str:
    rows = ", ".join("({}, '{}')".format(i, w.replace("'", "''")) for i, w in enumerate(words))
    return f"(VALUES {rows}) AS w(i, q)"


def slide(source: str, column: str, size: int, f: str, last: str = "") -> str:
    """A sliding minimum or maximum over a square, as nested queries."""
    h = size // 2
    keep = f"{CHIP}{last}"
    one = f"SELECT {keep}, {f}({column}) OVER (PARTITION BY tile_id, t, y ORDER BY x ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS {column} FROM ({source})"
    return f"SELECT {keep}, {f}({column}) OVER (PARTITION BY tile_id, t, x ORDER BY y ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS {column} FROM ({one})"


def opened(source: str, column: str, size: int, last: str = "") -> str:
    return slide(slide(source, column, size, "min", last), column, size, "max", last)


def closed(source: str, column: str, size: int, last: str = "") -> str:
    return slide(slide(source, column, size, "max", last), column, size, "min", last)


def flag(condition: str, column: str = "m", source: str = "pixels") -> str:
    return f"SELECT {CHIP}, CASE WHEN {condition} THEN 1 ELSE 0 END AS {column} FROM {source}"


NODATA = slide(flag(f"{GREY} <= 5", "nodata"), "nodata", 9, "max")
CLOUD = slide(opened(flag(f"{VALUE} > 160 AND {SAT} <= 50", "cloud"), "cloud", 7), "cloud", 35, "max")
SHADOW = slide(opened(flag(f"{VALUE} <= 35", "shadow"), "shadow", 5), "shadow", 15, "max")
GATES = f"""SELECT tile_id, t, 100 * avg(CASE WHEN {VALUE} > 180 AND {SAT} < 45 THEN 1::DOUBLE ELSE 0 END) AS cloud,
  100 * sum(CASE WHEN {GREY} < 15 THEN w ELSE 0 END)::DOUBLE / sum(w) AS border
  FROM (SELECT *, (y < 1)::INT + (y >= 31)::INT + (x < 1)::INT + (x >= 31)::INT AS w FROM pixels) GROUP BY tile_id, t"""
SHARP = f"""SELECT tile_id, t, var_pop(lap) AS sharpness FROM (
  SELECT tile_id, t, coalesce(lag(p) OVER hx, lead(p) OVER hx) + coalesce(lead(p) OVER hx, lag(p) OVER hx) + coalesce(lag(p) OVER hy, lead(p) OVER hy) + coalesce(lead(p) OVER hy, lag(p) OVER hy) - 4 * p AS lap
  FROM (SELECT tile_id, t, y, x, {GREY} AS p FROM pixels)
  WINDOW hx AS (PARTITION BY tile_id, t, y ORDER BY x), hy AS (PARTITION BY tile_id, t, x ORDER BY y)) GROUP BY tile_id, t"""
NDVI = "CASE WHEN nir + r = 0 THEN 0::DOUBLE ELSE (nir - r)::DOUBLE / (nir + r) END"
NDWI = "CASE WHEN g + nir = 0 THEN 0::DOUBLE ELSE (g - nir)::DOUBLE / (g + nir) END"
BOTH = "(SELECT * FROM pixels WHERE t = 0) d1 JOIN (SELECT * FROM pixels WHERE t = 1) d2 USING (tile_id, y, x)"


def of(expr: str, alias: str) -> str:
    """The expression on one side of a join of the two dates."""
    out = expr
    for c in ("nir", "r", "g", "b"):
        out = re.sub(rf"(?<![\w.']){c}(?![\w(])", f"{alias}.{c}", out)
    return out




def cdf(channel: str, source: str = "pixels") -> str:
    return f"SELECT tile_id, t, v, sum(c) OVER (PARTITION BY tile_id, t ORDER BY v)::DOUBLE / sum(c) OVER (PARTITION BY tile_id, t) AS cdf FROM (SELECT tile_id, t, {channel} AS v, count(*) AS c FROM {source} GROUP BY ALL)"


def otsu(hist: str, keys: str = "tile_id") -> str:
    return f"""SELECT {keys}, v AS threshold FROM (
      SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY (s0*n - s*w0)*(s0*n - s*w0)/(w0*(n - w0)) DESC, v) AS rn FROM (
        SELECT {keys}, v, sum(c) OVER w AS w0, sum(c*v) OVER w AS s0, sum(c) OVER (PARTITION BY {keys}) AS n, sum(c*v) OVER (PARTITION BY {keys}) AS s FROM ({hist})
        WINDOW w AS (PARTITION BY {keys} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE w0 < n) WHERE rn = 1"""


SUMS = {"sa": "p", "sb": "q", "saa": "p*p", "sbb": "q*q", "sab": "p*q", "n": "1::DOUBLE"}
SSIM = f"""SELECT tile_id, y, x, ((2*ma*mb + 6.5025) * (2*cov + 58.5225)) / ((ma*ma + mb*mb + 6.5025) * (va + vb + 58.5225)) AS ssim FROM (
  SELECT tile_id, y, x, ma, mb, f*(saa/n - ma*ma) AS va, f*(sbb/n - mb*mb) AS vb, f*(sab/n - ma*mb) AS cov FROM (
    SELECT *, sa/n AS ma, sb/n AS mb, n/(n - 1) AS f FROM (
      SELECT tile_id, y, x, {", ".join(f"sum({k}) OVER (PARTITION BY tile_id, x ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS {k}" for k in SUMS)} FROM (
        SELECT tile_id, y, x, {", ".join(f"sum({e}) OVER (PARTITION BY tile_id, y ORDER BY x ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS {k}" for k, e in SUMS.items())}
        FROM (SELECT tile_id, y, x, {of(GREY, "d1")} AS p, {of(GREY, "d2")} AS q FROM {BOTH})))))"""
STRUCT = closed(opened(f"SELECT tile_id, 0 AS t, y, x, CASE WHEN floor(greatest(ssim, 0::DOUBLE) * 255) < 141 THEN 1 ELSE 0 END AS m FROM ({SSIM})", "m", 3), "m", 5)
VEG = f"""SELECT tile_id, y, x, m = 1 AND v1 > 0.25 AND v1 - v2 > 0.12 AS loss, m = 1 AND v2 > 0.25 AND v2 - v1 > 0.12 AS growth
  FROM (SELECT tile_id, y, x, {of(NDVI, 'd1')} AS v1, {of(NDVI, 'd2')} AS v2 FROM {BOTH}) JOIN ({STRUCT}) USING (tile_id, y, x)"""


def smoothed(source: str, column: str, colour: int, keep: str) -> str:
    """The bilateral mean of a disc of 13 pixels, read at mirrored places."""
    last = {"y": "max(y) OVER (PARTITION BY tile_id, t)", "x": "max(x) OVER (PARTITION BY tile_id, t)"}
    held = f"SELECT *, {last['y']} AS hy, {last['x']} AS hx FROM ({source})"
    mirror = lambda c, d, h: f"CASE WHEN {c} + {d} < 0 THEN -({c} + {d}) WHEN {c} + {d} > {h} THEN 2 * {h} - {c} - {d} ELSE {c} + {d} END"
    disc = ", ".join(f"({dy}, {dx})" for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4)
    asked = f"SELECT s.*, {mirror('y', 'dy', 'hy')} AS qy, {mirror('x', 'dx', 'hx')} AS qx, dy * dy + dx * dx AS far FROM ({held}) s, (VALUES {disc}) AS d(dy, dx)"
    near = f"SELECT a.tile_id, a.t, a.y, a.x, n.{column}::DOUBLE AS near, exp(-((n.{column} - a.{column}) * (n.{column} - a.{column}))::DOUBLE / {2 * colour * colour} - far / {2 * colour * colour}::DOUBLE) AS k FROM ({asked}) a JOIN ({source}) n ON n.tile_id = a.tile_id AND n.t = a.t AND n.y = a.qy AND n.x = a.qx"
    return f"SELECT {keep}, round_even(sum(k * near) / sum(k), 0)::INT AS {column} FROM ({near}) GROUP BY {keep}"


_gain = f"SELECT tile_id, 0 AS t, y, x, greatest({of(GREY, 'd2')} - {of(GREY, 'd1')}, 0)::INT AS gain FROM {BOTH}"
GAIN = f"SELECT tile_id, y, x, CASE WHEN gain > 25 THEN gain ELSE 0 END AS gain FROM ({smoothed(_gain, 'gain', 50, CHIP)})"
DARK = slide("SELECT tile_id, t, y, x, r, g, b, least(r, g, b) AS dark FROM pixels", "dark", 15, "min", ", r, g, b")
LIGHT = f"""SELECT tile_id, t, avg(r / 255::DOUBLE) AS a_r, avg(g / 255::DOUBLE) AS a_g, avg(b / 255::DOUBLE) AS a_b FROM (
  SELECT *, row_number() OVER (PARTITION BY tile_id, t ORDER BY dark DESC, y, x) AS rn, count(*) OVER (PARTITION BY tile_id, t) AS n FROM ({DARK})) WHERE rn <= greatest(n // 1000, 1) GROUP BY tile_id, t"""
_thin = slide(f"SELECT tile_id, t, y, x, r, g, b, a_r, a_g, a_b, least(r / 255::DOUBLE / (a_r + 0.000001::DOUBLE), g / 255::DOUBLE / (a_g + 0.000001::DOUBLE), b / 255::DOUBLE / (a_b + 0.000001::DOUBLE)) AS dark FROM pixels JOIN ({LIGHT}) USING (tile_id, t)", "dark", 15, "min", ", r, g, b, a_r, a_g, a_b")
HAZE = f"SELECT {CHIP}, " + ", ".join(f"floor(least(greatest(({c} / 255::DOUBLE - a_{c}) / greatest(1::DOUBLE - 0.82::DOUBLE * dark, 0.1::DOUBLE) + a_{c}, 0::DOUBLE), 1::DOUBLE) * 255)::INT AS {c}" for c in "rgb") + f" FROM ({_thin})"


def enhanced(source: str) -> str:
    luma = "floor((r * 299 + g * 587 + b * 114) / 1000.0::DOUBLE)"
    clip = "floor(least(greatest({}, 0::DOUBLE), 255::DOUBLE))::INT"
    one = f"SELECT {CHIP}, " + ", ".join(clip.format(f"l + 1.15::DOUBLE * ({c} - l)") + f" AS {c}" for c in "rgb") + f" FROM (SELECT *, {luma} AS l FROM ({source}))"
    return f"SELECT {CHIP}, " + ", ".join(clip.format(f"m + 1.10::DOUBLE * ({c} - m)") + f" AS {c}" for c in "rgb") + f" FROM (SELECT *, floor(avg({luma}) OVER (PARTITION BY tile_id, t) + 0.5::DOUBLE) AS m FROM ({one}))"


def routed(rules, default) -> str:
    hits = ["regexp_matches(lower(q), '\\b({})\\b')".format("|".join(r.words)) for r in rules]
    names = sorted({x for r in (*rules, default) for x in r.layers})
    none = "NOT (" + " OR ".join(hits) + ")"
    layer = [f"CASE WHEN {' OR '.join([h for h, r in zip(hits, rules) if n in r.layers] + ([none] if n in default.layers else []))} THEN '{n}' END" for n in names]
    hint = [f"CASE WHEN {h} THEN '{r.hint}' END" for h, r in zip(hits, rules)] + [f"CASE WHEN {none} THEN '{default.hint}' END"]
    return f"SELECT CAST(i AS BIGINT) AS i, q, concat_ws(',', {', '.join(layer)}) AS layers, concat_ws(', ', {', '.join(hint)}) AS hints FROM {quoted(ASKED)}"


def matched(source: str, goal: str) -> str:
    """Values of a table of shares with the goal's values at their quantiles."""
    return f"""WITH s AS ({source}), m AS ({goal}),
      j AS (SELECT s.tile_id, s.t, s.v, s.cdf AS q, max(CASE WHEN m.cdf <= s.cdf THEN m.cdf END) AS lo, min(CASE WHEN m.cdf >= s.cdf THEN m.cdf END) AS hi, max(CASE WHEN m.cdf <= s.cdf THEN m.v END) AS vlo, min(CASE WHEN m.cdf >= s.cdf THEN m.v END) AS vhi FROM s JOIN m ON s.tile_id = m.tile_id GROUP BY ALL)
      SELECT tile_id, t, v, CAST(floor((CASE WHEN lo IS NULL THEN vhi::DOUBLE WHEN hi IS NULL OR hi = lo THEN vlo::DOUBLE ELSE vlo + (q - lo) * (vhi - vlo) / (hi - lo) END) + 0.000000001::DOUBLE) AS INT) AS matched FROM j"""


def standardised() -> str:
    clear = enhanced(HAZE)
    parts = {c: matched(cdf(c, f"({clear})"), cdf(c, "(SELECT * FROM pixels WHERE t = 0)")) for c in "rgb"}
    level = f"SELECT e.tile_id, e.t, e.y, e.x, " + ", ".join(f"m{c}.matched AS {c}" for c in "rgb") + f" FROM ({clear}) e " + " ".join(f"JOIN ({q}) m{c} ON m{c}.tile_id = e.tile_id AND m{c}.t = e.t AND m{c}.v = e.{c}" for c, q in parts.items())
    soft = {c: smoothed("SELECT * FROM level", c, 30, CHIP) for c in "rgb"}
    return f"WITH level AS MATERIALIZED ({level}) SELECT {CHIP}, r, g, b FROM ({soft['r']}) JOIN ({soft['g']}) USING ({CHIP}) JOIN ({soft['b']}) USING ({CHIP})"


SHARES = f"""SELECT *, exp(l1 - m) / z AS cloud_conf, exp(l2 - m) / z AS shadow_conf FROM (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS z FROM (
  SELECT *, greatest(l0, l1, l2) AS m FROM (SELECT *, 10 * {dot(1)} AS l0, 10 * {dot(2)} AS l1, 10 * {dot(3)} AS l2 FROM tile_catalog)))"""
PATH = "placename || '/' || layer || '/tile_' || lpad(CAST(tile_id AS VARCHAR), 5, '0')"
FUSED = """SELECT base, i, x / sqrt(sum(x * x) OVER (PARTITION BY base)) AS x FROM (
  SELECT vec_id // 3 AS base, i - 1 AS i, avg(e[i]::DOUBLE / sqrt(list_inner_product(e, e))) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY ALL)"""
ASSIGN = "SELECT tile_id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS cluster FROM (SELECT tile_id, [" + ", ".join(dot(i) for i in range(8)) + "] AS s FROM tile_catalog)"
KEEP = "x > 15 AND y > 15 AND x + w < 785 AND y + h < 785"
TYPE = "CASE WHEN category LIKE '%Clearance%' AND solidity > 0.5 AND area > 1000 THEN 'Agricultural Harvest' WHEN category = 'Construction' AND is_linear AND aspect >= 3 AND compactness <= 0.2 THEN 'Road Development' ELSE category END"
CONFIDENCE = "round(least(1::DOUBLE, 0.4::DOUBLE + 0.3::DOUBLE * least(solidity, 1::DOUBLE) + 0.3::DOUBLE * least(area / 5000, 1::DOUBLE)) + 0.000000001::DOUBLE, 3)"
SCENES = "(SELECT *, coalesce(cloud_cover, 100::DOUBLE) AS cc FROM scenes)"
SEARCH = f"""SELECT path, placename, layer, round(raw, 2) AS score, coalesce(CAST(acq_date AS VARCHAR), 'Unknown') AS acq_day, round(cloud_conf, 6) AS cloud_conf, round(shadow_conf, 6) AS shadow_conf FROM (
  SELECT {PATH} AS path, *, 100 * {dot(0)} AS raw FROM ({SHARES}) WHERE (acq_date IS NULL OR acq_date BETWEEN DATE '2024-02-01' AND DATE '2024-12-31'))
  WHERE raw >= 0 AND cloud_conf <= 0.35 AND shadow_conf <= 0.35 ORDER BY raw DESC, path LIMIT 5"""

_RAW: dict[str, tuple[str, tuple[str, ...]]] = {
    "scan_layer": (f"SELECT path, filename, {PLACE} AS placename, {DAY} AS acq_date, 'false_color_nir' AS layer_source FROM files WHERE {IMAGE} AND {FOLDER} LIKE '%false#_color#_nir%' ESCAPE '#'", ("files",)),
    "scan_layer_fallback": (f"SELECT path, filename, {PLACE} AS placename, 'True_Color' AS layer_source FROM files WHERE {IMAGE_MORE} AND regexp_matches({FOLDER}, 'true_color|true-color|rgb|truecolor')", ("files",)),
    "scan_layer_missing": (f"SELECT path, filename, {PLACE} AS placename, 'Fallback' AS layer_source FROM files WHERE {IMAGE_MORE} AND path NOT LIKE '%swir%' AND path NOT LIKE '%agriculture%'", ("files",)),
    "multiband_pivot": (f"""SELECT placename, base_name, string_agg(layer, ',' ORDER BY layer) AS band_names, count(*) AS n_bands, coalesce(max(CASE WHEN layer = 'true_color' THEN p END), arg_min(p, layer)) AS primary_path FROM (
      SELECT {PLACE} AS placename, regexp_replace(filename, '(_true_color|_false_color_nir|_agriculture_swir|_rgb|_nir|_swir)', '', 'gi') AS base_name, {LAYER} AS layer, max(path) AS p FROM files WHERE {IMAGE_MORE} GROUP BY ALL) GROUP BY ALL""", ("files",)),
    "load_layer": (f"SELECT acq_date, layer, min(path) AS path FROM (SELECT path, {LAYER} AS layer, {DAY} AS acq_date FROM files WHERE {IMAGE}) WHERE acq_date IS NOT NULL GROUP BY ALL", ("files",)),
    "resolve_bounds": ("""SELECT tile_id, placename, round(coalesce(CASE WHEN tile_id % 2 = 0 THEN min_lon END, CASE placename WHEN 'data_alpha_5km' THEN 80.3::DOUBLE WHEN 'data_beta_5km' THEN 87.3::DOUBLE END), 6) AS min_lon,
      round(coalesce(CASE WHEN tile_id % 2 = 0 THEN min_lat END, CASE placename WHEN 'data_alpha_5km' THEN 26.4::DOUBLE WHEN 'data_beta_5km' THEN 22.3::DOUBLE END), 6) AS min_lat FROM tile_catalog""", ("tile_catalog",)),
    "parse_date": (f"SELECT path, {DAY} AS acq_date FROM files", ("files",)),
    "available_dates": (f"SELECT DISTINCT {DAY} AS acq_date FROM files WHERE {DAY} IS NOT NULL ORDER BY 1", ("files",)),
    "existing_dates": ("SELECT split_part(path, '/', 2) AS place, count(DISTINCT split_part(filename, '_', 1)) AS n_dates FROM files WHERE lower(filename) LIKE '%.jpg' GROUP BY 1", ("files",)),
    "catalog_search": ("SELECT item_id, place, round(cloud_cover, 6) AS cloud_cover FROM scenes WHERE acq_ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND coalesce(cloud_cover, 100) < 10 AND collection = 'sentinel-2-l2a' AND " + AOI, ("scenes",)),
    "place_coalesce": ("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN nullif(c_name, '') END, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN nullif(c_mktsegment, '') END, CASE WHEN c_custkey % 7 = 0 THEN 'county' END, CASE WHEN c_custkey % 2 = 0 THEN 'state' END, 'location') AS place FROM customer", ()),
    "date_filter": ("SELECT tile_id, acq_date FROM tile_catalog WHERE acq_date IS NULL OR acq_date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'", ("tile_catalog",)),
    "aoi_filter": (f"SELECT tile_id FROM tile_catalog WHERE (acq_date IS NULL OR acq_date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30') AND {AOI}", ("tile_catalog",)),
    "artifact_gate": (f"SELECT tile_id, round(cloud_conf, 6) AS cloud_conf, round(shadow_conf, 6) AS shadow_conf FROM ({SHARES}) WHERE cloud_conf <= 0.35 AND shadow_conf <= 0.35", ("tile_catalog",)),
    "softmax": ("SELECT event_id, round(exp(a - m) / z, 6) AS p0, round(exp(b - m) / z, 6) AS p1, round(exp(c - m) / z, 6) AS p2 FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS z FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT event_id, value / 100 AS a, 0.5::DOUBLE AS b, (event_id % 3)::DOUBLE AS c FROM events)))", ()),
    "score_threshold": (f"SELECT tile_id, score FROM (SELECT tile_id, round(100 * {dot(0)}, 6) AS score FROM tile_catalog) WHERE score >= 10", ("tile_catalog",)),
    "cluster_filter": (f"SELECT event_id, category, area FROM shapes WHERE area > 400 AND {KEEP} AND (category <> 'Construction' OR extent >= 0.25)", ("shapes",)),
    "cluster_filter_strict": (f"SELECT event_id, category, area FROM shapes WHERE area > 800 AND {KEEP} AND (category <> 'Construction' OR extent >= 0.4)", ("shapes",)),
    "route_query": (routed(text.SHORT_RULES, text.SHORT_DEFAULT), ()),
    "route_query_long": (routed(text.LONG_RULES, text.LONG_DEFAULT), ()),
    "pixel_to_lonlat": ("SELECT event_id, round(80.3::DOUBLE + x / 800::DOUBLE * (80.348::DOUBLE - 80.3::DOUBLE), 6) AS lon, round(26.448::DOUBLE - y / 800::DOUBLE * (26.448::DOUBLE - 26.4::DOUBLE), 6) AS lat FROM shapes", ("shapes",)),
    "bbox_from_center": ("""SELECT tile_id, round(min_lon - s, 6) AS west, round(min_lat - 2.5::DOUBLE / 111, 6) AS south, round(min_lon + s, 6) AS east, round(min_lat + 2.5::DOUBLE / 111, 6) AS north
      FROM (SELECT *, 2.5::DOUBLE / (111 * cos(radians(min_lat))) AS s FROM tile_catalog) WHERE min_lon IS NOT NULL""", ("tile_catalog",)),
    "grid_tiles": ("SELECT row, col, round(80.3::DOUBLE + col * 0.045::DOUBLE, 6) AS min_lon, round(26.4::DOUBLE + row * 0.045::DOUBLE, 6) AS min_lat, round(least(80.3::DOUBLE + (col + 1) * 0.045::DOUBLE, 80.52::DOUBLE), 6) AS max_lon, round(least(26.4::DOUBLE + (row + 1) * 0.045::DOUBLE, 26.55::DOUBLE), 6) AS max_lat FROM range(0, 4) a(row), range(0, 5) b(col)", ()),
    "slug": (f"SELECT CAST(i AS BIGINT) AS i, regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS slug FROM {quoted(NAMES)}", ()),
    "safe_name": (f"SELECT CAST(i AS BIGINT) AS i, substr(trim(regexp_replace(q, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), 1, 30) AS name FROM {quoted(NAMES)}", ()),
    "seed_lookup": ("SELECT path, filename FROM files WHERE 'undated_tile34_nir.jpg' IN (filename, path) ORDER BY path LIMIT 1", ("files",)),
    "bbox_polygon": ("""SELECT tile_id, CAST(i AS BIGINT) AS i, round(min_lon + CASE WHEN i IN (1, 2) THEN 0.045::DOUBLE ELSE 0 END, 6) AS lon, round(min_lat + CASE WHEN i IN (2, 3) THEN 0.045::DOUBLE ELSE 0 END, 6) AS lat
      FROM tile_catalog, range(0, 5) r(i) WHERE min_lon IS NOT NULL""", ("tile_catalog",)),
    "polygon_ring": ("""WITH p AS (SELECT site_id, rn, round(sim, 6) AS x, obs_id % 7 AS y FROM observations),
      s AS (SELECT site_id, count(*) AS n, arg_min(x, rn) = arg_max(x, rn) AND arg_min(y, rn) = arg_max(y, rn) AS shut FROM p GROUP BY 1 HAVING count(*) >= 3)
      SELECT site_id, CAST(rn - 1 AS BIGINT) AS i, x, y FROM p JOIN s USING (site_id) UNION ALL SELECT site_id, n AS i, x, y FROM p JOIN s USING (site_id) WHERE NOT shut AND rn = 1""", ("observations",)),
    "manifest": (f"SELECT filename, band, path FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY CASE band WHEN 'true_color' THEN 1 WHEN 'false_color_nir' THEN 2 ELSE 3 END DESC, path DESC) AS rn FROM (SELECT filename, path, {LAYER} AS band FROM files)) WHERE rn = 1", ("files",)),
    "event_legend": (f"SELECT {TYPE} AS type, count(*) AS count, CAST(sum(CAST(area AS BIGINT)) AS BIGINT) AS area, bool_or(is_global) AS is_global FROM shapes GROUP BY 1", ("shapes",)),
    "cache_missing": ("SELECT tile_id, layer FROM tile_catalog WHERE tile_id % 5 <> 0 AND tile_id % 3 = 0", ("tile_catalog",)),
    "cache_evict": ("SELECT tile_id, layer FROM tile_catalog WHERE tile_id % 3 <> 0 AND tile_id % 5 <> 0", ("tile_catalog",)),
    "index_add": ("SELECT tile_id, layer FROM tile_catalog WHERE tile_id % 3 <> 0 OR tile_id % 5 <> 0", ("tile_catalog",)),
    "cloud_pct": (f"SELECT tile_id, t, round(cloud, 6) AS cloud_pct FROM ({GATES})", ("pixels",)),
    "border_pct": (f"SELECT tile_id, t, round(border, 6) AS border_pct FROM ({GATES})", ("pixels",)),
    "quality_verdict": (f"SELECT tile_id, t, CASE WHEN cloud > 15 OR border > 25 THEN 'rejected' ELSE 'passed' END AS status, CASE WHEN cloud > 15 THEN 'cloud' WHEN border > 25 THEN 'border' END AS reason, CASE WHEN cloud > 15 THEN format('Rejected: Excessive cloud cover ({{:.1f}}% > 15%).', cloud) WHEN border > 25 THEN format('Rejected: Excessive black borders ({{:.1f}}% > 25%).', border) ELSE 'Passed quality gate.' END AS message FROM ({GATES})", ("pixels",)),
    "quality_confidence": (f"SELECT tile_id, t, round(greatest(0::DOUBLE, 1 - least(1::DOUBLE, cloud / 100 + border / 200)), 3) AS confidence FROM ({GATES})", ("pixels",)),
    "sharpness": (f"SELECT tile_id, t, round(sharpness, 6) AS sharpness FROM ({SHARP})", ("pixels",)),
    "clarity": (f"SELECT tile_id, t, round(sharpness + 5 * (100 * (tile_id / 100::DOUBLE)), 6) AS clarity FROM ({SHARP})", ("pixels",)),
    "master_reference": (f"SELECT t, tile_id FROM (SELECT t, tile_id, row_number() OVER (PARTITION BY t ORDER BY round(sharpness + 5 * (100 * (tile_id / 100::DOUBLE)), 6) DESC, tile_id) AS rn FROM ({SHARP})) WHERE rn = 1", ("pixels",)),
    "thumbnail": ("SELECT tile_id, t, y // 4 AS y, x // 4 AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM (SELECT tile_id, t, CAST(y AS INT) AS y, CAST(x AS INT) AS x, r, g, b FROM pixels) GROUP BY 1, 2, 3, 4", ("pixels",)),
    "thumb_qa": ("""WITH d AS (SELECT tile_id, t, avg((r + g + b < 35)::INT::DOUBLE) AS dark, avg((r > 200 AND g > 200 AND b > 200)::INT::DOUBLE) AS bright FROM pixels GROUP BY ALL),
      ys AS (SELECT tile_id, t, count(*) FILTER (m < 35) AS dead_y FROM (SELECT tile_id, t, y, avg((r + g + b) / 3::DOUBLE) AS m FROM pixels GROUP BY ALL) GROUP BY ALL),
      xs AS (SELECT tile_id, t, count(*) FILTER (m < 35) AS dead_x FROM (SELECT tile_id, t, x, avg((r + g + b) / 3::DOUBLE) AS m FROM pixels GROUP BY ALL) GROUP BY ALL)
      SELECT tile_id, t, round(dark, 6) AS dark, round(bright, 6) AS bright, dead_y, dead_x, dark <= 0.12 AND dead_y < 8 AND dead_x < 8 AND bright <= 0.03 AS ok FROM d JOIN ys USING (tile_id, t) JOIN xs USING (tile_id, t)""", ("pixels",)),
    "ndvi": (f"SELECT {CHIP}, round({NDVI}, 6) AS ndvi FROM pixels", ("pixels",)),
    "ndwi": (f"SELECT {CHIP}, round({NDWI}, 6) AS ndwi FROM pixels", ("pixels",)),
    "erode15": (slide("SELECT tile_id, t, y, x, least(r, g, b) AS dark FROM pixels", "dark", 15, "min"), ("pixels",)),
    "dilate5": (slide(flag("r > 128"), "m", 5, "max"), ("pixels",)),
    "open3": (opened(flag("r > 128"), "m", 3), ("pixels",)),
    "close9": (closed(flag("r > 128"), "m", 9), ("pixels",)),
    "nodata_mask": (NODATA, ("pixels",)),
    "cloud_mask": (CLOUD, ("pixels",)),
    "shadow_mask": (SHADOW, ("pixels",)),
    "invalid_mask": (f"SELECT tile_id, y, x, max(greatest(nodata, cloud, shadow)) AS invalid FROM ({NODATA}) JOIN ({CLOUD}) USING (tile_id, t, y, x) JOIN ({SHADOW}) USING (tile_id, t, y, x) GROUP BY ALL", ("pixels",)),
    "water_change": (f"SELECT tile_id, y, x, w2 > 0.1 AND NOT w1 > 0.1 AS flood, w1 > 0.1 AND NOT w2 > 0.1 AS recede FROM (SELECT tile_id, y, x, {of(NDWI, 'd1')} AS w1, {of(NDWI, 'd2')} AS w2 FROM {BOTH})", ("pixels",)),
    "veg_change": (VEG, ("pixels",)),
    "seasonal_gate": (f"SELECT tile_id, round(s, 6) AS share, s > 0.09 AS is_global FROM (SELECT tile_id, avg(loss::INT::DOUBLE) AS s FROM ({VEG}) GROUP BY 1)", ("pixels",)),
    "channel_cdf": (f"SELECT tile_id, t, v, round(cdf, 6) AS cdf FROM ({cdf('r')})", ("pixels",)),
    "otsu": (otsu("SELECT tile_id, t, r AS v, count(*)::DOUBLE AS c FROM pixels GROUP BY ALL", "tile_id, t"), ("pixels",)),
    "built_mask": (f"""WITH gains AS MATERIALIZED ({GAIN}), veg AS MATERIALIZED ({VEG}), st AS MATERIALIZED ({STRUCT})
      SELECT tile_id, y, x, coalesce(gain > threshold, false) AND m = 1 AND NOT loss AS built FROM gains LEFT JOIN ({otsu('SELECT tile_id, gain AS v, count(*)::DOUBLE AS c FROM gains GROUP BY ALL')}) USING (tile_id)
      JOIN st USING (tile_id, y, x) JOIN veg USING (tile_id, y, x)""", ("pixels",)),
    "ssim_box": (f"SELECT tile_id, y, x, round(ssim, 6) AS ssim FROM ({SSIM})", ("pixels",)),
    "structural_change": (f"SELECT tile_id, y, x, m AS changed FROM ({STRUCT})", ("pixels",)),
    "atmos_light": (f"SELECT tile_id, t, round(a_r, 6) AS a_r, round(a_g, 6) AS a_g, round(a_b, 6) AS a_b FROM ({LIGHT})", ("pixels",)),
    "dehaze": (HAZE, ("pixels",)),
    "enhance": (enhanced("SELECT * FROM pixels"), ("pixels",)),
    "standardise": (standardised(), ("pixels",)),
    "hist_match": (f"SELECT tile_id, v, matched FROM ({matched(f'SELECT * FROM ({cdf("r")}) WHERE t = 1', f'SELECT * FROM ({cdf("r")}) WHERE t = 0')})", ("pixels",)),
    "date_pairs": ("SELECT site_id, ts AS t1, nxt AS t2 FROM (SELECT site_id, ts, lead(ts) OVER (PARTITION BY site_id ORDER BY ts, obs_id) AS nxt FROM observations) WHERE nxt IS NOT NULL", ("observations",)),
    "earliest_change": ("""SELECT f.site_id, o.obs_id FROM (SELECT site_id, max(n) AS n, min(CASE WHEN sim >= 0.55 AND rn < n THEN rn END) AS f FROM observations GROUP BY site_id) f LEFT JOIN observations o
      ON o.site_id = f.site_id AND o.rn = CASE WHEN f.n < 3 OR f.f = 1 THEN f.n - 1 ELSE coalesce(f.f - 1, f.n - 1) END""", ("observations",)),
    "classify_event": (f"SELECT event_id, {TYPE} AS type FROM shapes", ("shapes",)),
    "event_confidence": (f"SELECT event_id, {CONFIDENCE} AS confidence FROM shapes", ("shapes",)),
    "semantic_search": (SEARCH, ("tile_catalog",)),
    "semantic_search_15": (f"SELECT {PATH} AS path, placename, layer, round(raw, 2) AS score, CAST(acq_date AS VARCHAR) AS acq_day FROM (SELECT *, 100 * {dot(0)} AS raw FROM tile_catalog WHERE layer IN ('true_color', 'false_color_nir') AND {AOI}) WHERE raw >= 5 ORDER BY raw DESC, path LIMIT 15", ("tile_catalog",)),
    "image_search": (f"SELECT path, score FROM (SELECT {PATH} AS path, round(raw, 2) AS score, tile_id FROM (SELECT *, 100 * {dot(9)} AS raw FROM tile_catalog WHERE layer = 'true_color') WHERE raw >= 0 ORDER BY raw DESC, path LIMIT 15) WHERE tile_id <> 9 ORDER BY score DESC, path LIMIT 5", ("tile_catalog",)),
    "search_dedupe": (f"SELECT path, tile_id, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, tile_id) AS rn FROM (SELECT tile_id, concat_ws('/', placename, layer, CAST(acq_date AS VARCHAR)) AS path, round(100 * {dot(0)}, 6) AS score FROM tile_catalog)) WHERE rn = 1", ("tile_catalog",)),
    "band_fusion": (f"SELECT base, i, round(x, 6) AS x FROM ({FUSED})", ()),
    "similar_sites": (f"WITH f AS ({FUSED}) SELECT base, round(raw, 6) AS score FROM (SELECT f.base, 100 * sum(f.x * s.x) AS raw FROM f JOIN f s ON s.base = 4 AND s.i = f.i WHERE f.base <> 4 GROUP BY 1) WHERE raw >= 5 ORDER BY raw DESC, base LIMIT 6", ()),
    "rocchio_query": ("""WITH v AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE vec_id < 6)),
      m AS (SELECT i, avg(x) FILTER (vec_id < 4) - 0.15::DOUBLE * avg(x) FILTER (vec_id >= 4) AS x FROM v GROUP BY i) SELECT i, round(x / sqrt(sum(x * x) OVER ()), 6) AS x FROM m""", ()),
    "cluster_features": (f"WITH f AS ({FUSED}), s AS (SELECT base, round(raw, 6) AS score FROM (SELECT f.base, 100 * sum(f.x * s.x) AS raw FROM f JOIN f s ON s.base = 4 AND s.i = f.i WHERE f.base <> 4 GROUP BY 1) WHERE raw >= 5 ORDER BY raw DESC, base LIMIT 6) SELECT 'Similar_to_4' AS cluster_group, placename, CAST(base AS VARCHAR) AS filename, score AS match_confidence, round(min_lon, 6) AS west, CASE WHEN min_lon IS NULL THEN 0 ELSE 5 END::BIGINT AS corners FROM s JOIN tile_catalog ON tile_id = base * 3", ("tile_catalog",)),
    "cluster_preview": (f"SELECT cluster, CAST(rn AS INT) AS rn, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY tile_id) AS rn FROM ({ASSIGN})) WHERE rn <= 8", ("tile_catalog",)),
    "kmeans_assign": (ASSIGN, ("tile_catalog",)),
    "cluster_sizes": (f"SELECT cluster, count(*) AS n FROM ({ASSIGN}) GROUP BY 1", ("tile_catalog",)),
    "cluster_mates": (f"WITH a AS ({ASSIGN}) SELECT tile_id, cluster FROM a WHERE tile_id <> 10 AND cluster = (SELECT cluster FROM a WHERE tile_id = 10)", ("tile_catalog",)),
    "monthly_best": (f"SELECT place, month, item_id, round(cc, 6) AS cloud_cover FROM (SELECT *, strftime(acq_ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY place, strftime(acq_ts, '%Y-%m') ORDER BY cc, item_id) AS rn FROM {SCENES} WHERE cc < 10) WHERE rn = 1", ("scenes",)),
    "nearest_scene": ("SELECT place, item_id, away FROM (SELECT place, item_id, away, row_number() OVER (PARTITION BY place ORDER BY away, item_id) AS rn FROM (SELECT *, CAST(abs(epoch(acq_ts) - epoch(TIMESTAMP '1996-01-01')) AS BIGINT) AS away FROM scenes)) WHERE rn = 1", ("scenes",)),
    "even_sample": ("""WITH s AS (SELECT place, item_id, row_number() OVER (PARTITION BY place ORDER BY acq_ts, item_id) - 1 AS i, count(*) OVER (PARTITION BY place) AS n FROM scenes)
      SELECT place, item_id FROM s WHERE n <= 6 OR i IN (SELECT CAST(round_even(j * (s.n - 1) / 5::DOUBLE, 0) AS BIGINT) FROM range(0, 6) r(j))""", ("scenes",)),
    "remaining_scenes": ("SELECT item_id, place FROM scenes WHERE item_id % 3 <> 0 AND item_id % 5 <> 0", ("scenes",)),
    "review_ranked": ("SELECT id, round(confidence, 6) AS confidence FROM candidates WHERE status = 'pending' ORDER BY confidence DESC, seq LIMIT 20", ("candidates",)),
    "review_resolve": ("WITH q AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, seq) AS n FROM candidates WHERE status = 'pending') SELECT c.choice, q.id, round(q.confidence, 6) AS confidence FROM (VALUES ('1'), ('20'), ('33'), ('0'), ('C4'), ('c7'), ('c2'), ('zzz')) c(choice) JOIN q ON q.n = try_cast(c.choice AS BIGINT) OR lower(q.id) = lower(c.choice)", ("candidates",)),
    "review_state": ("WITH d AS (SELECT 'c' || CAST(seq % 50 + 1 AS VARCHAR) AS id, max(seq) AS at, arg_max(status, seq) AS decision FROM candidates WHERE status <> 'pending' GROUP BY 1) SELECT c.id, c.label, coalesce(d.decision, 'pending') AS status, d.at AS decision_at FROM candidates c LEFT JOIN d ON c.id = d.id", ("candidates",)),
    "feedback_terms": ("SELECT label, min(seq) AS seq FROM candidates WHERE status = 'confirmed' AND label <> '' GROUP BY 1 ORDER BY 2 LIMIT 3", ("candidates",)),
    "review_from_search": (f"SELECT 'c' || CAST(row_number() OVER (ORDER BY path) AS VARCHAR) AS id, round(least(1::DOUBLE, greatest(0::DOUBLE, score / 100)), 3) AS confidence, CASE WHEN right(path, 1) < '5' THEN 'confirmed' ELSE 'rejected' END AS status FROM ({SEARCH})", ("tile_catalog",)),
    "review_from_events": (f"SELECT 'r' || CAST(event_id AS VARCHAR) AS id, category AS label, {CONFIDENCE} AS confidence, 'pending' AS status FROM shapes WHERE area > 400 AND {KEEP} AND (category <> 'Construction' OR extent >= 0.25)", ("shapes",)),
}

ORACLES = {name: oracle(sql, *views) for name, (sql, views) in _RAW.items()}
