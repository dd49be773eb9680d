"""Neighbourhood kernels on whole chips, in NumPy, for grouped Arrow functions.

Shapes follow the definitions of the common image libraries: outer boundaries of
8-connected regions, areas of the polygon through pixel centres, hulls, smallest
rotated rectangles. The straight-line test asks for a straight stretch of
boundary, and smoothing and equalisation follow the published formulas; neither
is meant to be bit-equal to any library.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from . import raster

_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # clockwise from east, y down


def box_extreme(m: np.ndarray, size: int, largest: bool) -> np.ndarray:
    """Sliding minimum or maximum over a square; cells outside are left out."""
    pick, out = np.maximum if largest else np.minimum, m
    if m.dtype.kind == "f":
        pad = -np.inf if largest else np.inf
    elif m.dtype.kind == "b":
        pad = not largest
    else:
        pad = np.iinfo(m.dtype).min if largest else np.iinfo(m.dtype).max
    half = size // 2
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (half, half)
        wide, n, held = np.pad(out, width, constant_values=pad), m.shape[axis], 1
        part = lambda a, i, j: a[i:j] if axis == 0 else a[:, i:j]  # noqa: B023, E731
        while held < size:  # each cell holds ``held`` cells from itself on; windows of up to twice that are two of them
            step = min(held, size - held)
            wide = pick(part(wide, 0, wide.shape[axis] - step), part(wide, step, wide.shape[axis]))
            held += step
        out = part(wide, 0, n)
    return out


def closing(m: np.ndarray, size: int) -> np.ndarray:
    return box_extreme(box_extreme(m, size, True), size, False)


def opening(m: np.ndarray, size: int) -> np.ndarray:
    return box_extreme(box_extreme(m, size, False), size, True)


def equalise(grey: np.ndarray, clip: float = 3.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation on a grid of cells, blended between them."""
    h, w = grey.shape
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            cell = grey[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].ravel()
            hist = np.bincount(cell, minlength=256).astype(float)
            most = max(clip * cell.size / 256, 1)
            over = np.maximum(hist - most, 0).sum()
            maps[i, j] = np.round(np.cumsum(np.minimum(hist, most) + over / 256) * 255 / cell.size)
    fy = np.clip((np.arange(h) + 0.5) * grid / h - 0.5, 0, grid - 1)
    fx = np.clip((np.arange(w) + 0.5) * grid / w - 0.5, 0, grid - 1)
    y0, x0 = np.minimum(fy.astype(int), grid - 2) if grid > 1 else fy.astype(int), np.minimum(fx.astype(int), grid - 2) if grid > 1 else fx.astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    flat, value = maps.ravel(), grey.astype(np.int64)
    at = lambda dy, dx: flat.take((np.minimum(y0 + dy, grid - 1) * (grid * 256))[:, None] + (np.minimum(x0 + dx, grid - 1) * 256)[None, :] + value)
    out = (1 - wy) * ((1 - wx) * at(0, 0) + wx * at(0, 1)) + wy * ((1 - wx) * at(1, 0) + wx * at(1, 1))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def bilateral(grey: np.ndarray, size: int = 5, colour: float = 50.0, space: float = 50.0) -> np.ndarray:
    """Mean of near pixels of like value, weighted by distance and difference."""
    half, g, (h, w) = size // 2, grey.astype(float), grey.shape
    wide, value = np.pad(g, half, mode="reflect"), grey.astype(np.intp)
    index = np.pad(value, half, mode="reflect") + 255
    apart = np.arange(-255, 256).astype(float) ** 2
    total, weight = np.zeros_like(g), np.zeros_like(g)
    for dy in range(-half, half + 1):
        for dx in range(-half, half + 1):
            if dy * dy + dx * dx <= half * half:
                box = slice(half + dy, half + dy + h), slice(half + dx, half + dx + w)
                k = np.exp(-apart / (2 * colour**2) - (dy * dy + dx * dx) / (2 * space**2)).take(index[box] - value)  # levels are few
                total += k * wide[box]
                weight += k
    return np.round(total / weight).astype(np.uint8)


def _box_mean(a: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    s = np.pad(np.pad(a, half, mode="symmetric").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = a.shape
    return (s[size : size + h, size : size + w] - s[:h, size : size + w] - s[size : size + h, :w] + s[:h, :w]) / size**2


def similarity(a: np.ndarray, b: np.ndarray, size: int = 11) -> np.ndarray:
    """Structural similarity in box windows with sample covariance."""
    x, y = a.astype(float), b.astype(float)
    fix = size**2 / (size**2 - 1)
    mx, my = _box_mean(x, size), _box_mean(y, size)
    vx, vy, cov = (fix * (_box_mean(p, size) - q) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def structure_change(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where structure differs; similarity below 0 counts as none."""
    level = [bilateral(equalise(g)) for g in (a, b)]
    alike = np.maximum(similarity(*level), 0)
    low = (255 - (alike * 255).astype(np.uint8)) > int((1 - raster.SSIM_LIMIT) * 255)
    return closing(opening(low.astype(np.uint8), 3), 5).astype(bool)


def otsu_cut(values: np.ndarray) -> int:
    hist = np.bincount(values.ravel(), minlength=256).astype(float)
    w, s = hist.cumsum(), (hist * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s * w[-1] - s[-1] * w) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The whole-pixel shift of ``b`` that phase correlation finds, at most half a chip either way."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    peak = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-9)).real
    return tuple(int(p) - n * (int(p) > n // 2) for p, n in zip(np.unravel_index(peak.argmax(), peak.shape), peak.shape))


def moved(b: np.ndarray, by: tuple[int, int]) -> np.ndarray:
    """``b`` moved, with 0 where nothing comes in."""
    out, (h, w), (dy, dx) = np.zeros_like(b), b.shape, by
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b`` moved onto ``a``."""
    return moved(b, shift_between(a, b))


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear between pixel centres, held at the edges."""
    out = a.astype(float)
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0, a.shape[axis] - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, a.shape[axis] - 1), axis) * part
    return np.round(out).astype(a.dtype)


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (y, x) of each 8-connected region, by union of runs of rows."""
    cells = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    cells[:, 1:-1] = mask
    rows, edge = np.nonzero(cells[:, 1:] != cells[:, :-1])  # a run of a row begins and ends at such a place
    y, a, b = rows[::2], edge[::2], edge[1::2]
    if not len(y):
        return []
    # A run meets those of the row above that end at or after its start and start at or before its end.
    wide = cells.shape[1] + 1
    low, high = np.searchsorted(y * wide + b, (y - 1) * wide + a), np.searchsorted(y * wide + a, (y - 1) * wide + b, side="right")
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for own, (c, d) in enumerate(zip(low.tolist(), high.tolist())):
        for other in range(c, d):
            one, two = find(own), find(other)
            root[max(one, two)] = min(one, two)
    label = np.array([find(i) for i in range(len(y))])
    size = b - a
    pixel = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + np.repeat(a, size)
    pixels, label = np.stack([np.repeat(y, size), pixel], axis=1), np.repeat(label, size)
    order = np.argsort(label, kind="stable")
    return np.split(pixels[order], np.flatnonzero(np.diff(label[order])) + 1)


def outline(pixels: np.ndarray) -> np.ndarray:
    """Outer boundary as (x, y), clockwise from the topmost-left pixel."""
    corner = pixels.min(0) - 1
    height, width = (pixels.max(0) - corner + 2).tolist()
    cells = np.zeros((height, width), np.uint8)
    cells[pixels[:, 0] - corner[0], pixels[:, 1] - corner[1]] = 1
    start = int(cells.argmax())
    inside, steps = cells.tobytes(), [dy * width + dx for dy, dx in _AROUND]
    turns = [[((came + turn) % 8, steps[(came + turn) % 8]) for turn in range(1, 9)] for came in range(8)]
    path, here, came = [start], start, 4  # came: direction towards the background we entered by
    first = None
    while True:
        for way, step in turns[came]:
            nxt = here + step
            if inside[nxt]:
                break
        else:
            break
        if first is None:
            first = (nxt, way)
        elif here == start and (nxt, way) == first:
            path.pop()
            break
        path.append(nxt)
        here, came = nxt, (way + 4) % 8
    y, x = np.divmod(np.array(path), width)
    return np.stack([x + corner[1], y + corner[0]], axis=1).astype(float)


def area_of(p: np.ndarray) -> float:
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2


def hull(p: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def least_rectangle(h: np.ndarray) -> tuple[float, float]:
    """Long and short side of the smallest rectangle around a hull; one side lies on an edge."""
    if len(h) < 3:
        return float(np.hypot(*(h.max(0) - h.min(0)))), 0.0
    best = (np.inf, 0.0, 0.0)
    for edge in np.roll(h, -1, axis=0) - h:
        u = edge / np.hypot(*edge)
        spans = [np.ptp(h @ u), np.ptp(h @ np.array([-u[1], u[0]]))]
        best = min(best, (spans[0] * spans[1], max(spans), min(spans)))
    return float(best[1]), float(best[2])


def simplify(p: np.ndarray, slack: float) -> np.ndarray:
    """Ramer-Douglas-Peucker on a closed line, split at its farthest point."""
    if len(p) < 3:
        return p
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    closed = np.concatenate([p, p[:1]])
    keep, todo = {0, far}, [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, part = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        n = np.hypot(*d)
        away = np.abs(part[:, 0] * d[1] - part[:, 1] * d[0]) / n if n else np.hypot(part[:, 0], part[:, 1])
        if away.max() > slack:
            mid = a + 1 + int(away.argmax())
            keep.add(mid)
            todo += [(a, mid), (mid, b)]
    return p[sorted(keep)]


@dataclass
class Shape:
    category: str
    contour: np.ndarray | None = None
    area: float = 0.0
    box: tuple[int, int, int, int] = (0, 0, 0, 0)
    solidity: float = 0.0
    extent: float = 0.0
    aspect: float = 0.0
    compactness: float = 0.0
    centre: tuple[int, int] = (0, 0)
    is_linear: bool = False
    is_global: bool = False
    points: list = field(default_factory=list)


def centre_of(p: np.ndarray) -> tuple[int, int]:
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    total = cross.sum()
    if not total:
        return 0, 0
    return int(((p[:, 0] + q[:, 0]) * cross).sum() / (3 * total)), int(((p[:, 1] + q[:, 1]) * cross).sum() / (3 * total))


def shapes(mask: np.ndarray, category: str, skip: bool = False) -> list[Shape]:
    """Measured regions of a mask; one global marker if the mask is to be skipped."""
    if skip:
        return [Shape(f"Global Shift ({category})", is_global=True)]
    merged = closing(mask.astype(np.uint8), 9 if "Clearance" in category or "Growth" in category else 15)
    out = []
    for pixels in regions(merged):
        if len(pixels) <= raster.MIN_AREA:  # the polygon is never larger than its pixels
            continue
        line = outline(pixels)
        area = area_of(line)
        (x, y), (x2, y2) = line.min(0).astype(int), line.max(0).astype(int)
        w, h = int(x2 - x + 1), int(y2 - y + 1)
        around = hull(line)
        full = area_of(around) if len(around) > 2 else 0.0
        length = float(np.hypot(*(np.roll(line, -1, axis=0) - line).T).sum())
        sides = least_rectangle(around)
        edges = simplify(line, 1.0)
        stretch = np.hypot(*(np.roll(edges, -1, axis=0) - edges).T).max() if len(edges) > 1 else 0.0
        out.append(Shape(
            category, simplify(line, 0.01 * length), area, (int(x), int(y), w, h), area / full if full else 0.0, area / (w * h),
            sides[0] / (sides[1] + 1e-5), 4 * np.pi * area / length**2 if length else 0.0, centre_of(line), bool(stretch >= 25),
        ))
    return out


def masks(chip: dict[str, np.ndarray], strict: bool = True) -> dict[str, np.ndarray]:
    """Change masks of one place at two dates. Strict leaves unusable pixels out."""
    grey, water, veg, bad = [], [], [], np.zeros(chip["r_1"].shape, bool)
    for t in (1, 2):
        r, g, b, nir = (chip[f"{c}_{t}"].astype(float) for c in ("r", "g", "b", "nir"))
        grey.append(np.round(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8))
        with np.errstate(divide="ignore", invalid="ignore"):
            water.append(np.nan_to_num((g - nir) / (g + nir)) > raster.WATER)
            veg.append(np.nan_to_num((nir - r) / (nir + r)))
        if strict:
            top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
            sat = np.where(top > 0, np.round((top - low) * 255 / np.maximum(top, 1)), 0)
            for m, open_, wide in ((grey[-1] <= 5, 1, 9), ((top > 160) & (sat <= 50), 7, 35), (top <= 35, 5, 15)):
                bad |= box_extreme(opening(m.astype(np.uint8), open_), wide, True).astype(bool)
    changed = structure_change(*grey)
    drop = veg[0] - veg[1]
    out = {
        "Flooding": water[1] & ~water[0],
        "Water Receded": water[0] & ~water[1],
        "Land Clearance": (veg[0] > raster.VEGETATION) & (drop > raster.VEGETATION_DROP) & changed,
        "Afforestation / Crop Growth": (veg[1] > raster.VEGETATION) & (-drop > raster.VEGETATION_DROP) & changed,
    }
    gain = bilateral(np.clip(grey[1].astype(int) - grey[0], 0, 255).astype(np.uint8))
    gain[gain <= 25] = 0
    bright = gain > otsu_cut(gain) if gain.max() else np.zeros_like(bad)
    out["Construction"] = bright & changed & ~out["Land Clearance"]
    if strict:
        out["Construction"] &= ~out["Flooding"] & ~(drop > raster.VEGETATION_DROP)
        out = {k: m & ~bad for k, m in out.items()}
    return out


def events(chip: dict[str, np.ndarray], strict: bool = True) -> list[Shape]:
    """All measured shapes of a pair of dates; seasonal vegetation is one marker."""
    found = masks(chip, strict)
    shift = {k: bool(m.mean() > raster.SEASONAL_LIMIT) for k, m in found.items()}
    out = []
    for category, mask in found.items():
        if category == "Construction" and shift[category] and strict:
            out += [Shape("Global Shift (Construction)", is_global=True), Shape("Global Shift (Albedo Spike)", is_global=True)]
        else:
            out += shapes(mask, category, skip=shift[category] and ("Clearance" in category or "Growth" in category))
    return out


_POINTS = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
SHAPES = T.StructType([T.StructField(c, t) for c, t in (
    ("tile_id", T.LongType()), ("t_1", T.IntegerType()), ("t_2", T.IntegerType()), ("category", T.StringType()), ("area", T.DoubleType()),
    ("x", T.IntegerType()), ("y", T.IntegerType()), ("w", T.IntegerType()), ("h", T.IntegerType()),
    ("solidity", T.DoubleType()), ("extent", T.DoubleType()), ("aspect", T.DoubleType()), ("compactness", T.DoubleType()), ("center_x", T.IntegerType()), ("center_y", T.IntegerType()),
    ("is_linear", T.BooleanType()), ("is_global", T.BooleanType()), ("contour", _POINTS),
)])


def _planes(row: dict, tail: str = "") -> np.ndarray:
    """(channels, height, width) of a chip row."""
    return np.frombuffer(row["data" + tail], np.uint8).reshape(row["height" + tail], row["width" + tail], -1).transpose(2, 0, 1)


_PAIR = ("height", "width", "data", "height_2", "width_2", "data_2")


def pair_shapes(batches, strict: bool, enlarge: int, aligned: bool):
    """Rows of ``SHAPES`` from batches of pairs; a pair equal to the one before it takes over its shapes."""
    arrow = to_arrow_schema(SHAPES)
    last, found, out = None, [], []
    for batch in batches:
        for at in range(batch.num_rows):
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
            (row,) = batch.slice(at, 1).to_pylist()
            own = {"tile_id": row["tile_id"], "t_1": row["t"], "t_2": row["t_2"]}
            if (now := tuple(row[c] for c in _PAIR)) == last:
                out += [own | f for f in found]
                continue
            one, two = _planes(row), _planes(row, "_2")
            if one.shape != two.shape:
                two = np.stack([resize(p, *one.shape[1:]) for p in two])
            if aligned:
                by = shift_between(*(p[:3].mean(axis=0) for p in (one, two)))
                two = np.stack([moved(p, by) for p in two])
            big = [p.repeat(enlarge, axis=1).repeat(enlarge, axis=2) for p in (one, two)]
            chip = {f"{c}_{t}": plane for t, p in enumerate(big, 1) for c, plane in zip(("r", "g", "b", "nir"), p)}
            last, found = now, [
                {"category": s.category, "area": s.area, **dict(zip("xywh", s.box)), "solidity": s.solidity, "extent": s.extent, "aspect": s.aspect, "compactness": s.compactness,
                 "center_x": s.centre[0], "center_y": s.centre[1], "is_linear": s.is_linear, "is_global": s.is_global, "contour": None if s.contour is None else [{"x": int(a), "y": int(b)} for a, b in s.contour]}
                for s in events(chip, strict)
            ]
            out += [own | f for f in found]
    yield pa.RecordBatch.from_pylist(out, schema=arrow)


def change_shapes(pixels: DataFrame, strict: bool = True, enlarge: int = 1, aligned: bool = False) -> DataFrame:
    """Measured shapes of all pairs of consecutive dates of every tile.

    Pixels are gathered into one binary row a chip, a chip meets the tile's next
    one, and a pair is one step of work: no date meets all others. A second chip
    of another size is resized to the first; ``aligned`` moves it onto the first;
    ``enlarge`` repeats every pixel so many times each way.

    Equal pairs have equal shapes. So pairs are brought together by a hash of their
    pixels and sorted by it, and a pair that equals the one before it, byte for byte,
    takes over its shapes; only these are held.
    """
    chips = to_chips(pixels, ("r", "g", "b", "nir"))
    line = W.partitionBy("tile_id").orderBy("t")
    pairs = chips.withColumns({f"{c}_2": F.lead(c).over(line) for c in ("t", "height", "width", "data")}).where("t_2 is not null")
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: small chips are much work
    pairs = pairs.withColumn("h", F.xxhash64(*_PAIR)).repartition(parts, "h").sortWithinPartitions("h")
    return pairs.mapInArrow(lambda batches: pair_shapes(batches, strict, enlarge, aligned), SHAPES)


def patch_similarity(a: np.ndarray, b: np.ndarray, size: int = 7) -> float | None:
    """Mean structural similarity of two grey patches, away from their edges; null if they are too small."""
    if a.shape != b.shape or min(a.shape) < size:
        return None
    half = size // 2
    return float(similarity(a, b, size)[half:-half, half:-half].mean())


def first_dates(pixels: DataFrame, events: DataFrame, around: int = 40, limit: float = raster.SSIM_LIMIT) -> DataFrame:
    """(tile_id, center_x, center_y, first_t) of events: the last date of the leading run whose patch is unlike the latest.

    Without such a run it is the date before the last, as for tiles of fewer than
    three dates; null for a single date. Global markers have no place and are left out.
    """
    schema = T.StructType([T.StructField("tile_id", T.LongType()), T.StructField("center_x", T.IntegerType()), T.StructField("center_y", T.IntegerType()), T.StructField("first_t", T.IntegerType())])

    def run(chips: pa.Table, found: pa.Table) -> pa.Table:
        rows = sorted(chips.to_pylist(), key=lambda r: r["t"])
        if not rows:
            return pa.Table.from_pylist([], schema=to_arrow_schema(schema))
        weigh = lambda r: np.round(np.tensordot(np.array([0.299, 0.587, 0.114]), _planes(r), 1))
        late, before, out = weigh(rows[-1]), rows[-2]["t"] if len(rows) > 1 else None, []
        for e in found.to_pylist():
            box = tuple(slice(max(0, e[c] - around), e[c] + around) for c in ("center_y", "center_x"))
            first = before
            for r in rows[:-1] if len(rows) > 2 else ():
                grey = weigh(r)
                alike = patch_similarity(late[box], (grey if grey.shape == late.shape else resize(grey, *late.shape))[box])
                if alike is None or alike >= limit:
                    break
                first = r["t"]
            out.append({**e, "first_t": first})
        return pa.Table.from_pylist(out, schema=to_arrow_schema(schema))

    chips = to_chips(pixels)
    places = events.where("not is_global").select("tile_id", "center_x", "center_y")
    return chips.groupBy("tile_id").cogroup(places.groupBy("tile_id")).applyInArrow(run, schema)


def dehaze(chip: np.ndarray, omega: float = 0.82, size: int = 15) -> np.ndarray:
    """Dark-channel haze removal of an (h, w, 3) chip; equal lights are taken row by row."""
    c = chip / 255.0
    dark = box_extreme(chip.min(axis=2), size, False).ravel()
    n = max(dark.size // 1000, 1)
    light = c.reshape(-1, 3)[np.argsort(-dark.astype(int), kind="stable")[:n]].mean(axis=0)
    through = np.maximum(1 - omega * box_extreme((c / (light + 1e-6)).min(axis=2), size, False), 0.1)
    return np.floor(np.clip((c - light) / through[:, :, None] + light, 0, 1) * 255).astype(np.uint8)


def enhance(chip: np.ndarray, colour: float = 1.15, contrast: float = 1.10) -> np.ndarray:
    """Colour away from luma, then contrast away from mean luma; r, g, b planes."""
    luma = lambda p: (p.astype(int) @ np.array([299, 587, 114])) // 1000
    pull = lambda p, to, by: np.floor(np.clip(to + by * (p.astype(float) - to), 0, 255)).astype(np.uint8)
    one = pull(chip, luma(chip)[:, :, None].astype(float), colour)
    return pull(one, np.floor(luma(one).mean() + 0.5), contrast)


def match_histogram(chip: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Each plane's values moved to the template's at the same quantile."""
    out = np.empty_like(chip)
    for p in range(chip.shape[2]):
        values, at, counts = np.unique(chip[:, :, p], return_inverse=True, return_counts=True)
        goal, goals = np.unique(template[:, :, p], return_counts=True)
        share = lambda c: c.cumsum() / c.sum()
        out[:, :, p] = np.interp(share(counts), share(goals), goal)[at].reshape(chip.shape[:2]).astype(np.uint8)
    return out


def standardise(chip: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Dehaze, enhance, match to the band's reference and smooth."""
    matched = match_histogram(enhance(dehaze(chip)), template)
    return np.stack([bilateral(matched[:, :, p], 5, 30, 30) for p in range(3)], axis=2)


def overlay(chip: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int], alpha: float = 0.4) -> np.ndarray:
    """The chip with a tinted mask, for reports."""
    out = chip.astype(float)
    out[mask] = (1 - alpha) * out[mask] + alpha * np.array(colour)
    return np.round(out).astype(np.uint8)


CHIP_BYTES = T.StructType([T.StructField("tile_id", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])


def standardised_chips(pixels: DataFrame, references: DataFrame, most: int = 64) -> DataFrame:
    """Cleaned chips (r, g, b rows) of every tile against its date's reference.

    ``references``: one row a date (t, data, height, width); up to ``most`` of
    them, some 2 MB each, are broadcast, and more are joined by Spark's choice.
    """
    arrow = to_arrow_schema(CHIP_BYTES)

    def one(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        chip = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        chip[y, x] = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1)
        h, w, data = (table.column(c)[0].as_py() for c in ("ref_height", "ref_width", "ref_data"))
        clean = standardise(chip, np.frombuffer(data, np.uint8).reshape(h, w, 3))
        row = {"tile_id": table.column("tile_id")[0].as_py(), "t": table.column("t")[0].as_py(), "height": chip.shape[0], "width": chip.shape[1], "data": clean.tobytes()}
        return pa.Table.from_pylist([row], schema=arrow)

    told = references.select("t", F.col("data").alias("ref_data"), F.col("height").alias("ref_height"), F.col("width").alias("ref_width"))
    told = F.broadcast(told) if references.limit(most + 1).count() <= most else told
    return pixels.select("tile_id", "t", "y", "x", "r", "g", "b").join(told, "t").groupBy("tile_id", "t").applyInArrow(one, CHIP_BYTES)


_BLOCK, _AT_ONCE = 64, 6  # pixels of a block's side, channels beside a place in a long: six bits each for y and x above six bytes


def _assembled(batches, channels: int):
    """Rows of ``CHIP_BYTES`` from blocks (tile_id, t, row, column, lists of packed pixels) in the order of tile and date."""
    arrow, key, held, out = to_arrow_schema(CHIP_BYTES), None, [], []

    def chip() -> dict:
        y = [by * _BLOCK + (p >> 54) for by, _, _, p in held]
        x = [bx * _BLOCK + (p >> 48 & 63) for _, bx, _, p in held]
        a = np.zeros((max(int(v.max()) for v in y) + 1, max(int(v.max()) for v in x) + 1, channels), np.uint8)
        for own_y, own_x, (_, _, first, p) in zip(y, x, held):
            n = min(_AT_ONCE, channels - first)
            a[own_y, own_x, first : first + n] = p.view(np.uint8).reshape(-1, 8)[:, :n]
        return {"tile_id": key[0], "t": key[1], "height": a.shape[0], "width": a.shape[1], "data": a.tobytes()}

    for batch in batches:
        lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[4:]]
        for at, (tile, t, by, bx) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
            if held and (tile, t) != key:
                out.append(chip())
                held = []
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            key = tile, t
            held += [(by, bx, i * _AT_ONCE, values[ends[at] : ends[at + 1]]) for i, (ends, values) in enumerate(lists)]
    if held:
        out.append(chip())
    yield pa.RecordBatch.from_pylist(out, schema=arrow)


def to_chips(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Chips from pixel layout, one row a tile and date; channels are interleaved.

    Pixels are gathered into blocks of 64 x 64 where they are read, one long each,
    so that blocks and not single pixels are exchanged and handed to Python. A task
    that meets some hundred blocks at once sorts its pixels; only blocks are held.
    """
    level = lambda c: F.coalesce(F.col(c).cast("long").bitwiseAND(F.lit(255)), F.lit(0))
    y, x = F.col("y").cast("int"), F.col("x").cast("int")
    place = F.shiftleft(y.bitwiseAND(F.lit(_BLOCK - 1)).cast("long"), 54).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(_BLOCK - 1)).cast("long"), 48))
    packed = [functools.reduce(lambda p, c: p.bitwiseOR(F.shiftleft(level(c[1]), 8 * c[0])), enumerate(channels[i : i + _AT_ONCE]), place).alias(f"p{i}") for i in range(0, len(channels), _AT_ONCE)]
    flat = pixels.select(F.col("tile_id").cast("long").alias("tile_id"), F.col("t").cast("int").alias("t"), F.shiftright(y, 6).alias("by"), F.shiftright(x, 6).alias("bx"), *packed)
    blocks = flat.groupBy("tile_id", "t", "by", "bx").agg(*(F.collect_list(c).alias(c) for c in flat.columns[4:]))
    n = len(channels)
    return blocks.repartition("tile_id", "t").sortWithinPartitions("tile_id", "t").mapInArrow(lambda batches: _assembled(batches, n), CHIP_BYTES)
