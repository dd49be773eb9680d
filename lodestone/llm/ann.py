"""Nearest neighbours by shifted Hilbert curves, with an exact check in blocks.

Vectors are projected to a few dimensions, each time by another rotation and
shift, and laid out along Hilbert curves; Spark sorts each curve by range. A
query is compared with the rows in a window around it on every curve, and the
windows merge. The tenth distance found is an upper bound of the true one.

With ``exact`` a check follows, since windows alone reach a recall of 0.9 only on
data with structure: the rows lie along the first curve, the queries go out in
blocks of ``block`` with their bounds, and a run of rows is compared only with the
queries whose distance to the run's box, in the projection, is within their bound
(projecting shortens distances, so none is lost). On vectors without structure
that is every run; the README has the share of pairs for both.

Cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; null ids neither; an id's rows are one
candidate, at its smallest distance, and never its own neighbour; ties go to the
smaller id; fewer than ``k`` candidates are all returned; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import staged

FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (dimensions x bits <= 62).

    Gray-code form: undo, plane by plane, the reflections and exchanges that a
    curve makes on its way down, then interleave the planes.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        below = (1 << plane) - 1
        for axis in range(dims):
            inverted = (x[axis] >> plane & 1).astype(bool)
            swap = np.where(inverted, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(inverted, below, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> plane & 1)
    return key


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distance in double precision, components added in order."""
    total = np.zeros(len(vectors))
    for i in range(vectors.shape[1]):
        gap = vectors[:, i] - query[i]
        total += gap * gap
    return np.sqrt(total)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest distinct ids, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, of the commonest length."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = F.col(key).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return table.where(kept).select(F.col(key).cast("long").alias("vec_id"), v.alias("vec"))


@dataclass(frozen=True)
class Curves:
    """Rotations to a few axes, shifts, and the grid that the curves run through."""

    centre: np.ndarray
    spread: float
    turns: list[tuple[np.ndarray, np.ndarray]]
    bits: int

    def places(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        turn, shift = self.turns[curve]
        top = 1 << self.bits
        cells = ((vectors - self.centre) @ turn / (8 * self.spread) + 0.25 + shift / 2) * top
        return hilbert_keys(np.clip(cells, 0, top - 1).astype(np.int64), self.bits)


def lay_out(rows: DataFrame, dim: int, curves: int = 8, axes: int = 8, bits: int = 6, seed: int = 5, sample: int = 10_000) -> Curves:
    """Curves over a grid laid by mean and spread of ``sample`` rows at most, in the order of a hash."""
    held = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toLocalIterator()], np.float64).reshape(-1, dim)
    centre, spread = (held.mean(axis=0), max(1e-12, float(held.std(axis=0).mean()))) if len(held) else (np.zeros(dim), 1.0)
    rng = np.random.default_rng(seed)
    return Curves(centre, spread, [(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : min(axes, dim)], rng.random(min(axes, dim))) for _ in range(curves)], bits)


def ordered(rows: DataFrame, laid: Curves, dim: int) -> DataFrame:
    """(vec_id, vec) along the first curve, as a written table: neighbours in a file are near in the projection."""
    schema = T.StructType([T.StructField("place", T.LongType()), *rows.select("vec_id", "vec").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [laid.places(_matrix(batch.column(1).slice(at, 4096), dim), 0) for at in range(0, batch.num_rows, 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.empty(0, np.int64)])), batch.column(0), batch.column(1)], schema=to_arrow_schema(schema))

    placed = rows.select("vec_id", "vec").mapInArrow(run, schema)
    return staged(placed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id").select("vec_id", "vec"), "ordered")


def windows(rows: DataFrame, is_query: Column, dim: int, k: int, lines: Curves, width: int = 200) -> DataFrame:
    """Each query's k nearest within ``width`` places on any of the curves; every row is put on every curve."""
    laid = T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("asks", T.BooleanType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(laid)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = _matrix(batch.column(1), dim)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dim), pa.int32()), pa.array(vectors.ravel()))
                for c in range(len(lines.turns)):
                    keys = lines.places(vectors, c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), batch.column(0), batch.column(2), flat.cast(arrow.field("vec").type)], schema=arrow)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_arrow = to_arrow_schema(FOUND)
        curve, ids, asks, vectors = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool), np.empty((0, dim))
        done = 0

        def ask(upto: int):
            out = []
            for i in np.flatnonzero(asks[done:upto]) + done:
                a, b = max(0, i - width), min(len(ids), i + width + 1)
                near = np.flatnonzero((curve[a:b] == curve[i]) & (ids[a:b] != ids[i])) + a
                score = distances(vectors[near], vectors[i])
                best = _best(ids[near], score, k)
                out.append((np.full(len(best), ids[i]), ids[near][best], score[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=found_arrow)

        for batch in batches:
            curve = np.concatenate([curve, np.asarray(batch.column(0))])
            ids = np.concatenate([ids, np.asarray(batch.column(1))])
            asks = np.concatenate([asks, batch.column(2).to_numpy(zero_copy_only=False)])
            vectors = np.concatenate([vectors, _matrix(batch.column(3), dim)])
            upto = max(done, len(ids) - width)
            yield from ask(upto)
            cut = max(0, upto - width)
            curve, ids, asks, vectors, done = curve[cut:], ids[cut:], asks[cut:], vectors[cut:], upto - cut
        yield from ask(len(ids))

    placed = rows.select("vec_id", "vec", is_query.alias("asks")).mapInArrow(lay, laid)
    return placed.repartitionByRange("curve", "place", "vec_id").sortWithinPartitions("curve", "place", "vec_id").select("curve", "vec_id", "asks", "vec").mapInArrow(slide, FOUND)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank; an id counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def check(rows: DataFrame, asked: DataFrame, dim: int, k: int, lines: Curves, run: int = 1024) -> list[DataFrame]:
    """What lies within each query's bound, run by run of rows, a block of queries at a time."""
    turn = lines.turns[0][0]
    spark, out = rows.sparkSession, []
    for shard in [r["shard"] for r in asked.select("shard").distinct().orderBy("shard").collect()]:
        part = asked.where(F.col("shard") == shard).orderBy("query_id").select("query_id", "vec", "bound").collect()  # ``search`` makes shards of about a block
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part], np.int64), np.array([r["vec"] for r in part], np.float64).reshape(-1, dim), np.array([r["bound"] for r in part])))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asks, queries, bound = sent.value
            limit = bound.copy()
            norms, flat = (queries * queries).sum(axis=1), queries @ turn
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(asks)
            for whole in batches:
                for at in range(0, whole.num_rows, run):
                    batch = whole.slice(at, run)
                    ids, vectors = np.asarray(batch.column(0)), _matrix(batch.column(1), dim)
                    own, box = (vectors * vectors).sum(axis=1), vectors @ turn
                    gap = np.maximum(0, np.maximum(box.min(axis=0) - flat, flat - box.max(axis=0)))
                    reach = np.flatnonzero((gap * gap).sum(axis=1) <= limit**2 + 1e-9 * (norms + own.max(initial=0) + 1))
                    for lo in range(0, len(reach), 512):
                        q = reach[lo : lo + 512]
                        square = norms[q, None] + own - 2 * (queries[q] @ vectors.T)
                        # rounding of the expanded square must not lose a neighbour
                        most = limit[q] ** 2 + 1e-9 * (norms[q] + own.max(initial=0) + 1)
                        rough = square <= np.where(np.isfinite(most), most, np.inf)[:, None]
                        for i, j in ((i, q[i]) for i in np.flatnonzero(rough.any(axis=1))):
                            near = np.flatnonzero(rough[i])
                            near = near[ids[near] != asks[j]]
                            if len(near) > 4 * k:  # many at once: the nearest by the rough square suffice
                                cut = np.partition(square[i, near], k)[k] if len(np.unique(ids[near])) == len(near) else np.inf
                                near = near[square[i, near] <= cut + 1e-9 * (norms[j] + own.max() + 1)]
                            if not len(near):
                                continue
                            score = distances(vectors[near], queries[j])
                            all_ids, all_scores = np.concatenate([held[j][0], ids[near]]), np.concatenate([held[j][1], score])
                            best = _best(all_ids, all_scores, k)
                            held[j] = all_ids[best], all_scores[best]
                            if len(best) == k:
                                limit[j] = min(limit[j], all_scores[best[-1]])
            for lo in range(0, len(asks), 1024):
                some = [(np.full(len(h[0]), asks[lo + j]), *h) for j, h in enumerate(held[lo : lo + 1024]) if len(h[0])]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some)], schema=to_arrow_schema(FOUND))

        out.append(rows.select("vec_id", "vec").mapInArrow(scan, FOUND))
    return out


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, block: int = 8192, exact: bool = True, width: int = 200, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id is divisible by ``every``."""
    rows = staged(usable(table, key, vector), "vectors")
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 1
    rows = rows.where(F.size("vec") == dim)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    lines = lay_out(rows, dim, **options)
    found = staged(nearest(windows(rows, is_query, dim, k, lines, width), k), "windows").select("query_id", "vec_id", "score")
    if exact:
        queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
        total = queries.count()
        bounds = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("_b")).withColumnRenamed("query_id", "_q")
        shards = max(1, -(-total // block))
        asked = queries.join(bounds, F.col("query_id") == F.col("_q"), "left").select("query_id", "vec", F.coalesce("_b", F.lit(float("inf"))).alias("bound"), F.pmod(F.xxhash64("query_id"), F.lit(shards)).alias("shard"))
        for part in check(ordered(rows, lines, dim), staged(asked, "asked"), dim, k, lines):
            found = found.unionByName(part)
    best = nearest(found, k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
