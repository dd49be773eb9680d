"""Exact n-gram Jaccard join: links at or above a similarity, as components.

1. A document's set of shingles is hashed; documents with equal sets are one
   node, so copies never meet each other.
2. Hashes go by value to reducers, which find those that two nodes or more hold.
   A node whose shared shingles are fewer than the threshold asks for cannot
   link to anything and leaves; of the others only shared shingles are kept,
   rarest first, since nothing else can be in an intersection.
3. Signature trees link most near copies: nodes in the order of a min-hash are
   taken in blocks; a block's tree holds OR-combined bitmaps and size ranges,
   and a dual traversal prunes pairs of tree nodes by the largest overlap they
   could have. Pairs already connected are skipped, so a group of near copies
   costs its number and not its square.
4. What blocks may have missed is found exactly: linked sets share a shingle in
   their rarest ``cnt - need + 1``. The members of such a bucket, by size, are the
   leaves of another tree, whose nodes hold ranges of sizes and of components and
   the most that any member can still share; its dual traversal gives the pairs
   of different components that may reach the threshold, and each is verified.

Trees over all blocks at once would be exact without step 4, but OR-combined maps
of more than some hundred sets are full, so that they rule out next to nothing.

A shingle that a chunk of nodes holds very often goes to its reducer once, with
its count, so that one found in all documents costs its reducer a row a chunk.

Cases: null, empty and blank texts have no shingles and link with nothing; with
fewer words than a shingle the whole sequence is the one shingle; repeated rows
share a component; null ids don't count as the smallest unless all are null; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words
from ._shared import drop_staged, staged, staged_so_far, trimmed

BITS = 2048  # of a signature
KEEP = 48  # bits of a shingle's hash that travel


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for row, data, offsets in _words.text_parts(column):
        hashed, at = _words.words(data, offsets)
        for i in range(len(offsets) - 1):
            yield row + i, np.unique(_words.shingles(hashed[at[i] : at[i + 1]], size) >> np.uint64(64 - KEEP))


def _node(own: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least intersection with 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def members(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n_shingles, node) of every row; equal sets have equal nodes."""
    schema = T.StructType([docs.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [(len(s), _node(s)) for _, s in _sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], schema=arrow)

    return docs.select(key, text).mapInArrow(trimmed(run), schema)


# Step 2. A chunk is some thousand nodes of one task; a segment is a range of hashes.
# A reference below MANY is a node of the chunk; others are the chunk's frequent hashes, whose nodes stay in its names.
MANY, OFTEN = 4096, 64
_SPREAD = T.StructType([T.StructField(c, t) for c, t in (("key", T.LongType()), ("chunk", T.LongType()), ("low", T.BinaryType()), ("high", T.BinaryType()), ("ref", T.BinaryType()), ("times", T.BinaryType()))])
_SHARED = T.StructType([T.StructField(c, t) for c, t in (("chunk", T.LongType()), ("hashes", T.BinaryType()), ("refs", T.BinaryType()), ("counts", T.BinaryType()), ("often", T.BinaryType()))])
_LIVE = T.StructType([T.StructField(c, t) for c, t in (("node", T.LongType()), ("n", T.LongType()), ("prefix", T.IntegerType()), ("live", T.BinaryType()))])


def _table(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    arrow = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def live_sets(docs: DataFrame, text: str, size: int, percent: int, bits: int) -> DataFrame:
    """(node, n, prefix, live) of every node that could link: its shared hashes, rarest first."""

    def spread(batches):
        from pyspark import TaskContext

        chunk = (TaskContext.get().partitionId() + 1) << 24
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []

        def flush():
            hashes = np.concatenate([s for _, s in held])
            refs = np.repeat(np.arange(len(held), dtype=np.uint16), [len(s) for _, s in held])
            order = np.argsort(hashes, kind="stable")
            hashes, refs = hashes[order], refs[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            times = np.diff(np.append(first, len(hashes)))
            often = np.flatnonzero(times >= OFTEN)
            names = [(int(times[i]), refs[first[i] : first[i] + times[i]].copy()) for i in often]
            alone = np.repeat(times < OFTEN, times)
            alone[first[often]] = True
            refs[first[often]] = MANY + np.arange(len(often), dtype=np.uint16)
            hashes, refs = hashes[alone], refs[alone]
            nodes = np.array([(x, len(s)) for x, s in held], np.int64)
            listed = np.array([n for n, _ in names], np.uint32).tobytes(), b"".join(r.tobytes() for _, r in names)
            yield (-chunk, chunk, np.ascontiguousarray(nodes[:, 0]).tobytes(), np.ascontiguousarray(nodes[:, 1]).tobytes(), listed[0], listed[1])
            rest = hashes & np.uint64((1 << (KEEP - bits)) - 1)
            where, at = np.unique(hashes >> np.uint64(KEEP - bits), return_index=True)
            for k, a, b in zip(where.tolist(), at, [*at[1:], len(hashes)]):
                own = refs[a:b]
                many = np.array([names[i - MANY][0] for i in own[own >= MANY]], np.uint32)
                yield (k, chunk, rest[a:b].astype(np.uint32).tobytes(), (rest[a:b] >> np.uint64(32)).astype(np.uint16).tobytes(), own.tobytes(), many.tobytes())

        def send():
            out, room = [], 0
            for row in flush():
                out.append(row)
                room += len(row[2]) * 2
                if room > 2 << 20:
                    yield from _table(_SPREAD, out).to_batches()
                    out, room = [], 0
            if out:
                yield from _table(_SPREAD, out).to_batches()

        total = 0
        for batch in batches:
            for _, own in _sets(batch.column(0), size):
                node = _node(own)
                if node is None or node in seen:
                    continue
                if len(seen) < 200_000:  # only spares work: later stages drop repeats
                    seen.add(node)
                held.append((node, own))
                total += len(own)
                if len(held) >= MANY or total >= 1_000_000:
                    yield from send()
                    held.clear()
                    total, chunk = 0, chunk + 1
        if held:
            yield from send()

    def shared(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["key"] < 0:
            return _table(_SHARED, [(r["chunk"], r["low"], r["high"], r["ref"], r["times"]) for r in rows])
        low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows]).astype(np.uint64)
        high = np.concatenate([np.frombuffer(r["high"], np.uint16) for r in rows]).astype(np.uint64)
        refs = np.concatenate([np.frombuffer(r["ref"], np.uint16) for r in rows])
        place = np.repeat(np.arange(len(rows)), [len(r["ref"]) // 2 for r in rows])
        hashes = low | high << np.uint64(32) | np.uint64(rows[0]["key"]) << np.uint64(KEEP - bits)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        weight = np.ones(len(refs), np.int64)
        weight[refs >= MANY] = np.concatenate([np.frombuffer(r["times"], np.uint32) for r in rows])
        counts = np.repeat(np.add.reduceat(weight[order], starts), np.diff(np.append(starts, len(hashes))))
        many = counts > 1
        hashes, counts, order = hashes[many], counts[many], order[many]
        refs, place = refs[order], place[order]
        by = np.argsort(place, kind="stable")
        hashes, counts, refs, place = hashes[by], np.minimum(counts[by], 0xFFFFFFFF).astype(np.uint32), refs[by], place[by]
        cut = np.searchsorted(place, np.arange(len(rows) + 1))
        return _table(_SHARED, [(r["chunk"], hashes[a:b].tobytes(), refs[a:b].tobytes(), counts[a:b].tobytes(), None) for r, a, b in zip(rows, cut, cut[1:]) if a < b])

    def living(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = next(r for r in rows if r["often"] is not None)
        nodes, sizes = np.frombuffer(names["hashes"], np.int64), np.frombuffer(names["refs"], np.int64)
        times, among = np.frombuffer(names["counts"], np.uint32).astype(np.int64), np.frombuffer(names["often"], np.uint16)
        rows = [r for r in rows if r["often"] is None]
        if not rows:
            return _table(_LIVE, [])
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        refs = np.concatenate([np.frombuffer(r["refs"], np.uint16) for r in rows])
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
        if len(times):  # frequent hashes back to the nodes that hold them
            group = refs >= MANY
            which = refs[group].astype(np.int64) - MANY
            begin = np.cumsum(times) - times
            places = np.concatenate([among[begin[i] : begin[i] + times[i]] for i in which] or [among[:0]])
            hashes = np.concatenate([hashes[~group], np.repeat(hashes[group], times[which])])
            counts = np.concatenate([counts[~group], np.repeat(counts[group], times[which])])
            refs = np.concatenate([refs[~group], places])
        have = np.bincount(refs, minlength=len(nodes))
        need = -(-percent * sizes // 100)
        keep = (have >= need)[refs]
        hashes, refs, counts = hashes[keep], refs[keep], counts[keep]
        order = np.lexsort((hashes, counts, refs))
        hashes, refs = hashes[order], refs[order]
        cut = np.searchsorted(refs, np.arange(len(nodes) + 1))
        return _table(_LIVE, [(int(nodes[i]), int(sizes[i]), int(have[i] - need[i] + 1), hashes[cut[i] : cut[i + 1]].tobytes()) for i in np.flatnonzero(have >= need)])

    return docs.select(text).mapInArrow(trimmed(spread), _SPREAD).groupBy("key").applyInArrow(shared, _SHARED).groupBy("chunk").applyInArrow(living, _LIVE).dropDuplicates(["node"])


class SignatureTree:
    """Levels of OR-combined bitmaps, size ranges and slack over one block of sets."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], fan: int = 4):
        bitmap = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            bitmap[i, s & np.uint64(BITS - 1)] = True
        live = np.array([len(s) for s in sets])
        slack = live - bitmap.sum(axis=1)  # shingles beyond one a bit
        self.fan = fan
        self.levels = [(np.packbits(bitmap, axis=1).view(np.uint64), sizes, sizes, slack, live)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack, live = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.maximum.reduceat(live, at)))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that no pair of tree nodes above them could rule out."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, low, high, slack, live = self.levels[depth]
            if depth < len(self.levels) - 1:
                step = np.arange(self.fan)
                a, b = np.repeat(a * self.fan, self.fan**2), np.repeat(b * self.fan, self.fan**2)
                tile = len(a) // self.fan**2
                a, b = a + np.tile(np.repeat(step, self.fan), tile), b + np.tile(np.tile(step, self.fan), tile)
                ok = (a <= b) & (b < len(low))
                a, b = a[ok], b[ok]
            ok = np.empty(len(a), bool)
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
                most = np.minimum(common + np.minimum(slack[x], slack[y]), np.minimum(live[x], live[y]))
                least = np.maximum(low[x], low[y])
                ok[at : at + (1 << 15)] = (100 * np.minimum(high[x], high[y]) >= percent * least) & (most >= needed(low[x], low[y], percent)) | ((x == y) & (depth > 0))
            a, b = a[ok], b[ok]
        return a[a < b], b[a < b]


def _linked(n: int, s: np.ndarray, m: int, t: np.ndarray, percent: int) -> bool:
    o = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * o >= percent * (n + m - o)


def link_block(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the block's components, and each set's component."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(*(x.tolist() for x in SignatureTree(sizes, sets).pairs(percent))):
        x, y = find(i), find(j)
        if x != y and _linked(int(sizes[i]), sets[i], int(sizes[j]), sets[j], percent):
            root[max(x, y)] = min(x, y)
            links.append((min(x, y), i, j))
    return [(i, j) for _, i, j in links], np.array([find(i) for i in range(len(sets))])


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def block_links(live: DataFrame, percent: int, salt: int, block: int = 512) -> DataFrame:
    """Step 3 for one order of the nodes: by the min-hash of their live sets."""

    def keyed(batches):
        arrow = to_arrow_schema(T.StructType([T.StructField("order", T.LongType()), *_LIVE.fields]))
        for batch in batches:
            keys = [int(_words.mix(np.frombuffer(x.as_buffer(), np.uint64) + np.uint64(salt)).min()) - (1 << 63) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns], schema=arrow)

    def run(batches):
        held: list[tuple[int, int, int, np.ndarray]] = []

        def close(rows):
            sets = [r[3] for r in rows]
            links, comps = link_block(np.array([r[2] for r in rows], np.int64), sets, percent)
            # the next block goes on from one node of each component of the last min-hash
            last = [i for i in np.unique(comps, return_index=True)[1] if rows[i][0] == rows[-1][0]]
            return _table(_LINKS, [(rows[i][1], rows[j][1]) for i, j in links]).to_batches(), [rows[i] for i in last[-64:]]

        for batch in batches:
            for order, node, n, live_ in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("order", "node", "n", "live"))):
                held.append((order.as_py(), node.as_py(), n.as_py(), np.sort(np.frombuffer(live_.as_buffer(), np.uint64))))
                if len(held) >= block:
                    out, held = close(held)
                    yield from out
        if len(held) > 1:
            yield from close(held)[0]

    schema = T.StructType([T.StructField("order", T.LongType()), *_LIVE.fields])
    return live.mapInArrow(keyed, schema).repartitionByRange("order", "node").sortWithinPartitions("order", "node").mapInArrow(trimmed(run), _LINKS)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it reaches.

    Each round takes the neighbours' smallest label, hooks the owner of the label
    before to it and then takes the label's label, written out each time, until no
    label changes. Hooked owners carry their whole group along, so that rounds
    grow with the log of a path; labels only fall, so that they end.
    """
    spark, mark = links.sparkSession, staged_so_far()
    both = staged(links.where("a <> b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        told = staged(labels.join(near, "node").select("node", "label", "near"), "labels")
        hook = told.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        low = staged(told.join(hook, "node", "left").select("node", F.least("label", "near", "hook").alias("label"), F.col("label").alias("was")), "labels")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = staged(low.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label"), "was"), "labels")
        done = not labels.where("label <> was").limit(1).count()
        drop_staged(spark, mark + (0 if done else 1), 1)  # what this round read; the edges stay until the last
        labels = labels.select("node", "label")
        if done:
            return labels


def bucket_tree_pairs(n: np.ndarray, left: np.ndarray, label: np.ndarray, percent: int, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's members, ascending by size, of different labels and with enough left to share.

    Members are a tree's leaves; a pair of its nodes is dropped when the largest of
    one cannot match the smallest of the other, when less is left than the smallest
    pair among them needs, or when all below have one label.
    """
    levels = [(n, n, left, label, label)]
    while len(levels[-1][0]) > 1:
        low, high, most, first, last = levels[-1]
        at = np.arange(0, len(low), fan)
        levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
    out, step = [], np.arange(fan)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:  # depth first, a bounded number of node pairs at a time
        depth, a, b = todo.pop()
        low, high, most, first, last = levels[depth]
        ok = (a <= b) if depth else (a < b)
        ok &= 100 * np.minimum(high[a], high[b]) >= percent * np.maximum(low[a], low[b])
        ok &= np.minimum(most[a], most[b]) >= needed(low[a], low[b], percent)
        ok &= (np.minimum(first[a], first[b]) != np.maximum(last[a], last[b]))
        a, b = a[ok], b[ok]
        if not depth:
            out.append((a, b))
            continue
        for at in range(0, len(a), 1 << 12):
            x = (a[at : at + (1 << 12), None, None] * fan + step[None, :, None]) + np.zeros(fan, np.int64)
            y = (b[at : at + (1 << 12), None, None] * fan + step[None, None, :]) + np.zeros((fan, 1), np.int64)
            x, y = x.ravel(), y.ravel()
            ok = (x <= y) & (y < len(levels[depth - 1][0]))
            todo.append((depth - 1, x[ok], y[ok]))
    return tuple(np.concatenate([p[k] for p in out] or [np.empty(0, np.int64)]) for k in (0, 1))


def bucket_pairs(live: DataFrame, labels: DataFrame, percent: int, bits: int) -> DataFrame:
    """Step 4: pairs of nodes of different components that share a prefix shingle and may link."""
    told = live.join(labels, "node", "left").select("node", "n", "prefix", "live", F.coalesce("label", "node").alias("label"))
    spread = T.StructType([T.StructField(c, t) for c, t in (("key", T.LongType()), ("hash", T.LongType()), ("node", T.LongType()), ("label", T.LongType()), ("n", T.LongType()), ("left", T.LongType()))])
    arrow = to_arrow_schema(spread)

    def tokens(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                node, n, prefix, sets, label = (batch.column(i) for i in range(5))
                all_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]
                many = np.asarray(prefix)
                hashes = np.concatenate([s[:p] for s, p in zip(all_, many)])
                left = np.concatenate([len(s) - np.arange(p, dtype=np.int64) for s, p in zip(all_, many)])
                row = np.repeat(np.arange(len(many)), many)
                cols = [(hashes >> np.uint64(KEEP - bits)).astype(np.int64), hashes.astype(np.int64), *(np.asarray(c)[row] for c in (node, label, n)), left]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=arrow)

    def meet(table: pa.Table) -> pa.Table:
        h, node, label, n, left = (table.column(c).to_numpy() for c in ("hash", "node", "label", "n", "left"))
        order = np.lexsort((label, n, h))
        h, node, label, n, left = (x[order] for x in (h, node, label, n, left))
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(starts[1:], len(h))
        mixed = np.maximum.reduceat(label, starts) != np.minimum.reduceat(label, starts)
        found = []
        for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            i, j = bucket_tree_pairs(n[a:b], left[a:b], label[a:b], percent)
            if len(i):
                found.append(np.stack([np.minimum(node[a + i], node[a + j]), np.maximum(node[a + i], node[a + j])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=to_arrow_schema(_LINKS))

    return told.mapInArrow(tokens, spread).groupBy("key").applyInArrow(meet, _LINKS).distinct()


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by exact intersection of their sets."""

    def run(batches):
        for batch in batches:
            a, b, n, s, m, t = (batch.column(i) for i in range(6))
            ok = [_linked(n[i].as_py(), np.frombuffer(s[i].as_buffer(), np.uint64), m[i].as_py(), np.frombuffer(t[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], schema=to_arrow_schema(_LINKS))

    left = live.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("live").alias("s_a"))
    right = live.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("live").alias("s_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, _LINKS)


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, salts: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``."""
    rows = staged(members(docs, key, text, size), "members")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(total / 400_000 + 1)))
    live = staged(live_sets(docs, text, size, percent, bits), "live")
    links = None
    for salt in salts:
        made = block_links(live, percent, salt * 0x9E3779B97F4A7C1)
        links = made if links is None else links.unionByName(made)
    near = components(links)
    late = staged(verified(staged(bucket_pairs(live, near, percent, max(4, bits - 3)), "pairs"), live, percent), "late")
    sides = late
    for end in ("a", "b"):  # late links join components, not nodes
        sides = sides.join(near.select(F.col("node").alias(end), F.col("label").alias(f"l_{end}")), end, "left").withColumn(f"l_{end}", F.coalesce(f"l_{end}", end))
    above = components(sides.select(F.col("l_a").alias("a"), F.col("l_b").alias("b")))
    firsts = rows.where("node is not null").groupBy("node").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    label = F.coalesce("top", "label", "node")
    grouped = firsts.join(near, "node", "left").join(above.select(F.col("node").alias("_l"), F.col("label").alias("top")), F.coalesce("label", "node") == F.col("_l"), "left").select("node", "first", "copies", label.alias("group"))
    grouped = staged(grouped, "grouped")
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"), F.sum("copies").alias("size"))
    known = staged(grouped.join(least, "group").where("size > 1").select(F.col("node").alias("_n"), "component_id"), "known")
    return rows.join(known, F.col("node") == F.col("_n"), "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
