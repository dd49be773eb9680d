"""Best-fit packing by linear grouping, planned on the histogram of lengths.

A length is one of 1..capacity, so the histogram is at most ``capacity`` rows
whatever the corpus; only it reaches the driver. There the plan is made:

1. Lengths over ``capacity // small`` are large. Sorted downwards they are cut
   into groups of equal cardinality and rounded up to their group's largest.
2. With so few sizes, configurations are optimised: the largest size left and
   the exact best filling of the rest (bounded subset sum) are used as often as
   the groups allow.
3. Actual lengths take the places of their group, largest first, as runs.
4. Small lengths go by best fit into what is left, largest first.

The plan is a list of intervals (length, first rank, count, first sequence,
offset), bounded by the number of lengths and groups. Documents are ranked within their
length by counts of each input part, without moving texts, and look their place up.

Cases: null texts are empty and have the end mark alone; a document longer than
the capacity is cut so that the first piece is the short one; repeated rows are
packed each on its own; an empty table gives an empty table; special-token
strings in a text are encoded as the tokenizer does; input columns named as
outputs are replaced.
"""

from __future__ import annotations

import array
import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import staged, trimmed

Run = tuple[int, list[int]]  # (number of sequences, lengths in each)


def best_filling(sizes: list[int], left: list[int], space: int) -> list[int]:
    """Indices of sizes (repeats allowed up to ``left``) with the largest sum <= space."""
    last = np.full(space + 1, -1, np.int32)  # the size that reached this sum last
    used = np.zeros(space + 1, np.int32)
    reach = np.zeros(space + 1, bool)
    reach[0] = True
    for i, (size, many) in enumerate(zip(sizes, left)):
        used[:] = 0
        for _ in range(min(many, space // size if size else 0)):
            fresh = np.zeros_like(reach)
            fresh[size:] = reach[:-size]
            ok = np.zeros_like(reach)
            ok[size:] = used[:-size] < many
            fresh &= ~reach & ok
            at = np.flatnonzero(fresh)
            if not at.size:
                break
            last[at] = i
            used[at] = used[at - size] + 1
            reach[at] = True
    total = int(np.flatnonzero(reach)[-1])
    out = []
    while total:
        out.append(int(last[total]))
        total -= sizes[out[-1]]
    return out


def _large_runs(large: list[tuple[int, int]], capacity: int, groups: int) -> list[Run]:
    """Steps 1 to 3: ``large`` is (length, count), largest first."""
    n = sum(c for _, c in large)
    each = max(1, -(-n // groups))
    members: list[list[list[int]]] = [[]]  # by group: [length, count] runs
    room = each
    for length, count in large:
        while count:
            if not room:
                members.append([])
                room = each
            take = min(room, count)
            members[-1].append([length, take])
            room -= take
            count -= take
    sizes = [m[0][0] for m in members]  # rounded up to the group's largest
    left = [sum(c for _, c in m) for m in members]
    runs: list[Run] = []
    while any(left):
        lead = next(i for i, c in enumerate(left) if c)
        left[lead] -= 1
        rest = best_filling(sizes, left, capacity - sizes[lead])
        left[lead] += 1
        wanted = defaultdict(int)
        for i in [lead, *rest]:
            wanted[i] += 1
        times = min(left[i] // k for i, k in wanted.items())
        for i, k in wanted.items():
            left[i] -= k * times
        slots = []
        for i, k in wanted.items():  # substitute: the group's documents, largest first
            for _ in range(k):
                need, got = times, []
                while need:
                    run = members[i][0]
                    take = min(need, run[1])
                    got.append([run[0], take])
                    run[1] -= take
                    need -= take
                    if not run[1]:
                        members[i].pop(0)
                slots.append(got)
        while times:
            step = min(s[0][1] for s in slots)
            runs.append((step, [s[0][0] for s in slots]))
            times -= step
            for s in slots:
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
    return runs


def plan(histogram: dict[int, int], capacity: int, groups: int = 512, small: int = 3) -> list[Run]:
    """Runs of alike sequences that hold every item of the histogram."""
    lengths = sorted((length for length in histogram if histogram[length]), reverse=True)
    if any(not 0 < length <= capacity for length in lengths):
        raise ValueError("a length is outside 1..capacity")
    runs: list[Run] = [(histogram[capacity], [capacity])] if histogram.get(capacity) else []
    large = [(x, histogram[x]) for x in lengths if capacity // small < x < capacity]
    open_: dict[int, list[Run]] = defaultdict(list)
    for times, held in _large_runs(large, capacity, groups) if large else []:
        open_[capacity - sum(held)].append((times, held))
    spaces = sorted(open_)

    def put(space: int, run: Run) -> None:
        if not open_[space]:
            insort(spaces, space)
        open_[space].append(run)

    for length in (x for x in lengths if x <= capacity // small):
        count = histogram[length]
        while count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                put(capacity, (-(-count // (capacity // length)), []))
                continue
            space = spaces[at]
            times, held = open_[space].pop()
            if not open_[space]:
                spaces.pop(at)
            fit = space // length  # best fit keeps to a sequence while the length fits
            whole = min(times, count // fit)
            if whole:
                put(space - fit * length, (whole, held + [length] * fit))
                count -= whole * fit
                times -= whole
            if times and count and count < fit:
                put(space - count * length, (1, held + [length] * count))
                times, count = times - 1, 0
            if times:
                put(space, (times, held))
    return runs + [r for space in sorted(open_) for r in open_[space] if r[1]]


def intervals(runs: list[Run]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ranks ascending."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for times, held in runs:
        at = 0
        for length in held:
            out[length].append((ranks[length], sequence, at))
            ranks[length] += times
            at += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def make_encoder(tokenizer: str, ranks: str | None = None, pattern: str | None = None):
    """text -> ids as little-endian uint32 bytes, as ``tokenizer`` (a JSON file) gives.

    With ``ranks`` and ``pattern``, the same byte-level vocabulary as ranks, the
    merges run in the faster library; texts that hold a special token's string
    or odd white space, where the two libraries may differ, go to the first.
    """
    held: list = []

    def slow(text: str) -> bytes:
        if not held:  # loaded when it is needed: it takes some 100 MB
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(tokenizer))
        return array.array("I", held[0].encode(text, add_special_tokens=False).ids).tobytes()

    if ranks is None:
        return slow
    import json
    import re

    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    odd = re.compile("|".join([r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0 ᠎ -‏    ⁠　﻿]", *map(re.escape, special)]))

    def encode(text: str) -> bytes:
        return slow(text) if odd.search(text) else array.array("I", fast.encode_ordinary(text)).tobytes()

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be the short one."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


PIECES = [
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType()),
]


def pieces(docs: DataFrame, text: str, encoder: tuple, capacity: int, end_id: int, keep: list[str], keep_ids: bool) -> DataFrame:
    """One row a piece, with its rank among its length's pieces of the same input part."""
    fields = [f for f in PIECES if keep_ids or f.name != "ids"]
    kept = [c for c in keep if c not in {f.name for f in PIECES}]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    tail = array.array("I", [end_id]).tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = None
        for whole in batches:
            encode = encode or make_encoder(*encoder)
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                made: dict[str, list] = {f.name: [] for f in fields}
                source = []
                for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                    ids = encode(t or "") + tail
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = {"piece": k, "start": start, "length": length, "ids_crc32": zlib.crc32(own), "ids": own, "_part": part, "_rank": int(seen[length])}
                        seen[length] += 1
                        source.append(i)
                        for name, held in made.items():
                            held.append(row[name])
                index = pa.array(source, pa.int64())
                cols = [batch.column(batch.schema.get_field_index(c)).take(index).cast(arrow.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(made[f.name], arrow.field(f.name).type) for f in fields], schema=arrow)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(trimmed(run), schema)


def pack(docs: DataFrame, encoder: tuple, text: str = "text", capacity: int = 2048, end_id: int = 0, keep: list[str] | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    ``encoder``: the arguments of :func:`make_encoder`; the files must be at
    those paths on every worker. ``ids`` (little-endian uint32) comes along
    unless ``keep_ids`` is false.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    parts = staged(pieces(docs, text, encoder, capacity, end_id, keep, keep_ids), "pieces")
    counted = staged(parts.groupBy("length", "_part").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    table = intervals(plan(histogram, capacity))
    before = counted.select(
        F.col("length").alias("_l"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    ranked = parts.join(before, (F.col("_l") == F.col("length")) & (F.col("_p") == F.col("_part")))
    out = T.StructType([f for f in parts.schema.fields if not f.name.startswith("_")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    held = [f.name for f in out.fields[:-2]]
    arrow = to_arrow_schema(out)

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_r"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                rows, own = np.flatnonzero(length == x), table[int(x)]
                at = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                sequence[rows] = own[at, 1] + rank[rows] - own[at, 0]
                offset[rows] = own[at, 2]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in held]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.select(*held, (F.col("_rank") + F.col("_before")).alias("_r")).mapInArrow(trimmed(place), out)
