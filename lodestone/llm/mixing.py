"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources are alike for the flow, so they
are added up by pattern first and only patterns (``max_patterns`` at most) reach
the driver. From each pattern run arcs of its size, one for each repetition, at
growing cost; sources draw up to their targets. The flow of most words at the
least cost gives the words each pattern provides. Where every pattern is one
source, that flow is each source's target; beyond ``max_patterns`` sources it is
computed as such, in tables alone. Overlapping patterns beyond it are an error.

A pattern's words become copies of documents: every document as many whole times
as fit, then once more those first in a seeded order. The order is a number of
60 bits: 36 of a hash of the whole row, then 24 that tell equal rows apart. The
place in it where the words run out is found twelve bits at a time, by sums over
the rows that share the bits so far, so that no source is sorted or sent anywhere.

Cases: documents without a pattern (null or empty membership) are a pattern of
their own only if ``members`` says so; null sizes count 0; size 0 takes 0 words;
repeated rows are documents of their own, and ids need not be unique: the result
is the same for rows in any order; an empty table gives an empty table; outputs
replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._shared import staged

_BLANK = r"\x20\x09-\x0D"


def with_words(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """Adds the number of runs of anything but ASCII white space (null: 0)."""
    marks = F.regexp_replace(F.col(text), f"[{_BLANK}]*+[^{_BLANK}]++[{_BLANK}]*+", "x")
    return docs.withColumn(out, F.coalesce(F.when(F.col(text).rlike(f"[^{_BLANK}]"), F.length(marks)), F.lit(0)).cast("long"))


def level_of(total: float, limit: float, rows: list[tuple[float, float]] | DataFrame) -> float:
    """The words for each unit of weight, where nothing takes over ``limit`` times its size.

    ``rows``: (size, weight) pairs, or a table with columns ``n`` and ``weight``.
    """
    level = 0.0
    while True:
        if isinstance(rows, list):
            capped = sum(limit * n for n, w in rows if level * w > limit * n)
            weight = sum(w for n, w in rows if level * w <= limit * n)
        else:
            over = F.col("weight") * F.lit(level) > F.col("n") * F.lit(float(limit))
            capped, weight = (x or 0 for x in rows.agg(F.sum(F.when(over, F.col("n") * F.lit(float(limit)))), F.sum(F.when(~over, F.col("weight")))).first())
        above = (total - capped) / weight if weight else level
        if above <= level:
            return level
        level = above


def share(sizes: dict, weights: dict, total: float, limit: float) -> dict:
    """``total`` by weight, no key above ``limit`` times its size, the excess reshared."""
    level = level_of(total, limit, [(n, weights[k]) for k, n in sizes.items()])
    return {k: float(min(limit * n, level * weights[k])) for k, n in sizes.items()}


def min_cost_flow(patterns: dict, members: dict, targets: dict, repeats: int = 2) -> dict:
    """{pattern: {source: words}}: patterns' sizes in integers, targets of sources.

    Arcs start -> pattern, one for each repetition k at a cost that grows with k;
    pattern -> each of its sources; source -> end, up to its target. Only the first
    arcs cost anything and all patterns' k-th arcs cost the same, so the cheapest
    augmenting paths come in the order of k: arcs are opened one repetition after
    another, and each time the flow is raised as far as it goes, along shortest
    paths by layers.
    """
    source_at = {q: 2 + len(patterns) + i for i, q in enumerate(targets)}
    head: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(targets))]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    drawn, opened = {}, []
    for i, (p, size) in enumerate(patterns.items()):
        opened.append((arc(0, 2 + i, 0), int(size)))
        for q in members[p]:
            drawn[p, q] = arc(2 + i, source_at[q], int(size) * repeats)
    for q, t in targets.items():
        arc(source_at[q], 1, round(t))

    def layers() -> list[int]:
        far, queue = [-1] * len(head), [0]
        far[0] = 0
        for x in queue:
            for e in head[x]:
                if room[e] and far[to[e]] < 0:
                    far[to[e]] = far[x] + 1
                    queue.append(to[e])
        return far

    for _ in range(repeats):
        for e, size in opened:
            room[e] += size
        while (far := layers())[1] >= 0:
            left, path, x = [0] * len(head), [], 0
            while True:
                if x == 1:
                    step = min(room[e] for e in path)
                    for e in path:
                        room[e] -= step
                        room[e ^ 1] += step
                    first = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[first] ^ 1]
                    del path[first:]
                    continue
                own = head[x]
                while left[x] < len(own) and not (room[own[left[x]]] and far[to[own[left[x]]]] == far[x] + 1):
                    left[x] += 1
                if left[x] < len(own):
                    path.append(own[left[x]])
                    x = to[own[left[x]]]
                elif x:
                    e = path.pop()
                    x = to[e ^ 1]
                    left[x] += 1
                else:
                    break
    flow: dict = defaultdict(dict)
    for (p, q), e in drawn.items():
        flow[p][q] = room[e ^ 1]
    return flow


_PLAN = T.StructType([T.StructField("_q", T.StringType()), T.StructField("_whole", T.IntegerType()), T.StructField("_rest", T.LongType())])


def _held(docs: DataFrame, pattern: Column, size: str, seed: int, keep: list[str], identity: list[str] | None) -> DataFrame:
    """The kept columns with pattern, words and place in the order, written once."""
    if identity is None:
        identity = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row, own = F.xxhash64(F.lit(seed), *identity), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    order = F.shiftleft(F.shiftrightunsigned(row, 28), 24) + F.shiftrightunsigned(own, 40)
    return staged(docs.select(*keep, pattern.alias("_pattern"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_words"), order.alias("_order")), "mix")


def _placed(held: DataFrame, plan: DataFrame, keep: list[str], repeats: int, few: bool) -> DataFrame:
    """Rows with copies and taken. ``plan``: ``_PLAN`` and what else rows are to have, one row a pattern.

    ``few``: the plan has been counted and has ``max_patterns`` rows at most, so it may be broadcast.
    """
    sent = F.broadcast if few else lambda df: df
    same = F.col("_pattern").eqNullSafe(F.col("_q"))
    edge = plan.select("_q", "_rest", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"), F.lit(0).cast("long").alias("_n")).where("_rest > 0")
    for low in range(48, -1, -12):  # the bits below those that this round adds
        digit = F.shiftrightunsigned("_order", low)
        near = held.select("_pattern", "_words", "_order").join(sent(edge), same & (F.shiftrightunsigned("_order", low + 12) == F.col("_prefix")))
        sums = near.groupBy("_q", "_rest", "_before", digit.alias("_digit")).agg(F.sum("_words").alias("_n"))  # 4,096 rows a pattern at most
        run = F.sum("_n").over(W.partitionBy("_q").orderBy("_digit").rowsBetween(W.unboundedPreceding, -1))
        at = sums.withColumn("_upto", F.col("_before") + F.coalesce(run, F.lit(0))).where("_upto < _rest and _upto + _n >= _rest")
        edge = staged(at.select("_q", "_rest", F.col("_digit").alias("_prefix"), F.col("_upto").alias("_before"), "_n"), "edge")
    # the row that the words run out in is taken if at least half of it is wanted
    last = edge.select(F.col("_q").alias("_e"), F.when(F.col("_before") + F.col("_n") / 2 <= F.col("_rest"), F.col("_prefix")).otherwise(F.col("_prefix") - 1).alias("_last"))
    full = plan.join(last, F.col("_q").eqNullSafe(F.col("_e")), "left")
    copies = F.least(F.col("_whole") + F.when(F.col("_order") <= F.coalesce("_last", F.lit(-1)), 1).otherwise(0), F.lit(repeats)).cast("int")
    also = [c for c in plan.columns if not c.startswith("_")]
    kept = [F.col(c) for c in keep if c not in ("copies", "taken", *also)]
    return held.join(sent(full), same).select(*kept, *also, copies.alias("copies"), (copies * F.col("_words")).cast("long").alias("taken"))


def mix(docs: DataFrame, pattern: Column, members, targets, size: str = "size", repeats: int = 2, seed: int = 17, max_patterns: int = 20_000, keep: list[str] | None = None, identity: list[str] | None = None) -> DataFrame:
    """``docs`` with ``copies`` and ``taken`` = copies x size.

    ``pattern``: a string naming the set of sources of a row. ``members`` maps a
    pattern to its sources, ``targets`` maps {pattern: words} to {source: words}.
    ``identity``: the columns whose hash orders rows (all).
    """
    keep = docs.columns if keep is None else keep
    held = _held(docs, pattern, size, seed, keep, identity)
    sums = held.groupBy("_pattern").agg(F.sum("_words").alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of membership")
    sizes = {r["_pattern"]: r["n"] for r in sums}
    return _placed(held, _flow_plan(held, sizes, members, targets(sizes), repeats), keep, repeats, True)


def _flow_plan(held: DataFrame, sizes: dict, members, targets: dict, repeats: int) -> DataFrame:
    flow = min_cost_flow(sizes, {p: members(p) for p in sizes}, targets, repeats)
    given = {p: sum(flow[p].values()) if p in flow else 0 for p in sizes}
    return held.sparkSession.createDataFrame([(p, given[p] // n if n else 1, given[p] % n if n else 0) for p, n in sizes.items()], _PLAN)


def cycled(sources: list, weights: tuple[int, ...] = (3, 1, 2)) -> dict:
    """Weights in turn to the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def _tabled_plan(sums: DataFrame, weights: tuple[int, ...], ratio: float, limit: int) -> DataFrame:
    """The plan for patterns of one source each, without sending them anywhere."""
    order = [F.col("_pattern").isNull(), F.col("_pattern")]
    part = sums.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    part = staged(part, "sources")
    first = part.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_first"))  # one row a part
    turn = F.pmod(F.col("_i") + F.col("_first"), F.lit(len(weights))).cast("int")
    rows = staged(part.join(first, "_p").select("_pattern", "n", F.get(F.array(*map(F.lit, weights)), turn).cast("double").alias("weight")), "sources")
    level = level_of(ratio * (rows.agg(F.sum("n")).first()[0] or 0), limit, rows)
    target = F.least(F.col("n") * F.lit(float(limit)), F.col("weight") * F.lit(level))
    given = F.round(target).cast("long")
    whole, rest = F.when(F.col("n") > 0, F.floor(given / F.col("n"))).otherwise(1), F.when(F.col("n") > 0, F.pmod(given, F.col("n"))).otherwise(0)
    return rows.select(F.col("_pattern").alias("_q"), whole.cast("int").alias("_whole"), rest.cast("long").alias("_rest"), F.col("n").alias("source_size"), target.alias("target"))


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", ratio: float = 1.5, limit: int = 2, keep: list[str] | None = None, seed: int = 17, weights: tuple[int, ...] = (3, 1, 2), max_patterns: int = 20_000) -> DataFrame:
    """All documents by their source: the columns of ``keep`` (all but the text)
    with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    own = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in own]
    named = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    held = _held(with_words(docs, text, "_size"), F.col(source), "_size", seed, keep, named)
    sums = staged(held.groupBy("_pattern").agg(F.sum("_words").alias("n")), "sums")
    few = {r["_pattern"]: r["n"] for r in sums.limit(max_patterns + 1).collect()}
    if len(few) > max_patterns:
        plan = _tabled_plan(sums, weights, ratio, limit)
    else:
        targets = share(few, cycled(list(few), weights), ratio * sum(few.values()), limit)
        facts = held.sparkSession.createDataFrame([(s, n, targets[s]) for s, n in few.items()], "_s string, source_size long, target double")
        plan = _flow_plan(held, few, lambda p: [p], targets, limit)
        plan = plan.join(facts, F.col("_q").eqNullSafe(F.col("_s"))).drop("_s")
    placed = _placed(held.withColumn("size", F.col("_words")), plan, [*keep, "size"], limit, len(few) <= max_patterns)
    return placed.select(*keep, *own)
