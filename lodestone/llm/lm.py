"""Language-model scoring from a log-frequency Bloom filter.

Counting: words (A-Z lowered) and one end mark a text; unigrams and bigrams are
counted by hash, first within a chunk of a million tokens, then by ranges of
hashes. A count is quantised downwards to one of ``STEPS`` (every count up to 8,
then four steps an octave), and the n-gram is put into its range's Bloom filter
once for each step up to its own, so a reader probes step after step until one is
missing. The first step takes so many probes that all false members together
hold less than 1/128 of a count after any context; filters grow with what they hold.

Scoring: P(w | v) = (q(v, w) + k * P(w)) / (c(v) + k), with the quantised bigram
count q from repeated probes, the exact total c(v) of the context, and
P(w) = (q(w) + 0.5) / (Q + 0.5 * (V + 1)). As q is at most the count, the mass
after a context is at most 1, but for one member in some thousands that a filter
holds a step too high; it falls short by what quantising took (16 % of counts over
8 at most, nothing of others). k is set so that the share of mass
given to P is, over the training tokens, the share of tokens whose bigram is new,
by Good and Turing. The exact unigram score beside it looks words up in the counts.

A chunk sends its distinct words and bigrams once to the ranges, with their counts
in training rows; a range adds the counts up, fills its filter, probes it for each
chunk and answers. No filter has to be sent anywhere, so none is bounded. ``train``
keeps the filters as a table, against which ``score`` reads other texts.

Cases: null and empty texts hold the end mark alone; words of any length count;
repeated rows score alike; without training rows every count is 0; an empty
table gives an empty table; extra columns are ignored; keys of any type are kept.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words
from ._shared import staged, trimmed

END = np.uint64(0x1B873593CC9E2D51)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_PAIR_BITS = 48  # of a bigram's hash, below the bits that name its range
MORE_PROBES = 6  # for a step above the first: only members are asked for it
_BLOCK = 1 << 18  # bits of a filter's block

#: What counts are quantised to.
STEPS = np.unique(np.concatenate([np.arange(1, 9), np.ceil(8 * 2 ** (np.arange(1, 4 * 58) / 4))]).astype(np.int64))
_FLOOR = np.concatenate([[0], STEPS])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the documents with each one's end mark, and the documents' bounds."""
    hashed, at = _words.words(data, offsets)
    bounds = at + np.arange(len(at))
    out = np.empty(bounds[-1], np.uint64)
    ends = bounds[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = hashed
    out[ends] = END
    return out, bounds


def bigrams(token: np.ndarray) -> np.ndarray:
    """Each token with the one before; a text begins after an end mark."""
    before = np.empty_like(token)
    if len(token):
        before[0] = END
        before[1:] = token[:-1]
    return _words.mix(before * _PAIR + token)


def level(counts: np.ndarray) -> np.ndarray:
    """Number of the largest step that is no larger than the count; 0 for 0."""
    return np.searchsorted(STEPS, counts, "right")


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The step of each level; 0 stays 0."""
    return _FLOOR[levels].astype(np.float64)


@dataclass(frozen=True)
class BloomCounts:
    """One range's filter: n-grams by level.

    Hashes are 64 bits without the bits that name the range. Their first bits name
    a block of the filter, so that ascending hashes are probed block after block.
    """

    bits: np.ndarray  # one byte a bit while it is in use
    probes: int  # of the first level

    def _walk(self, hashes: np.ndarray, lev: int) -> tuple[np.ndarray, ...]:
        """First place, step and block of each hash for double hashing."""
        block = min(len(self.bits), _BLOCK)
        x = _words.mix(hashes + np.uint64(lev * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        many = len(self.bits) // block
        base = (hashes >> np.uint64(65 - many.bit_length())) * np.uint64(block) if many > 1 else np.zeros(len(hashes), np.uint64)
        return x, _words.mix(x) | np.uint64(1), base

    def _times(self, lev: int) -> int:
        return self.probes if lev == 1 else MORE_PROBES

    @classmethod
    def of(cls, grams: list[tuple[np.ndarray, np.ndarray]], vocabulary: int) -> BloomCounts:
        """The filter of (ascending hashes, counts); at most a quarter of its bits is set."""
        probes = math.ceil((math.log2(max(2, vocabulary)) + 7) / 2)
        levels = [level(times) for _, times in grams]
        entries = sum(probes * int((lev > 0).sum()) + MORE_PROBES * int(np.maximum(lev - 1, 0).sum()) for lev in levels)
        made = cls(np.zeros(1 << max(6, math.ceil(math.log2(max(1, entries / -math.log(0.75))))), bool), probes)
        mask = np.uint64(min(len(made.bits), _BLOCK) - 1)
        for (value, _), lev in zip(grams, levels):
            for j in range(1, int(lev.max(initial=0)) + 1):
                x, step, base = made._walk(value[lev >= j], j)
                for _ in range(made._times(j)):
                    made.bits[(base | x & mask).astype(np.int64)] = True
                    x += step
        return made

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash: 0 if it isn't held."""
        out, mask = np.zeros(len(hashes), np.uint8), np.uint64(min(len(self.bits), _BLOCK) - 1)
        active, lev = np.arange(len(hashes)), 1
        while len(active) and lev <= len(STEPS):
            x, step, base = self._walk(hashes[active], lev)
            for _ in range(self._times(lev)):
                ok = self.bits[(base | x & mask).astype(np.int64)]
                if not ok.all():
                    active, x, step, base = active[ok], x[ok], step[ok], base[ok]
                x = x + step
            out[active] = lev
            lev += 1
        return out

    def packed(self) -> bytes:
        return bytes([self.probes]) + np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> BloomCounts:
        return cls(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1)).astype(bool), raw[0])


@dataclass(frozen=True)
class Model:
    ranges: int  # log2 of the number of ranges
    train_tokens: int
    vocabulary: int
    held: int  # sum of the words' quantised counts
    new: float  # share of tokens whose bigram is expected to be new
    strength: float  # k

    def word(self, levels: np.ndarray) -> np.ndarray:
        return (counts_of(levels) + 0.5) / (self.held + 0.5 * (self.vocabulary + 1))

    def after(self, pair_levels: np.ndarray, context: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Probability of words after contexts that occur ``context`` times."""
        return (np.minimum(counts_of(pair_levels), context) + self.strength * self.word(levels)) / (context + self.strength)


def _strength(by_level: np.ndarray, new: float) -> float:
    """k with the mean of k / (c + k) over all training tokens equal to ``new``."""
    c, low, high = counts_of(np.arange(len(by_level))), 1e-3, 1e9
    total = by_level.sum()
    for _ in range(80):
        k = math.sqrt(low * high)
        low, high = (k, high) if (by_level * k / (c + k)).sum() < new * total else (low, k)
    return low


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in fields.items()])


def _rows(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    arrow = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _planes(values: np.ndarray, n: int) -> bytes:
    """The n low bytes, each in a row of its own: a row of small numbers compresses."""
    return b"".join((values >> values.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(n))


def _unplaned(raw, n: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1).astype(np.uint64)
    return sum((rows[i] << np.uint64(8 * i) for i in range(1, n)), rows[0])


def _pack(hashes: np.ndarray, n: int) -> bytes:
    """Ascending hashes of n bytes by their differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)), n)


def _unpack(raw, n: int) -> np.ndarray:
    return np.cumsum(_unplaned(raw, n), dtype=np.uint64)


_L, _B = T.LongType(), T.BinaryType()
#: Of a chunk and a range: distinct words and bigrams with their training counts. A chunk's head has key -1.
_SENT = _schema(key=_L, chunk=_L, words=_B, counts=_B, pairs=_B, pair_counts=_B, head=_B)
#: The answer: exact counts of words, levels of both. A range adds a row of sums and, if it is kept, its words, counts and filter.
_TOLD = _schema(key=_L, chunk=_L, words=_B, counts=_B, levels=_B, pair_levels=_B, head=_B, sums=T.ArrayType(_L))
SCORED = [T.StructField("n_tokens", _L), T.StructField("n_known", _L), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def _send(docs: DataFrame, key: str, text: str, training: Column, bits: int, heads: bool, chunk_rows: int = 32768, chunk_tokens: int = 1_000_000) -> DataFrame:
    """Rows of ``_SENT`` for all documents: the chunks' heads, or their parts by range."""

    def run(batches):
        chunk = None
        held: list[tuple] = []
        rows = size = 0

        def parts(hashes: np.ndarray) -> dict[int, slice]:
            where, first = np.unique(hashes >> np.uint64(64 - bits), return_index=True)
            return {int(k): slice(a, b) for k, a, b in zip(where, first, [*first[1:], len(hashes)])}

        def made():
            keys, n, token, learnt = [h[0] for h in held], *(np.concatenate(x) for x in list(zip(*held))[1:])
            words, at = np.unique(token, return_inverse=True)
            if heads:
                often = np.argsort(-np.bincount(at), kind="stable")  # frequent words get small places
                rank = np.empty(len(words), np.uint32)
                rank[often] = np.arange(len(words), dtype=np.uint32)
                places = _planes(rank[at], 4)
                yield (-1, chunk, None, None, None, None, pickle.dumps((keys, n, words[often], len(places), pa.compress(places, "zstd", asbytes=True))))
                return
            counts = np.bincount(at, weights=learnt, minlength=len(words)).astype(np.uint32)
            pairs, at = np.unique(bigrams(token), return_inverse=True)
            pair_counts = np.bincount(at, weights=learnt, minlength=len(pairs)).astype(np.uint32)
            one, two, none = parts(words), parts(pairs), slice(0, 0)
            for k in sorted(one.keys() | two.keys()):
                a, b = one.get(k, none), two.get(k, none)
                own = pairs[b] << np.uint64(bits) >> np.uint64(64 - _PAIR_BITS)
                yield (k, chunk, _pack(words[a], 8), _planes(counts[a], 4), _pack(own, _PAIR_BITS // 8), _planes(pair_counts[b], 4), None)

        def send():
            out, room = [], 0
            for row in made():
                out.append(row)
                room += sum(len(x) for x in row[2:] if x)
                if room > 1 << 20:
                    yield from _rows(_SENT, out).to_batches()
                    out, room = [], 0
            if out:
                yield from _rows(_SENT, out).to_batches()

        for batch in batches:
            if chunk is None and batch.num_rows:
                chunk = batch.column(3)[0].as_py() << 24
            ids, learn = batch.column(0), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for first, data, offsets in _words.text_parts(batch.column(1)):
                token, bounds = tokens(data, offsets)
                many = len(offsets) - 1
                if rows and (rows + many > chunk_rows or size > chunk_tokens):
                    yield from send()
                    held.clear()
                    rows = size = 0
                    chunk += 1
                n = np.diff(bounds)
                held.append((ids.take(pa.array(np.arange(first, first + many))), n, token, np.repeat(learn[first : first + many], n)))
                rows += many
                size += len(token)
        if held:
            yield from send()

    return docs.select(F.col(key), F.col(text), F.coalesce(training, F.lit(False)).alias("_learn"), F.spark_partition_id().cast("long").alias("_part")).mapInArrow(trimmed(run), _SENT)


def _merged(rows: list[dict], hashes: str, counts: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of all chunks, their training counts, each chunk's places among them, and where chunks begin."""
    own = [_unpack(r[hashes], n) for r in rows]
    value, at = np.unique(np.concatenate(own), return_inverse=True)
    times = np.bincount(at, weights=np.concatenate([_unplaned(r[counts], 4) for r in rows]), minlength=len(value)).astype(np.int64)
    return value, times, at, np.cumsum([0, *map(len, own)])


def _answer(sent: DataFrame, bits: int, keep: bool = False, reply: bool = True) -> DataFrame:
    """Rows of ``_TOLD`` for rows of ``_SENT`` and, with a kept filter, its ranges (chunk null)."""
    tail = np.uint64(64 - _PAIR_BITS)

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        kept = [r for r in rows if r["chunk"] is None]
        rows = [r for r in rows if r["chunk"] is not None]
        if not rows:
            return _rows(_TOLD, [])
        words, times, at, cut = _merged(rows, "words", "counts", 8)
        pairs, pair_times, pair_at, pair_cut = _merged(rows, "pairs", "pair_counts", _PAIR_BITS // 8)
        if kept:
            held, held_times = np.frombuffer(kept[0]["words"], np.uint64), np.frombuffer(kept[0]["counts"], np.int64)
            bloom = BloomCounts.unpacked(kept[0]["head"])
            if len(held):
                place = np.minimum(np.searchsorted(held, words), len(held) - 1)
                times = np.where(held[place] == words, held_times[place], 0)
        else:
            known, old = times > 0, pair_times > 0
            grams = [(words[known] << np.uint64(bits), times[known]), (pairs[old] << tail, pair_times[old])]
            bloom = BloomCounts.of(grams, int(known.sum()) << bits)
            lev = level(times)
            by_level = np.bincount(lev, weights=times, minlength=len(_FLOOR)).astype(np.int64)
            sums = [int(known.sum()), int(times.sum()), int(_FLOOR[lev].sum()), int((pair_times == 1).sum()), *by_level.tolist()]
            stored = (words[known].tobytes(), times[known].tobytes(), bloom.packed()) if keep else (None,) * 3
            out.append((rows[0]["key"], None, *stored[:2], None, None, stored[2], sums))
        if reply:
            lev, pair_lev = bloom.levels(words << np.uint64(bits)), bloom.levels(pairs << tail)
            for i, r in enumerate(rows):
                a, b = at[cut[i] : cut[i + 1]], pair_at[pair_cut[i] : pair_cut[i + 1]]
                out.append((r["key"], r["chunk"], None, _planes(times[a].astype(np.uint64), 6), lev[a].tobytes(), pair_lev[b].tobytes(), None, None))
        return _rows(_TOLD, out)

    return sent.groupBy("key").applyInArrow(run, _TOLD)


def _model(told: DataFrame, bits: int) -> Model:
    """The model's numbers from written answers."""
    sums = told.where("sums is not null").select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # a row for each of a few hundred steps
    by = {r["i"]: r["n"] for r in sums}
    words, total, held, single = (by.get(i, 0) for i in range(4))
    new = min(0.98, max(0.02, single / max(1, total)))
    return Model(bits, total, words, held, new, _strength(np.array([by.get(i + 4, 0) for i in range(len(_FLOOR))], float), new) if total else 1.0)


def _finish(told: DataFrame, heads: DataFrame, model: Model, key: T.StructField) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row, chunk by chunk."""
    done = to_arrow_schema(T.StructType([key, *SCORED]))
    scale = model.train_tokens + 0.5 * (model.vocabulary + 1)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["key"])  # the head, then ranges as hashes ascend
        keys, n, words, size, places = pickle.loads(rows[0]["head"])
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        at, words = rank[_unplaned(pa.decompress(places, size, "zstd", asbytes=True), 4).astype(np.int64)], words[order]
        counts = np.concatenate([_unplaned(r["counts"], 6) for r in rows[1:]]).astype(np.int64)
        lev, pair_lev = (np.frombuffer(b"".join(r[c] for r in rows[1:]), np.uint8) for c in ("levels", "pair_levels"))
        pairs, pair = np.unique(bigrams(words[at]), return_inverse=True)
        if (len(words), len(pairs)) != (len(counts), len(pair_lev)):
            raise ValueError("the documents came in other parts when they were read again: write them to a table first")
        one, starts = counts[at], np.cumsum(n) - n
        before = np.concatenate([counts[words == END], one[:-1]])
        p = model.after(pair_lev[pair], before, lev[at])
        base, known, scored = (np.add.reduceat(x, starts) for x in (np.log10((one + 0.5) / scale), (one > 0).astype(np.int64), np.log10(p)))
        return pa.Table.from_arrays([pa.chunked_array(keys, done[0].type), pa.array(n), pa.array(known), pa.array(base), pa.array(scored)], schema=done)

    both = told.where("chunk is not null").select("key", "chunk", "counts", "levels", "pair_levels", "head")
    none = F.lit(None).cast("binary")
    both = both.unionByName(heads.select("key", "chunk", none.alias("counts"), none.alias("levels"), none.alias("pair_levels"), "head"))
    return both.groupBy("chunk").applyInArrow(run, T.StructType([key, *SCORED]))


def _range_bits(docs: DataFrame, text: str) -> int:
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return max(4, math.ceil(math.log2(chars / 3_000_000 + 1)))


def train_and_score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model]:
    """Learns from the rows where ``training`` holds and scores all of them.

    ``docs`` is read twice, and must come in the same parts both times, as a table does; else an error is raised.
    """
    bits = _range_bits(docs, text)
    told = staged(_answer(_send(docs, key, text, training, bits, False), bits), "told")
    model = _model(told, bits)
    return _finish(told, _send(docs, key, text, training, bits, True), model, docs.schema[key]), model


def train(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Model]:
    """The filters of all ranges as a written table, and the model's numbers."""
    bits = _range_bits(docs, text)
    held = staged(_answer(_send(docs.withColumn("_none", F.lit(0)), "_none", text, F.lit(True), bits, False), bits, keep=True, reply=False), "filter")
    return held.select("key", "words", "counts", F.col("head").alias("filter")), _model(held, bits)


def score(docs: DataFrame, model: Model, filters: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row against kept filters."""
    none = F.lit(None)
    ranges = filters.select("key", none.cast("long").alias("chunk"), "words", "counts", none.cast("binary").alias("pairs"), none.cast("binary").alias("pair_counts"), F.col("filter").alias("head"))
    sent, heads = (_send(docs, key, text, F.lit(False), model.ranges, h) for h in (False, True))
    return _finish(_answer(sent.unionByName(ranges), model.ranges), heads, model, docs.schema[key])
