"""Compression-distance toxicity: what a toxic dictionary saves over an ordinary one.

Two zstandard dictionaries of equal length end in the same base, which zstandard
trains on ordinary text. One is led by strings that toxic training documents hold
far more often than chance allows, the other by as many bytes of the commonest
ordinary words. A text is cut into windows at blanks, and each window is compressed
against both; the gain is the difference in bytes. A logistic curve over the
largest gain, the mean of the top three and the number of windows past the
threshold calibrates the score.

The toxic lead is chosen by a test of counts and not by zstandard's own trainer,
and windows hold one word: dictionaries that the trainer makes of toxic and of
ordinary windows were tried and do not tell the documents apart (figures in the
README), since what it keeps is mostly the ordinary text around a toxic word.

Fitting reads a bounded sample (``max_sample`` rows, whole texts; ``base_pieces``
pieces of eight words train the base, drawn by hash from all of them); scoring
reads all text.

Cases: null and empty texts have one gain of 0 and score below the threshold;
words over 64 bytes are cut into several windows, so no part of a text is left
out; equal texts score alike; an empty table gives an empty table; without any
toxic training row every score is the base rate; an input column with the name
of an output is replaced.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_rows, strings

_WINDOW = re.compile(rb"[^\x00-\x20]{1,64}")
_PRIMER = b"\x01what every window is led by\x02"


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    gain: int = 3


def windows(text: str) -> list[bytes]:
    return _WINDOW.findall(text.lower().encode("utf-8", "replace"))


def _compressor(content: bytes):
    params = zs.ZstdCompressionParameters.from_level(
        3, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=3, strategy=zs.STRATEGY_BTOPT,
    )
    trained = zs.ZstdCompressionDict(content + _PRIMER, dict_type=zs.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=trained, compression_params=params).compress


class _Gains(dict):
    """Gain by window, kept for repeated words and emptied when it grows too large."""

    def __init__(self, model: ToxicityModel, most: int = 60_000):
        super().__init__()
        self.pair, self.most = (_compressor(model.ordinary), _compressor(model.toxic)), most

    def __missing__(self, window: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        padded = _PRIMER + b" " + window + b" " + _PRIMER  # no match starts in the last bytes of an input
        self[window] = gain = len(self.pair[0](padded)) - len(self.pair[1](padded))
        return gain


def _features(gains: np.ndarray, least: int) -> tuple[float, float, float]:
    top = np.sort(gains)[::-1]
    return float(top[0]), float(top[:3].mean()), math.log1p(int((gains >= least).sum()))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X >= k) for a binomial, by its first terms, enough to rank by."""
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k, min(n, k + 20) + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _independent(rows: list[tuple[str, int]]) -> list[tuple[list[bytes], int]]:
    """Rows as windows, one of each group of near copies: copies aren't evidence twice."""
    seen, out = set(), []
    for text, label in rows:
        found = windows(text)
        grams = {b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))}
        marks = {(salt, min(zlib.crc32(g, salt) for g in grams)) for salt in (0, 0x9E3779B9)} if found else {0}
        if marks & seen:
            continue
        seen |= marks
        out.append((found, label))
    return out


def fit(rows: list[tuple[str | None, int]], dict_bytes: int = 4096, base_bytes: int = 16384, alpha: float = 1e-5, base_pieces: int = 60_000) -> ToxicityModel:
    """Dictionaries and calibration from a bounded list of (text, 0 or 1)."""
    kept = _independent([(t or "", int(y)) for t, y in rows if y is not None])
    by: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for found, y in kept:
        n[y] += 1
        strings_of = set()
        for w in set(found):
            strings_of.add(w)
            strings_of.update(w[:k] for k in (4, 5, 6, 7, 8) if len(w) > k)
        by[y].update(strings_of)
    rate = (n[1] + 1) / (n[0] + n[1] + 2)
    scored = []
    for w, a in by[1].items():
        if a >= 3 and len(w) >= 4 and a > 4 * rate * (a + by[0][w]):
            p = _log_tail(a, a + by[0][w], rate)
            if p < math.log(alpha):
                scored.append((p, w))
    scored.sort(key=lambda x: (x[0], x[1]))

    def packed(words, most: int) -> bytes:
        out, size = [], 0
        for w in words:
            if size + len(w) + 1 > most:
                break
            out.append(w)
            size += len(w) + 1
        return b" " + b" ".join(reversed(out)) + b" "

    lead = packed([w for _, w in scored], dict_bytes)
    common = packed([w for w, _ in sorted(by[0].items(), key=lambda x: (-x[1], x[0])) if len(w) >= 4], len(lead))
    pieces = (b" ".join(found[i : i + 8]) for found, y in kept if not y for i in range(0, len(found), 8))
    drawn = heapq.nsmallest(base_pieces, ((zlib.crc32(piece), i, piece) for i, piece in enumerate(pieces)))
    plain = [piece for _, _, piece in sorted(drawn, key=lambda x: x[1])]  # in the texts' order: the trainer looks at neighbours
    try:
        base = zs.train_dictionary(base_bytes, plain).as_bytes()
    except zs.ZstdError:  # too little text to train on
        base = b" ".join(plain)[:base_bytes]
    model = ToxicityModel(common[-len(lead) :].rjust(len(lead)) + base, lead + base, (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))
    if not n[1] or not n[0]:
        return model
    gains = _Gains(model)
    x = np.array([[1.0, *_features(np.array([gains[w] for w in found] or [0]), model.gain)] for found, _ in kept])
    y = np.array([label for _, label in kept], dtype=float)
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 0.05, 0.05, 0.05])
    for _ in range(25):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        weights += np.linalg.solve(hessian, x.T @ (y - p) - ridge @ weights)
    return ToxicityModel(model.ordinary, model.toxic, tuple(map(float, weights)))


def sample_rows(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_sample: int = 6000, max_chars: int = 40_000_000) -> list[tuple[str, int]]:
    """At most ``max_sample`` labelled rows in an order fixed by a hash of the key.

    The labels are cut first, so that what is broadcast to fetch the texts is
    ``max_sample`` rows at most and no text is shuffled. ``max_chars`` bounds
    the driver's memory: lengths are looked at before any text is sent, and only
    the rows that would pass the bound are left out of the fit.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit("toxicity"))
    drawn = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(order.alias("_o"), F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    drawn = drawn.orderBy("_o", "_k", "_y").limit(max_sample).toLocalIterator()
    chosen = [tuple(r) for r in drawn]
    if not chosen:
        return []
    spark = docs.sparkSession

    def fetched(rows):
        few = F.broadcast(spark.createDataFrame(rows, "_o long, _k long, _y int"))
        return docs.select(F.col(key).cast("long").alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(few, F.col("_d") == F.col("_k"))

    sizes = sorted((r["_o"], r["n"]) for r in fetched(chosen).groupBy("_o").agg(F.sum(F.length("_t")).alias("n")).collect())
    total, fits = 0, set()
    for o, n in sizes:
        if total + n <= max_chars:
            total += n
            fits.add(o)
    kept = [r for r in chosen if r[0] in fits]
    return [(r["_t"], r["_y"]) for r in sorted(fetched(kept).select("_o", "_k", "_y", "_t").collect())] if kept else []


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", **bounds) -> ToxicityModel:
    """The model of the sampled rows; an error where there are labelled rows and none of them fits the bounds."""
    sample = sample_rows(docs, labels, label=label, key=key, **bounds)
    if not sample and docs.join(labels.where(F.col(label).isNotNull()), key, "left_semi").limit(1).count():
        raise ValueError("no labelled row fits the bounds of the sample")
    return fit(sample)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``n_windows`` and ``top_gain``."""

    def make():
        gains = _Gains(model)
        memo: dict[tuple, float] = {}

        def step(batch):
            out: dict[str, list] = {"score": [], "predicted": [], "n_windows": [], "top_gain": []}
            for t in strings(batch, text):
                found = windows(t)
                got = np.fromiter(map(gains.__getitem__, found), np.int32, len(found)) if found else np.zeros(1, np.int32)
                f = _features(got, model.gain)
                if f not in memo:
                    memo[f] = _sigmoid(sum(w * v for w, v in zip(model.weights, (1.0, *f))))
                out["score"].append(memo[f])
                out["predicted"].append(int(memo[f] >= threshold))
                out["n_windows"].append(len(found))
                out["top_gain"].append(int(f[0]))
            return out

        return step

    return map_rows(
        docs, make,
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("n_windows", T.LongType()), T.StructField("top_gain", T.IntegerType()),
    )
