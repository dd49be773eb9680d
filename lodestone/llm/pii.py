"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from patterns and checks alone. Around
every place that looks like more (digits with separators, at signs in any
spelling) a semi-Markov CRF reads a window of tokens: candidate segments of one
to ``SPAN`` tokens are scored by features of the whole span, and dynamic
programming over entities of bounded length chooses boundaries and types
jointly: the best segmentation of the window. Its entities are added where their
posterior, over all segmentations, reaches ``least`` and they meet no base span;
base spans always stay.

The field is trained on passages around base spans and on respelt copies of them
(at signs in words, defanged dots, phones without a plus, other separators), alone
and in lists, against number runs that are no personal data. The passages come from
a sample bounded by three parameters (rows drawn by a hash, passages a text and in
all); texts in it are read whole, of any length, and only passages reach the driver.

Cases: null texts are empty; empty texts have no spans; all work is linear in
the text, so very long texts and runs of digits are read whole; repeated rows
get equal spans; an empty table gives an empty table; input columns named as
outputs are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import map_rows, strings, trimmed

KINDS = ("email", "ip", "card", "phone")
SPAN = 5  # tokens in an entity at most
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not i & 1 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """From each at sign outwards: the same matches as the pattern, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append(("email", left, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; ends are exclusive."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The field. Label 0 is outside; label i + 1 is KINDS[i].
_TRIGGER = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9])|[0-9](?:[ ().+/\[\]_-]{0,3}[0-9]){6,}|[(\[{] ?(?:at|AT) ?[)\]}]|\S ?@ ?\S")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`,;:!?*#$%&|<>~^=_"
_CUES = (("mail", "contact", "write"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "pay"), ("tel", "phone", "call", "fax", "mobile"))
_HASHED, _PLAIN = 64, 40


def _trim(token: str) -> tuple[int, int]:
    a, b = 0, len(token)
    while a < b and token[a] in _EDGE:
        a += 1
    while b > a and token[b - 1] in _EDGE + ".":
        b -= 1
    return a, b


def _shape(s: str) -> str:
    s = re.sub(r"[0-9]", "9", s[:64])
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"9{5,}", "99999", s)


def span_features(s: str, before: str, tokens: int) -> np.ndarray:
    """Of the whole candidate: counts, checks, shape and the word in front."""
    f = np.zeros(_PLAIN + _HASHED)
    digits = _digits(s)
    n, letters = len(digits), sum(c.isalpha() for c in s)
    f[0] = 1
    f[1 + int(np.searchsorted((1, 7, 10, 12, 14, 17, 20), n, "right"))] = 1
    f[9] = "@" in s
    f[10] = bool(re.search(r"[(\[{] ?(?:at|AT) ?[)\]}]", s))
    f[11] = bool(re.search(r"[A-Za-z0-9-]+ ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]) ?[A-Za-z]{2,}$", s))
    f[12] = s.startswith("+")
    f[13] = "(" in s and letters == 0
    quads = re.findall(r"[0-9]+", s)
    f[14] = len(quads) == 4
    f[15] = len(quads) == 4 and all(len(q) <= 3 and int(q) <= 255 for q in quads) and not letters
    f[16] = f[15] and bool(re.fullmatch(r"[0-9]+(?: ?[\[(]?\.[\])]? ?[0-9]+){3}", s))
    f[17] = 14 <= n <= 19 and luhn(digits)
    f[18] = f[17] and not letters
    f[19] = n == len(s)
    f[20] = 0 < letters and n > 0
    f[21] = letters > 0 and not f[9] and not f[10]
    f[22 + min(tokens, SPAN) - 1] = 1
    f[27] = bool(s) and (s[0].isalnum() or s[0] in "+(")
    f[28] = bool(s) and (s[-1].isalnum() or s[-1] in ")")
    f[29] = len(re.findall(r"[0-9]{3}[ .)-]+[0-9]{3}[ .-][0-9]{4}$", s))
    f[30] = 10 <= n <= 15 and not letters and len(quads) >= 3
    word = before.lower()
    for i, cues in enumerate(_CUES):
        f[31 + i] = any(c in word for c in cues)
    f[35] = len(s) > 60
    f[36] = s.count("(") != s.count(")") or s.count("[") != s.count("]")
    f[_PLAIN + zlib.crc32(_shape(s).encode()) % _HASHED] = 1
    return f


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # features x kinds
    moves: np.ndarray  # label before x label


@dataclass
class Window:
    tokens: list[tuple[int, int]]  # trimmed character ranges
    features: np.ndarray  # end x (length - 1) x features


def window(text: str, tokens: list[tuple[int, int]]) -> Window:
    feats = np.zeros((len(tokens), SPAN, _PLAIN + _HASHED))
    for j in range(len(tokens)):
        for d in range(min(SPAN, j + 1)):
            first = j - d
            before = text[tokens[first - 1][0] : tokens[first - 1][1]] if first else ""
            feats[j, d] = span_features(text[tokens[first][0] : tokens[j][1]], before, d + 1)
    return Window(tokens, feats)


def _forward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """log sums over segmentations of each prefix, by last label."""
    out = np.full((len(scores) + 1, len(moves)), -np.inf)
    out[0, 0] = 0
    for j in range(1, len(out)):
        d = min(SPAN, j)
        before = np.logaddexp.reduce(out[j - d : j][::-1, :, None] + moves, axis=1)
        out[j] = np.logaddexp.reduce(before + scores[j - 1, :d], axis=0)
    return out


def _backward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """log sums over segmentations of each suffix, by the label before it."""
    n = len(scores)
    out = np.zeros((n + 1, len(moves)))
    for j in range(n - 1, -1, -1):
        d = np.arange(min(SPAN, n - j))
        after = np.logaddexp.reduce(scores[j + d, d] + out[j + d + 1], axis=0)
        out[j] = np.logaddexp.reduce(moves + after, axis=1)
    return out


def _scores(field: Field, w: Window) -> np.ndarray:
    """end x (length - 1) x label; outside has length 1 only."""
    s = w.features @ field.weights
    outside = np.full((*s.shape[:2], 1), -np.inf)
    outside[:, 0] = 0
    return np.concatenate([outside, s], axis=2)


def posteriors(field: Field, w: Window) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment (end, length - 1, label), and expected moves."""
    s = _scores(field, w)
    a, b = _forward(s, field.moves), _backward(s, field.moves)
    z = np.logaddexp.reduce(a[-1])
    p, moved = np.zeros_like(s), np.zeros_like(field.moves)
    for j in range(len(s)):
        for d in range(min(SPAN, j + 1)):
            by = np.exp(a[j - d][:, None] + field.moves + s[j, d] + b[j + 1] - z)
            p[j, d] = by.sum(axis=0)
            moved += by
    return p, moved


def best_segments(field: Field, w: Window) -> list[tuple[int, int, int]]:
    """(end, length - 1, label) of the entities of the best segmentation, by dynamic programming."""
    s = _scores(field, w)
    best = np.full((len(s) + 1, len(field.moves)), -np.inf)
    came = np.zeros((*best.shape, 2), int)  # length - 1 of the last segment, label before it
    best[0, 0] = 0
    for j in range(1, len(best)):
        d = min(SPAN, j)
        ways = best[j - d : j][::-1, :, None] + field.moves + s[j - 1, :d, None, :]  # length - 1, label before, label
        flat = ways.reshape(-1, ways.shape[2])
        top = flat.argmax(axis=0)
        best[j] = flat[top, np.arange(flat.shape[1])]
        came[j, :, 0], came[j, :, 1] = top // ways.shape[1], top % ways.shape[1]
    out, j, y = [], len(s), int(best[-1].argmax())
    while j:
        d, before = came[j, y]
        if y:
            out.append((j - 1, int(d), y))
        j, y = j - 1 - int(d), int(before)
    return out[::-1]


def train(examples: list[tuple[str, list[Span]]], epochs: int = 8, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Adagrad on the conditional likelihood of (window text, its spans)."""
    weights, moves = np.zeros((_PLAIN + _HASHED, len(KINDS))), np.zeros((len(KINDS) + 1,) * 2)
    weights[0] = -3.0
    data = []
    for text, spans in examples:
        tokens = [(m.start() + a, m.start() + b) for m in _TOKEN.finditer(text) for a, b in [_trim(m[0])] if a < b]
        w = window(text, tokens)
        segments, j = [], 0
        while j < len(tokens):
            hit = next(((k, s) for k, s, e in spans if s <= tokens[j][0] < e), None)
            end = j + 1
            if hit:
                stop = next(e for k, s, e in spans if (k, s) == hit)
                while end < len(tokens) and tokens[end][0] < stop and end - j < SPAN:
                    end += 1
            segments.append((end - 1, end - 1 - j, KINDS.index(hit[0]) + 1 if hit else 0))
            j = end
        if tokens:
            data.append((w, segments))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(data)
        for w, segments in data:
            p, moved = posteriors(Field(weights, moves), w)
            grad_w, grad_m, last = -np.einsum("jdf,jdk->fk", w.features, p[:, :, 1:]), -moved, 0
            for j, d, y in segments:
                if y:
                    grad_w[:, y - 1] += w.features[j, d]
                grad_m[last, y] += 1
                last = y
            grad_w -= ridge * weights
            seen_w += grad_w**2
            seen_m += grad_m**2
            weights = weights + rate * grad_w / np.sqrt(seen_w)
            moves = moves + rate * grad_m / np.sqrt(seen_m)
    return Field(weights, moves)


def respelt(kind: str, s: str, pick: random.Random) -> str:
    """Another spelling of a base span, as people write to escape patterns."""
    if kind == "email":
        name, _, host = s.partition("@")
        return pick.choice((f"{name} (at) {host}", f"{name}[at]{host}", f"{name} [at] {host.replace('.', '[dot]')}", f"{name} @ {host}", f"{name}(at){host.replace('.', '(dot)')}"))
    if kind == "ip":
        return s.replace(".", pick.choice(("[.]", "(.)", " . ")))
    digits = _digits(s)
    if kind == "card":
        mark = pick.choice((".", "/", "_", " - "))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    return pick.choice((f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{digits[:-10] or 1}-{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"00{digits[:-10] or 1} {tail[:3]} {tail[3:6]} {tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}"))


#: A passage: kind ("none" for what looks like data and is none), the span, words before and after.
Passage = tuple[str, str, str, str]


def passages(text: str, most: int = 4, around: int = 3) -> list[Passage]:
    """Up to ``most`` of each kind from anywhere in the text, chosen by a hash."""
    found: dict[str, list[tuple[int, Passage]]] = {}
    spans = base_spans(text)
    starts, ends = (np.array([s[i] for s in spans], np.int64) for i in (1, 2))

    def put(kind: str, a: int, b: int, left: str, right: str) -> None:
        found.setdefault(kind, []).append((zlib.crc32(f"{a} {text[a:b]}".encode("utf-8", "replace")), (kind, text[a:b], left, right)))

    for kind, a, b in spans:
        if ((starts < b) & (a < ends)).sum() > 1:
            continue
        left = " ".join(text[max(0, a - 60) : a].split()[-around:])
        right = " ".join(text[b : b + 60].split()[:around])
        if left and not text[a - 1].strip() and len(left) <= 50 and not base_spans(left) and not base_spans(right):
            put(kind, a, b, left, right)
    for m in _TRIGGER.finditer(text):
        if not ((starts < m.end()) & (m.start() < ends)).any():
            part = " ".join(text[max(0, m.start() - 40) : m.end() + 40].split()[1:-1][:10])
            if not base_spans(part):
                found.setdefault("none", []).append((zlib.crc32(part.encode("utf-8", "replace")), ("none", part, "", "")))
    return [p for held in found.values() for _, p in sorted(held)[:most]]


def examples(found: list[Passage], most: int = 400, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Passages, their respelt copies, lists of them, and number runs that are neither; ``most`` bounds each sort."""
    pick, out = random.Random(seed), []
    lists, held = random.Random(seed + 2), {}
    per = {k: 0 for k in (*KINDS, "none")}
    for kind, span, left, right in found:
        if per[kind] >= (most // 2 if kind == "none" else most // 5):
            continue
        per[kind] += 1
        if kind == "none":
            out.append((span, []))
            continue
        for s in (span, respelt(kind, span, pick)):
            at = len(left) + 1
            out.append((f"{left} {s} {right}", [(kind, at, at + len(s))]))
        items = held.setdefault(kind, [])
        items.append(lists.choice((span, s, s)))
        if len(items) == 3:
            line, among = left + " ", []
            for i, s in enumerate(items):
                line += lists.choice((", ", "; ", " ", " or ", " and ")) if i else ""
                among.append((kind, len(line), len(line) + len(s)))
                line += s
            out.append((f"{line} {right}", among))
            items.clear()
    digits = random.Random(seed + 1)
    for _ in range(most // 4):  # runs of digits that are no data of anybody
        n = digits.choice((7, 8, 9, 11, 13, 14, 15, 16, 18, 22))
        s = "".join(digits.choice("0123456789") for _ in range(n))
        form = digits.choice((s, f"{s[:4]}-{s[4:6]}-{s[6:8]}", f"v{s[0]}.{s[1]}.{s[2]}", f"{s[:3]},{s[3:6]}", f'"{s}a{s[:5]}f"'))
        if not (14 <= len(_digits(form)) <= 19 and luhn(_digits(form))):
            out.append((f"the value {form} is", []))
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", max_rows: int = 20_000, a_text: int = 4, max_passages: int = 6_000, most: int = 400) -> Field | None:
    """The field from at most ``max_rows`` rows, ``a_text`` passages of each kind of a text and ``max_passages`` in all.

    Keys are drawn in the order of a hash; their rows are then fetched by a broadcast
    of those keys and read where they are.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit("pii"))
    drawn = docs.where(F.col(key).isNotNull()).select(order.alias("_o")).distinct().orderBy("_o").limit(max_rows)
    schema = T.StructType([T.StructField("_o", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("kind", "span", "before", "after"))])

    def run(batches):
        for batch in batches:
            out = [(o, *p) for o, t in zip(batch.column(0).to_pylist(), strings(batch, "_t")) for p in passages(t, a_text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(to_arrow_schema(schema))], schema=to_arrow_schema(schema))

    own = docs.select(order.alias("_o"), F.col(text).alias("_t")).where(F.col(key).isNotNull())
    texts = own.join(F.broadcast(drawn), "_o", "left_semi").where(F.col("_t").rlike("@|[0-9]{7}|\\+[0-9]"))
    columns = ("_o", "kind", "span", "before", "after")
    found = [tuple(r) for r in texts.mapInArrow(trimmed(run), schema).orderBy(*columns).limit(max_passages).toLocalIterator()]
    made = examples([x[1:] for x in found], most)
    return train(made) if any(spans for _, spans in made) else None


def _windows(text: str, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Character ranges around all triggers outside base spans; ranges that meet are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if ((starts <= m.start()) & (m.end() <= ends)).any():
            continue
        lo, hi = m.start(), m.end()
        for _ in range(3):  # three tokens of context on each side, 64 characters at most
            lo = max(text.rfind(" ", max(0, lo - 64), max(lo - 1, 0)), lo - 64, 0)
            nxt = text.find(" ", hi + 1, hi + 65)
            hi = min(len(text), nxt if nxt >= 0 else hi + 64)
        if out and lo < out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def added_spans(text: str, field: Field, base: list[Span], least: float = 0.8) -> list[Span]:
    """What the field finds beyond the base spans."""
    out: list[Span] = []
    starts, ends = (np.array([s[i] for s in base], np.int64) for i in (1, 2))
    for lo, hi in _windows(text, starts, ends):
        tokens = [(t.start() + a, t.start() + b) for t in _TOKEN.finditer(text, lo, hi) for a, b in [_trim(t[0])] if a < b]
        for at in range(0, len(tokens), 32 - 2 * SPAN):  # long runs in overlapping parts
            part, last = tokens[at : at + 32], at + 32 >= len(tokens)
            w = window(text, part)
            chosen = best_segments(field, w)
            p = posteriors(field, w)[0] if chosen else None
            for j, d, y in chosen:
                # a part has the spans that start away from its edges: each start is in one part, with context
                if (at and j - d < 3) or (not last and j - d >= 35 - 2 * SPAN) or p[j, d, y] < least:
                    continue
                span = (KINDS[y - 1], part[j - d][0], part[j][1])
                if not ((starts < span[2]) & (span[1] < ends)).any() and not (out and span[1] < out[-1][2]):
                    out.append(span)
            if last:
                break
    return out


def find(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: "kind:start:end" by start, comma-joined."""

    def make():
        def step(batch):
            base = [base_spans(t) for t in strings(batch, text)]
            both = [sorted(b + (added_spans(t, field, b) if field else []), key=lambda s: (s[1], KINDS.index(s[0]))) for t, b in zip(strings(batch, text), base)]
            return {"base": [told(b) for b in base], "spans": [told(b) for b in both]}

        return step

    return map_rows(docs, make, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()))


def redacted(text: str, spans: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for span in spans.split(",") if spans else []:
        kind, a, b = span.split(":")
        if int(b) <= at:
            continue
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = int(b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null."""
    names = docs.columns

    def make():
        def step(batch):
            found = strings(batch, "spans")
            return {text: [None if t is None else redacted(t, s) for t, s in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), found)]}

        return step

    return map_rows(find(docs, field, text), make, docs.schema[text]).select(*names)
