"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers, leftmost and without
overlap within a kind; a match that fails its test is dropped. Zones around digits and at signs
are then cut into tokens, and every segment of at most ``MOST`` tokens that could be an entity is
scored by features of the whole span. Dynamic programming over bounded segments chooses
boundaries and kinds of a zone together. The field is trained by maximum likelihood (forward and
backward sums over all segmentations) on zones in which no pattern ran several numbers together, so
that it learns what entities look like; it then separates neighbours that a pattern ran together.
Its spans are added where they overlap no pattern's span.

Segments are made and scored as the programming goes over a zone, so a zone of any length holds some
numbers a token and nothing else. An entity has at most ``DIGITS`` digits and ``MOST`` tokens.

Offsets are code points, ends are exclusive. Null and empty texts have no spans. Repeated rows, and
rows without a doc_id, get equal results for equal texts; other columns are ignored. Zones and
patterns cost time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.textblocks import blocks, release, ship

KINDS = ("email", "ip", "card", "phone")
MOST = 16
DIGITS = 19  # of the longest card number
LONGEST = {"card": 19, "phone": 15}
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts, as a later digit of the run could only fail the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def valid(kind: str, text: str) -> bool:
    """The test of a pattern's match."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        if len(text) > 2 * 19:  # every other character is a digit at least
            return False
        d = _digits(text)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


def patterns(text: str) -> tuple[list[Span], list[Span]]:
    """Spans that pass their tests, by kind and then start; and matches that fail."""
    good: list[Span] = []
    bad: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # from each at sign outwards, so a long run of letters is read once
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            good.append(("email", start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        found = [("ip", _IP), ("card", _CARD)] + [("phone", _PHONE)] * ("+" in text)
        for kind, pattern in found:
            for m in pattern.finditer(text):
                (good if valid(kind, m.group()) else bad).append((kind, m.start(), m.end()))
    return good, bad


_ANCHOR = re.compile(r"[0-9@]+")
_FOUR = re.compile(r"(?:[0-9][^0-9]*+){4}")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")


def zones(text: str) -> list[tuple[int, int]]:
    """Bounds of runs of words with digits or at signs, one blank apart, with an at sign or four digits."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        a, b = m.start(), m.end()
        least = out[-1][1] if out else 0
        while a > least and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 1 and text[out[-1][1] : a] in ("", " "):
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if text.find("@", a, b) >= 0 or _FOUR.search(text, a, b)]


def _side(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "@.+-()" else "mark"


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span."""
    s = text[a:b]
    d = _digits(s)
    out = ["bias", f"left={_side(text[a - 1 : a])}", f"right={_side(text[b : b + 1])}"]
    if "@" in s:
        local, _, domain = s.partition("@")
        out += [f"ats={min(s.count('@'), 2)}", f"local={bool(_LOCAL.match(local))}", f"domain={bool(_DOMAIN.fullmatch('@' + domain))}", f"whole={_side(text[a - 1 : a])}|{_side(text[b : b + 1])}|{bool(_LOCAL.match(local) and _DOMAIN.fullmatch('@' + domain))}"]
        return out
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", s)
    out += [f"digits={min(len(d), 20)}", f"marks={''.join(sorted(set(re.sub(r'[0-9]', '', s))))}", f"groups={re.sub(r'[0-9]+', 'd', s)}", f"shape={shape}"]
    out.append(f"card={bool(_CARD.fullmatch(s)) and valid('card', s)}")
    out.append(f"ip={bool(_IP.fullmatch(s)) and valid('ip', s)}")
    out.append(f"phone={bool(_PHONE.fullmatch(s)) and valid('phone', s)}|{s.count('.')}")
    return out


Segments = list[tuple[int, list[str]]]


class Zone:
    """Tokens of a zone, and the segments that could be entities, by the token they end with."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.text = text
        self.starts, self.ends = array("q"), array("q")
        for m in _TOKEN.finditer(text, a, b):
            self.starts.append(m.start())
            self.ends.append(m.end())

    @classmethod
    def of(cls, text: str, a: int, b: int) -> Zone:
        return cls(text, a, b)

    def ending(self, j: int) -> Segments:
        """First token and features of each segment that ends with token j."""
        text, starts, end, here, digits = self.text, self.starts, self.ends[j], [], 0
        if not (text[end - 1].isascii() and text[end - 1].isalnum()):
            return here
        for i in range(j, max(-1, j - MOST), -1):
            c = text[starts[i]]
            if c.isspace() and c != " ":
                break
            digits += (self.ends[i] - starts[i]) if "0" <= c <= "9" else 0
            s = text[starts[i] : end]
            if digits > DIGITS and "@" not in s:
                break
            if not (c.isascii() and c.isalnum() or c in "+("):
                continue
            if " " in s and "@" in s or "@" not in s and any(x.isalpha() for x in s):
                break
            if "@" in s or digits >= 4:
                here.append((i, features(text, starts[i], end)))
        return here

    @property
    def segments(self) -> Iterator[Segments]:
        return (self.ending(j) for j in range(len(self.starts)))


@dataclass
class Field:
    """Weights of each feature for each kind; a token outside entities scores 0."""

    index: dict[str, int]
    weights: np.ndarray

    def scores(self, names: list[str]) -> np.ndarray:
        at = [self.index[n] for n in names if n in self.index]
        return self.weights[at].sum(axis=0)

    def best(self, zone: Zone) -> list[tuple[int, int, int]]:
        """Token bounds and kind of the entities of the best segmentation."""
        n = len(zone.starts)
        total, back, kind = array("d", [0.0]) * (n + 1), array("q", [-1]) * (n + 1), bytearray(n + 1)
        for j, here in enumerate(zone.segments):
            total[j + 1] = total[j]
            for i, names in here:
                s = self.scores(names)
                k = int(s.argmax())
                if total[i] + s[k] > total[j + 1]:
                    total[j + 1], back[j + 1], kind[j + 1] = total[i] + float(s[k]), i, k
        out, j = [], n
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append((back[j], j - 1, kind[j]))
                j = back[j]
        return out[::-1]

    def gradient(self, zone: Zone, gold: set[tuple[int, int, int]], grad: np.ndarray) -> None:
        """Add observed less expected feature counts of a zone: forward and backward sums over all segmentations."""
        n = len(zone.starts)
        scored = [[(i, [self.index[x] for x in names if x in self.index]) for i, names in here] for here in zone.segments]
        values = [[self.weights[at].sum(axis=0) for _, at in here] for here in scored]
        ahead = np.zeros(n + 1)
        for j in range(n):
            terms = [ahead[j]] + [ahead[i] + np.logaddexp.reduce(v) for (i, _), v in zip(scored[j], values[j], strict=True)]
            ahead[j + 1] = np.logaddexp.reduce(terms)
        behind = np.full(n + 1, -np.inf)
        behind[n] = 0
        for j in range(n - 1, -1, -1):
            behind[j] = np.logaddexp(behind[j], behind[j + 1])
            for (i, _), v in zip(scored[j], values[j], strict=True):
                behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(v) + behind[j + 1])
        # behind[i] above is whole only once all ends past i are seen, which the falling order gives.
        for j in range(n):
            for (i, at), v in zip(scored[j], values[j], strict=True):
                p = np.exp(ahead[i] + v + behind[j + 1] - ahead[n])
                p = -p
                for a, b, k in gold:
                    if (a, b) == (i, j):
                        p[k] += 1
                grad[at] += p


class Trained:
    """A zone of the bounded sample with its segments kept, as training goes over it again and again."""

    def __init__(self, zone: Zone) -> None:
        self.starts, self.ends, self.segments = zone.starts, zone.ends, list(zone.segments)


def train(zones_: list[tuple[Trained, set[tuple[int, int, int]]]], epochs: int = 5, rate: float = 0.5, decay: float = 1e-3, seed: int = 5) -> Field:
    names = sorted({x for zone, _ in zones_ for here in zone.segments for _, f in here for x in f})
    model = Field({x: i for i, x in enumerate(names)}, np.zeros((len(names), len(KINDS))))
    if not names:
        return model
    model.weights[model.index["bias"]] = -1.0
    squares, rng = np.full_like(model.weights, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(zones_))
        for lo in range(0, len(order), 16):
            grad = -decay * model.weights
            for i in order[lo : lo + 16]:
                model.gradient(*zones_[i], grad)
            squares += grad * grad
            model.weights += rate * grad / np.sqrt(squares)
    return model


def _gold(text: str, a: int, b: int, zone: Zone, good: list[Span], bad: list[Span]) -> set[tuple[int, int, int]] | None:
    """Token bounds of the pattern spans of a zone; None if one has too many digits, so that it may
    be several run together, overlaps another or ends inside a token."""
    if any(s < b and e > a and len(_digits(text[s:e])) > LONGEST.get(k, 99) for k, s, e in bad):
        return None
    inside = sorted((s, e, k) for k, s, e in good if s < b and e > a)
    if any(x[1] > y[0] for x, y in zip(inside, inside[1:], strict=False)):
        return None
    first, last = {s: i for i, s in enumerate(zone.starts)}, {e: i for i, e in enumerate(zone.ends)}
    if any(s not in first or e not in last or last[e] - first[s] >= MOST for s, e, _ in inside):
        return None
    return {(first[s], last[e], KINDS.index(k)) for s, e, k in inside}


def fit(docs: DataFrame, max_docs: int = 2_000, max_zones: int = 1_500, longest: int = 200) -> Field:
    """Train on zones of at most ``max_docs`` of the documents with digits or at signs, those with the smallest hash of doc_id.

    Of all zones of their whole texts that have at most ``longest`` code points, the ``max_zones``
    different ones with the smallest hash are used. Rows without a doc_id are not trained on.
    """
    ship(docs.sparkSession)
    some = docs.where("text rlike '@|[0-9]{4}|[0-9][.][0-9]'")
    chosen = some.where("doc_id is not null").groupBy("doc_id").agg(F.first(F.xxhash64("doc_id")).alias("h")).orderBy("h", "doc_id").limit(max_docs).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                texts, at, to = [], [], []
                for text in part.column("text").to_pylist():
                    for a, b in zones(text):
                        if b - a <= longest:
                            lo = max(a - 1, 0)
                            texts.append(text[lo : b + 1])
                            at.append(a - lo)
                            to.append(b - lo)
                yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "a": pa.array(at, pa.int32()), "b": pa.array(to, pa.int32())})
        release()

    rows = some.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    got = rows.mapInArrow(run, "text string, a int, b int").distinct().orderBy(F.xxhash64("text"), "text", "a", "b").limit(max_zones).collect()
    made = []
    for r in got:
        zone = Zone.of(r.text, r.a, r.b)
        gold = _gold(r.text, r.a, r.b, zone, *patterns(r.text))
        if gold is not None:
            made.append((Trained(zone), gold))
    return train(made)


class Taken:
    """Spans by start, with the furthest end so far, to ask for overlaps."""

    def __init__(self, spans: list[Span]) -> None:
        bounds = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in bounds]
        self.ends = list(accumulate((b for _, b in bounds), max))

    def __contains__(self, span: tuple[int, int]) -> bool:
        before = bisect_left(self.starts, span[1])
        return before > 0 and self.ends[before - 1] > span[0]


def spans_of(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and all spans, each by kind and then start."""
    good, _ = patterns(text)
    added, taken = [], Taken(good)
    for a, b in zones(text):
        zone = Zone.of(text, a, b)
        for i, j, k in model.best(zone):
            s, e = zone.starts[i], zone.ends[j]
            if (s, e) not in taken:
                added.append((KINDS[k], s, e))
    return good, sorted(good + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if added else good


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, put as ``[KIND]``."""
    out, end, last = [], 0, -1
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a < last:
            end = last = max(last, b)
            continue
        out += [text[end:a], f"[{k.upper()}]"]
        end = last = b
    return "".join([*out, text[end:]])


def find(docs: DataFrame, model: Field) -> DataFrame:
    """Counts of pattern spans, their digest, all spans and their number, of every row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # some thousand features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                counts, digest, joined = [], [], []
                for text in part.column("text").to_pylist():
                    good, every = spans_of(text or "", shared.value)
                    counts.append([*(sum(s[0] == k for s in good) for k in KINDS), len(every)])
                    digest.append(hashlib.sha256(_joined(good).encode()).hexdigest())
                    joined.append(_joined(every))
                table = np.array(counts, np.int64)
                columns = [pa.array(table[:, i]) for i in range(len(KINDS) + 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns[:-1], pa.array(digest, pa.string()), pa.array(joined, pa.string()), columns[-1]], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """The documents with all their columns, personal data in ``text`` put as ``[KIND]``; null texts stay null."""
    spark = docs.sparkSession
    ship(spark)
    shared, schema = spark.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in blocks(batch, "text"):
                texts = [None if t is None else redacted(t, spans_of(t, shared.value)[1]) for t in part.column(k).to_pylist()]
                yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))
        release()

    return docs.mapInArrow(run, schema)
