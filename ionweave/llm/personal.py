"""Personal data: base patterns, and a skip-chain conditional random field that decides on what they leave.

The base patterns find email addresses, IP addresses, card and phone numbers;
their spans are observed and stay.  The field's nodes are the candidate words of
a text (those with a digit or an @, and the base spans).  Its potentials: buckets
of a word's shape; a chain between neighbouring candidates; and skip edges
between words of the same or similar form (the same letters and digits, the same
last digits, the same name before an @), however distant: each word meets the
first and the last one before it of each of its forms.  All three are learned by
maximum pseudo-likelihood over the words of all documents.  Loopy message passing
makes labels agree across the text, and goes on along chains of skip edges.  A
word that has no base span, and that the field gives a label with enough
certainty, adds a span; one of its labels, secret (keys and tokens), has added
spans only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches
from .textblocks import blocks, buffers, strings

KINDS = ("email", "ip", "card", "phone")
#: What added spans can be.
ALL_KINDS = (*KINDS, "secret")
LABELS = ("other", *ALL_KINDS)
#: Certainty from which a label adds a span.
CERTAIN = 0.9
#: Distinct lessons, the most frequent, from which the field is fitted; each is some twenty bytes.
LESSONS = 50_000
#: Rounds of message passing end when no message changes by more than this, or at the latest after so many.
SETTLED, ROUNDS = 1e-3, 100

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_ASKED = re.compile("[0-9@]")
_EDGE = "\"'()[]{}<>,;:!?#$%&*|"
#: Words from which the label secret is learned: long, of letters and digits, behind an = or a colon.
_KEYLIKE = re.compile(r"[A-Za-z0-9_+/-]{24,}={0,2}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping local@domain: a local part ends at an @, so each @ is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of all base matches, by start and kind; code points, end exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The field's nodes as (start, end), and the label that is observed for each (0 if none)."""
    nodes = [(a, b, k + 1) for a, k, b in spans]
    taken = sorted((a, b) for a, _, b in spans)
    j = 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        if not _ASKED.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE + ".":
            b -= 1
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if a < b and not (j < len(taken) and taken[j][0] < b):
            nodes.append((a, b, 0))
    nodes.sort()
    return [(a, b) for a, b, _ in nodes], [k for *_, k in nodes]


def _assigned(text: str, start: int) -> bool:
    """Whether an = or a colon stands before, but for spaces and quotes."""
    before = text[max(0, start - 4) : start].rstrip(" \"'`")
    return before.endswith(("=", ":"))


#: Number of buckets of each feature.
BUCKETS = (2, 8, 5, 4, 2, 2, 3, 2, 6, 2, 2)


#: Features of a word whose shape is hidden.
HIDDEN = (-1,) * len(BUCKETS)


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Buckets of what a word's shape and the sign before it say, without asking whether a base pattern matches it."""
    word = text[start:end]
    n = len(word)
    digits = sum(map(word.count, "0123456789"))
    letters = sum(map(str.isalpha, word))
    plain = sum(c.isascii() and c.isalnum() for c in word)
    return (
        int("@" in word),
        sum(digits >= x for x in (1, 2, 4, 7, 9, 12, 20)),
        sum(letters * 10 >= n * x for x in (1, 3, 6, 9)),
        min(word.count("."), 3),
        int(word.startswith("+")),
        int("(" in word or ")" in word),
        min(word.count("-"), 2),
        int("/" in word or "=" in word or "_" in word),
        sum(n >= x for x in (4, 8, 12, 20, 32)),
        int(plain == n),
        int(_assigned(text, start)),
    )


def _taught(text: str, start: int, end: int, observed: int) -> int:
    """The label that a word teaches: that of its base span, or secret for key-like words, or other."""
    if observed:
        return observed
    word = text[start:end]
    mixed = _KEYLIKE.fullmatch(word) and sum(map(word.count, "0123456789")) >= 4 and sum(map(str.isalpha, word)) >= 4
    return LABELS.index("secret") if mixed and _assigned(text, start) else 0


def forms(word: str) -> list[str]:
    """Keys under which similar words meet: letters and digits alone, the last ten digits of a long number, the name before an @."""
    plain = re.sub(r"[\W_]", "", word).lower()
    digits = re.sub(r"[^0-9]", "", word)
    out = [plain] if len(plain) >= 7 else []
    if len(digits) >= 9 and not any(map(str.isalpha, word)):
        out.append("#" + digits[-10:])
    name = re.sub(r"[\W_]", "", word.partition("@")[0]).lower()
    if "@" in word and len(name) >= 4:
        out.append("@" + name)
    return out


def skip_edges(words: list[str]) -> list[tuple[int, int]]:
    """Each word with the first and the last one before it of each of its forms, so edges are as many as words."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    ends = {}
    for i, w in enumerate(words):
        for form in forms(w):
            if form in first:
                ends[first[form], i] = ends[last[form], i] = None
            else:
                first[form] = i
            last[form] = i
    return [(a, b) for a, b in ends if a != b]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _one_hot(rows: np.ndarray) -> np.ndarray:
    """One column for each bucket of each feature (a hidden one, -1, has none), and a constant."""
    offsets = np.cumsum([0, *BUCKETS[:-1]])
    out = np.zeros((len(rows), sum(BUCKETS) + 1))
    out[:, -1] = 1
    np.put_along_axis(out, np.where(rows < 0, len(out.T) - 1, rows + offsets).astype(np.int64), 1, axis=1)
    return out


class Field:
    """Weights: (feature buckets, labels) of the words, (labels, labels) of neighbours, and one of skip edges."""

    def __init__(self, shape: np.ndarray, chain: np.ndarray, skip: float):
        self.shape, self.chain, self.skip = shape, chain, skip

    @classmethod
    def learned(cls, rows: np.ndarray, counts: np.ndarray, steps: int = 600) -> Field:
        """Weights by maximum pseudo-likelihood: each word's label given its features and its neighbours' labels.

        rows: features, label, label before, label after (-1: none), and how
        many skip neighbours have each label; counts: how often each row occurs.
        """
        k, n = len(LABELS), len(BUCKETS)
        shape, chain, skip = np.zeros((sum(BUCKETS) + 1, k)), np.zeros((k, k)), 0.0
        if len(rows):
            x, y, before, after, met = _one_hot(rows[:, :n]), np.eye(k)[rows[:, n]], rows[:, n + 1], rows[:, n + 2], rows[:, n + 3 :]
            share = counts / counts.sum()
            sizes = [shape.size, chain.size, 1]
            w, mean, square = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))
            for step in range(1, steps + 1):
                shape, chain, skip = w[: sizes[0]].reshape(shape.shape), w[sizes[0] : -1].reshape(chain.shape), float(w[-1])
                z = x @ shape + np.where(before[:, None] < 0, 0, chain[before]) + np.where(after[:, None] < 0, 0, chain.T[after]) + skip * met
                off = (y - np.exp(z - _log_sum(z, 1)[:, None])) * share[:, None]
                grad = np.zeros_like(chain)
                np.add.at(grad, before[before >= 0], off[before >= 0])
                np.add.at(grad.T, after[after >= 0], off[after >= 0])
                # steps of a like size for rare and frequent buckets (Adam); the pull to 0 bounds weights that nothing contradicts
                g = np.concatenate([(x.T @ off).ravel(), grad.ravel(), [float((off * met).sum())]]) - 1e-5 * w
                mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
                w = w + 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            shape, chain, skip = w[: sizes[0]].reshape(shape.shape), w[sizes[0] : -1].reshape(chain.shape), max(float(w[-1]), 0.0)
        return cls(shape, chain, skip)

    def beliefs(self, rows: np.ndarray, observed: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marginals of the words' labels by loopy sum-product; observed labels are certain.

        rows: features; chain and skip: edges (n, 2).  Words of several texts
        can be given at once, as no edge joins them.
        """
        k = len(LABELS)
        unary = _one_hot(rows) @ self.shape
        seen = observed > 0
        unary[seen] = -50.0
        unary[seen, observed[seen]] = 0.0
        a, b = np.concatenate([chain, skip]).T
        pots = np.concatenate([np.broadcast_to(self.chain, (len(chain), k, k)), np.broadcast_to(self.skip * np.eye(k), (len(skip), k, k))])
        forth, back = np.zeros((len(a), k)), np.zeros((len(a), k))
        for _ in range(ROUNDS if len(a) else 0):
            total = unary.copy()
            np.add.at(total, b, forth)
            np.add.at(total, a, back)
            new_forth = _log_sum((total[a] - back)[:, :, None] + pots, 1)
            new_back = _log_sum((total[b] - forth)[:, None, :] + pots, 2)
            new_forth -= _log_sum(new_forth, 1)[:, None]
            new_back -= _log_sum(new_back, 1)[:, None]
            change = max(np.abs(new_forth - forth).max(), np.abs(new_back - back).max())
            forth, back = new_forth, new_back
            if change < SETTLED:
                break
        total = unary.copy()
        np.add.at(total, b, forth)
        np.add.at(total, a, back)
        return np.exp(total - _log_sum(total, 1)[:, None])

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """(base spans, added spans) of each text, each span as (start, kind's index, end)."""
        out, nodes, rows, observed, owner = [], [], [], [], []
        chain, skip = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for t, text in enumerate(texts):
            base = base_spans(text)
            own, labels = candidates(text, base)
            out.append((base, []))
            if all(labels):
                # no word is left to decide on
                continue
            at = len(nodes)
            chain.append(np.stack([np.arange(len(own) - 1), np.arange(1, len(own))], axis=1) + at)
            skip.append(np.array(skip_edges([text[a:b] for a, b in own]), np.int64).reshape(-1, 2) + at)
            nodes += own
            rows += [features(text, a, b) for a, b in own]
            observed += labels
            owner += [t] * len(own)
        if nodes:
            p = self.beliefs(np.array(rows), np.array(observed), np.concatenate(chain), np.concatenate(skip))
            best, most = p.argmax(axis=1), p.max(axis=1)
            for i in np.flatnonzero((np.array(observed) == 0) & (best > 0) & (most >= CERTAIN)).tolist():
                out[owner[i]][1].append((nodes[i][0], int(best[i]) - 1, nodes[i][1]))
        return out


@lru_cache(4)
def _field(shape: bytes, chain: bytes, skip: float) -> Field:
    k = len(LABELS)
    return Field(np.frombuffer(shape).reshape(-1, k), np.frombuffer(chain).reshape(k, k), skip)


def _may_match(part: pa.RecordBatch) -> np.ndarray:
    """Which rows hold a digit or an @ at all."""
    data, offsets = buffers(strings(part.column("text")))
    upto = np.concatenate([[0], np.cumsum((data - np.uint8(48) < 10) | (data == 64))])
    return upto[offsets[1:]] > upto[offsets[:-1]]


def _lessons(text: str) -> list[tuple[int, ...]]:
    """A row of Field.learned for each candidate word of a text; three or more skip neighbours with a label count as three.

    A word without a label that a skip edge ties to one with a label teaches
    nothing: it is for the field to decide.  Every other word teaches twice, once
    with its shape and its neighbours hidden: a base pattern is a matter of shape
    alone, so what skip edges say is learned where nothing else is known.
    """
    nodes, observed = candidates(text, base_spans(text))
    labels = [_taught(text, a, b, o) for (a, b), o in zip(nodes, observed, strict=True)]
    met = np.zeros((len(nodes), len(LABELS)), np.int64)
    for a, b in skip_edges([text[a:b] for a, b in nodes]):
        met[a, labels[b]] += 1
        met[b, labels[a]] += 1
    padded = [-1, *labels, -1]
    out = []
    for i in range(len(nodes)):
        if labels[i] or not met[i, 1:].any():
            ties = np.minimum(met[i], 3).tolist()
            out += [(*features(text, *nodes[i]), labels[i], padded[i], padded[i + 2], *ties), (*HIDDEN, labels[i], -1, -1, *ties)]
    return out


def learn(docs: DataFrame, lessons: int = LESSONS) -> Field:
    """The field learned from the words of all whole texts.

    Tasks count equal rows of buckets and labels over all documents; the field is
    fitted to the given number of distinct ones, those that occur most often
    (ties by the row), so what reaches the driver is bounded at any size of the
    corpus.  Null text counts as empty; an empty table gives a field that adds
    nothing.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                texts = part.column("text")
                for i in np.flatnonzero(_may_match(part)).tolist():
                    found.update(_lessons(texts[i].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([bytes(x + 1 for x in row) for row in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["row", "n"])

    rows = docs.select("text").mapInArrow(count, "row binary, n long").groupBy("row").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "row").limit(lessons).collect()
    rows.sort(key=lambda r: r.row)
    width = len(BUCKETS) + 3 + len(LABELS)
    return Field.learned(np.array([list(r.row) for r in rows], np.int64).reshape(-1, width) - 1, np.array([r.n for r in rows], float))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive, by start and kind.

    Null text counts as empty and has no spans; rows that repeat an id each have
    their own; an empty table gives an empty result; a text may be of any
    length; other columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    shape, chain, skip = field.shape.tobytes(), field.chain.tobytes(), float(field.skip)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": ALL_KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _field(shape, chain, skip)
        for batch in batches:
            for part in blocks(batch) if batch.num_rows else ():
                base: list[list] = [[]] * part.num_rows
                added: list[list] = [[]] * part.num_rows
                texts = part.column("text")
                asked = np.flatnonzero(_may_match(part)).tolist()
                for i, (x, y) in zip(asked, own.spans([texts[i].as_py() for i in asked]), strict=True):
                    base[i], added[i] = listed(x), listed(y)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, base {spans}, added {spans}")
