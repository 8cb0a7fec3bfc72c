"""Secrets: patterns, and a linear-chain conditional random field over tokens beside them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows
from stratafold.llm.crf import Adam, gradient
from stratafold.session import pin

KINDS = ("assign", "access", "hex")
#: What the field finds beside the patterns is listed under this kind, after the others.
FIELD = "field"
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Documents learned from, at most, of those a pattern may match and of the others.
LEARNED = 4000
#: Windows with digits or a secret learned from, at most, and without; passes; hashed features; tokens of context on either side.
TRAINED, EPOCHS, FEATURES, CONTEXT = 1200, 40, 1 << 16, 8
#: Places, relative to a token, whose tokens are among its features; tokens whose scores are kept.
STEPS, SCORED = (-3, -2, -1, 1, 2), 200_000
#: Characters of texts that are decoded together, about.
TOGETHER = 1 << 20
#: Java form of what every match of a pattern contains.
SUSPECT = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|(?-i)AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
#: What may introduce a secret in altered copies, beside nothing at all.
LEADS = ((), ("credential", ":"), ("auth", "="), ("key", "is"), ("bearer",), ("-", "-", "pass"), ("pwd", ":"))
#: Alphabets of the secrets in altered copies.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-",
)

Span = tuple[str, int, int]
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\s!-~]+|\S")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that pass, by start, then kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # shorter runs are matches that fail; a run is one match, so passing them over is the same
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _values(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """The secret part of every base span: of an assignment what is assigned."""
    out = []
    for kind, s, e in base:
        m = ASSIGN.match(text, s) if kind == "assign" else None
        out.append(m.span(2) if m else (s, e))
    return out


def file_features(text: str) -> list[str]:
    """What a file as a whole shows: how much of it is marks of code, and its size."""
    marks = sum(text.count(c) for c in "={};_")
    level = int(np.log2(1 + 1000 * marks / max(1, len(text))))
    return [f"file:marks={level}", f"file:size={len(text).bit_length()}"]


def _cell(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _cells(name: str, count: int) -> np.ndarray:
    return np.array([_cell(f"{name}={i}") for i in range(count)])


#: Cells of what a token can look like: which kinds of characters it has and how often they change,
#: its size, its share of digits and of different characters, digits with letters, all of it at once.
SHAPES, SIZES, DIGITS, VARIETY, MIXED = (
    _cells(name, n)
    for name, n in (("shape", 512), ("size", 13), ("digits", 11), ("variety", 11), ("mixed", 4))
)
LOOKS = _cells("look", 512 * 13)
#: The same of a token's neighbours.
BESIDE = [
    (_cells(f"{step}:shape", 512), _cells(f"{step}:size", 13)) for step in STEPS if abs(step) == 1
]
#: Own features of a token; features it gives to its neighbours by its word and by its looks.
OWN, NEAR = 7, [k for k, step in enumerate(STEPS) if abs(step) == 1]
_PRIME, _ODD = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
FILE_MARKS, FILE_SIZES = _cells("file:marks", 12), _cells("file:size", 64)


def _hashed(h: np.ndarray, salt: int) -> np.ndarray:
    mixed = (h + np.uint64((salt + 1) * int(_ODD) % (1 << 64))) * _ODD
    return ((mixed ^ (mixed >> np.uint64(29))) * _ODD >> np.uint64(40)).astype(np.int64) % FEATURES


def looks(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of many tokens at once: own (n, OWN), by word for each of STEPS, by looks for
    each token next to it (n, sides, 2); and how many marks of code each holds."""
    points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(sizes) - sizes
    upper, lower = (points > 64) & (points < 91), (points > 96) & (points < 123)
    digit, wide = (points > 47) & (points < 58), points > 126
    sort = np.select([upper, lower, digit, wide], [1, 2, 3, 4], 0)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), starts)

    change = np.concatenate([[False], sort[1:] != sort[:-1]])
    change[starts] = False
    changes, digits, uppers, lowers = total(change), total(digit), total(upper), total(lower)
    kinds = (uppers > 0) + 2 * (lowers > 0) + 4 * (digits > 0)
    kinds = kinds + 8 * (total(wide) > 0) + 16 * (total(sort == 0) > 0)
    shape, size = kinds * 16 + np.minimum(changes, 15), np.minimum(sizes, 48) // 4
    place = np.repeat(np.arange(len(tokens)), sizes)
    keys = np.sort((place << 21) | points)
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    variety = 10 * np.bincount(keys[fresh] >> 21, minlength=len(tokens)) // sizes
    within = np.arange(len(points)) - np.repeat(starts, sizes)
    powers = np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _PRIME)]).cumprod()
    letters = (points + np.where(upper, 32, 0)).astype(np.uint64) * powers[within]
    word = np.add.reduceat(letters, starts)
    start = np.add.reduceat(np.where(within < 4, letters, np.uint64(0)), starts)
    mixed = (digits > 0) * 1 + (uppers + lowers > 0) * 2
    own = np.stack(
        [
            SHAPES[shape],
            SIZES[size],
            DIGITS[10 * digits // sizes],
            VARIETY[variety],
            MIXED[mixed],
            LOOKS[shape * 13 + size],
            _hashed(start, len(STEPS)),
        ],
        1,
    )
    words = np.stack([_hashed(word, k) for k in range(len(STEPS))], 1)
    beside = np.stack([np.stack([a[shape], b[size]], 1) for a, b in BESIDE], 1)
    marks = total(np.isin(points, np.frombuffer(b"={};_", np.uint8)))
    return own, words, beside, marks


#: Features that the end of a text gives to the tokens STEPS away.
EDGES = [_cell(f"{step}:edge") for step in STEPS]


def features(tokens: list[str], start: int, end: int, whole: list[str]) -> list[list[int]]:
    """Hashed features of the tokens from ``start`` to ``end``: own, their neighbours' and the file's."""
    own, words, beside, _ = looks(tokens)
    file, out = [_cell(x) for x in whole], []
    for i in range(start, end):
        ids = [*own[i].tolist(), *file]
        for k, step in enumerate(STEPS):
            inside = 0 <= i + step < len(tokens)
            ids.append(int(words[i + step, k]) if inside else EDGES[k])
            if inside and k in NEAR:
                ids += beside[i + step, NEAR.index(k)].tolist()
        out.append(ids)
    return out


class _Scores(dict):
    """Row of ``table`` by token: what it adds to its own scores and to those STEPS away.

    Row 0 is the end of a text. It is outside whatever the weights are.
    """

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.table, self.marks = np.zeros((1024, 1 + len(STEPS), 3)), np.zeros(1024, np.int64)
        self.table[0, 0, 1:] = -1e9
        self.table[0, 1:] = weights[EDGES]
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        row = self[token] = len(self) + 1
        self.fresh.append(token)
        return row

    def _fill(self) -> None:
        own, words, beside, marks = looks(self.fresh)
        end = len(self) + 1
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
        part = self.table[end - len(self.fresh) : end]
        part[:, 0] = self.weights[own].sum(1)
        part[:, 1:] = self.weights[words]
        part[:, [1 + k for k in NEAR]] += self.weights[beside].sum(2)
        self.marks[end - len(self.fresh) : end] = marks
        self.fresh = []

    def of(self, texts: list[list[str]], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (T, 3) of the tokens of some texts of so many characters, with ends of texts
        before, between and behind them, and the place of each text's first token."""
        if len(self) > SCORED:
            self.clear()
        gap = max(map(abs, STEPS))
        counts = np.array([len(x) for x in texts], np.int64)
        first = np.cumsum(counts + gap) - counts
        rows = np.zeros(int(counts.sum()) + gap * (len(texts) + 1), np.int64)
        for at, tokens in zip(first.tolist(), texts):
            rows[at : at + len(tokens)] = np.fromiter(
                map(self.__getitem__, tokens), np.int64, len(tokens)
            )
        if self.fresh:
            self._fill()
        out = self.table[rows, 0]
        for k, step in enumerate(STEPS):
            here, there = max(0, -step), max(0, step)
            size = len(rows) - abs(step)
            out[here : here + size] += self.table[rows[there : there + size], 1 + k]
        sums = np.concatenate([[0], np.cumsum(self.marks[rows])])
        marks = sums[first + counts] - sums[first]
        level = np.log2(1 + 1000 * marks / np.maximum(1, sizes)).astype(np.int64)
        lengths = np.array([n.bit_length() for n in sizes], np.int64)
        file = self.weights[FILE_MARKS[level]] + self.weights[FILE_SIZES[lengths]]
        out += np.repeat(np.concatenate([np.zeros((1, 3)), file]), np.append(gap, counts + gap), 0)
        out[rows == 0] = (0.0, -1e9, -1e9)
        return out, first


def surely_outside(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that the best path leaves outside whatever their neighbours' tags are.

    A token is one if for either other tag, and whatever stands before and behind it, the path is
    better with the token outside; an inside token behind it may become a begin one for that.
    """
    later = np.append(scores[1:, 1] - scores[1:, 2], 0.0)
    turned = later + (moves[1] - moves[2]).min()
    sure = np.ones(len(scores), bool)
    for tag in (1, 2):
        gain = scores[:, 0] - scores[:, tag] + (moves[:, 0] - moves[:, tag]).min()
        sure &= gain + (moves[0, :2] - moves[tag, :2]).min() > 0
        inside = np.maximum(moves[0, 2], moves[0, 1] + turned) - moves[tag, 2]
        sure &= gain + inside > 0
    return sure


def best_tags(scores: np.ndarray, free: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of scores (T, 3) where only ``free`` tokens can be tagged.

    All others, and what stands before and after the text, are outside, so that stretches of free
    tokens don't depend on each other: those of one length are decoded together.
    """
    tags = np.zeros(len(scores), np.int64)
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    starts, lengths = bounds[::2], bounds[1::2] - bounds[::2]
    for length in np.unique(lengths).tolist():
        at = starts[lengths == length]
        best = np.empty((length, len(at), 3), np.int64)
        reach = scores[at] + moves[0]
        for t in range(1, length):
            steps = reach[:, :, None] + moves
            best[t] = steps.argmax(1)
            reach = steps.max(1) + scores[at + t]
        tags[at + length - 1] = (reach + moves[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            tags[at + t - 1] = best[t, np.arange(len(at)), tags[at + t]]
    return tags


@dataclass
class Field:
    """Weights of hashed features by tag (outside, begin, inside), and of transitions."""

    weights: np.ndarray
    moves: np.ndarray

    @staticmethod
    def new() -> Field:
        moves = np.zeros((3, 3))
        moves[0, 2] = -8.0  # inside follows begin or inside
        return Field(np.zeros((FEATURES + 1, 3)), moves)

    def train(self, found: list[list[list[int]]], tags: list[list[int]]) -> None:
        n, length = len(found), max(map(len, found))
        wide = max(len(x) for run in found for x in run)
        ids = np.full((n, length, wide), FEATURES)
        gold, mask = np.zeros((n, length), np.int64), np.zeros((n, length))
        for i, (run, marks) in enumerate(zip(found, tags)):
            for j, x in enumerate(run):
                ids[i, j, : len(x)] = x
            gold[i, : len(marks)], mask[i, : len(marks)] = marks, 1
        adam = Adam([self.weights, self.moves], 0.1)
        for _ in range(EPOCHS):
            _, d, d_moves = gradient(self.weights[ids].sum(2), gold, mask, self.moves)
            spread = np.zeros_like(self.weights)
            for k in range(3):
                per = np.repeat(d[:, :, k].ravel(), wide)
                spread[:, k] = np.bincount(ids.ravel(), per, FEATURES + 1)
            spread += 1e-4 * self.weights
            spread[FEATURES] = 0
            adam.step([spread, d_moves])

    def decoder(self):
        """texts -> for each the spans that Viterbi tags."""
        known = _Scores(self.weights)

        def decode(texts: list[str]) -> list[list[Span]]:
            split = [_TOKEN.findall(x) for x in texts]
            scores, first = known.of(split, [len(x) for x in texts])
            tags = best_tags(scores, ~surely_outside(scores, self.moves), self.moves)
            tagged = np.flatnonzero(tags)
            out: list[list[Span]] = [[] for _ in texts]
            for i in np.unique(np.searchsorted(first, tagged, "right") - 1).tolist():
                out[i] = _tagged(texts[i], tags[first[i] : first[i] + len(split[i])].tolist())
            return out

        return decode

    def decode(self, text: str) -> list[Span]:
        return self.decoder()([text])[0]


def _tagged(text: str, tags: list[int]) -> list[Span]:
    """Spans of begin and inside tokens, without full stops at the end."""
    parts: list[list[int]] = []
    for m, tag in zip(_TOKEN.finditer(text), tags):
        if tag == 2 and parts and parts[-1][2]:
            parts[-1][1] = m.end()
        elif tag:
            parts.append([m.start(), m.end(), 1])
        elif parts:
            parts[-1][2] = 0
    trimmed = ((s, s + len(text[s:e].rstrip("."))) for s, e, _ in parts)
    return [(FIELD, s, e) for s, e in trimmed if e > s]


def _marks(text: str) -> tuple[list[int], list[bool]]:
    """Tags of all tokens by the patterns, and which tokens say nothing.

    Values with letters and digits are secrets. Numbers aren't, whoever matches them; values of
    letters alone may be words, so nothing is learned from where they stand.
    """
    parts = sorted(set(_values(text, base_spans(text))))
    marks, unsure, last, k = [], [], -1, 0
    for m in _TOKEN.finditer(text):
        while k < len(parts) and parts[k][1] <= m.start():
            k += 1
        inside = k < len(parts) and parts[k][0] < m.end()
        value = text[slice(*parts[k])] if inside else ""
        letters, digits = _LETTER.search(value), _DIGIT.search(value)
        mark = (2 if k == last else 1) if letters and digits else 0
        last = k if mark else -1
        marks.append(mark)
        unsure.append(bool(inside and letters and not digits))
    return marks, unsure


def windows(marks: list[int], unsure: list[bool]) -> list[tuple[int, int]]:
    """Places (from, to) of stretches of tokens, secrets whole, without unsure tokens."""
    out, start = [], 0
    while start < len(marks):
        end = min(len(marks), start + 2 * CONTEXT)
        while end < len(marks) and marks[end] == 2:
            end += 1
        if not any(unsure[start:end]):
            out.append((start, end))
        start = end
    return out


def altered(near: list[str], start: int, tags: list[int], h: int) -> tuple[list[str], int, list[int]]:
    """A copy of a window with another secret, made of another alphabet, for each of its secrets,
    and another introduction, or half the time none, for the marks and keyword that stand before
    the first one; quotes behind a secret go."""
    draw = random.Random(h)
    first = start + tags.index(1)
    tokens, marks = list(near), [0] * start + list(tags) + [0] * (len(near) - start - len(tags))
    behind = len(near) - start - len(tags)
    kept = []
    for t, m in zip(tokens, marks):
        if m == 1:
            letters, n = draw.choice(ALPHABETS), draw.randrange(14, 45)
            kept.append(("".join(draw.choice(letters) for _ in range(n)), 1))
        elif m == 0 and not (kept and kept[-1][1] and t in "\"'" and len(kept) < len(near) - behind):
            kept.append((t, 0))
    back = first
    while back > start and (not kept[back - 1][0].isalnum() or kept[back - 1][0].lower() in WORDS):
        back -= 1
    lead = [(t, 0) for t in draw.choice(LEADS)] if draw.random() < 0.5 else []
    kept = kept[:back] + lead + kept[first:]
    behind = min(behind, len(kept) - back - len(lead) - 1)
    size = len(kept) - start - behind
    return [t for t, _ in kept], start, [m for _, m in kept][start : start + size]


def labelled_windows(docs: DataFrame, most: int) -> DataFrame:
    """(h, kind, near, start, whole, tags) of windows of all documents, labelled by the patterns;
    ``near`` has the window's tokens from ``start`` on, and the neighbours that features look at.

    Kind is 2 with a secret, 1 without one but with digits, else 0. Of
    each kind a batch hands on only its ``most`` smallest digests, which hold those of the table.
    """

    def make():
        def work(batch):
            found: list[dict[int, tuple]] = [{}, {}, {}]
            for value in batch["text"]:
                text = value.as_py() or ""
                tokens, whole = _TOKEN.findall(text), file_features(text)
                marks, unsure = _marks(text)
                for a, b in windows(marks, unsure):
                    low = max(0, a + STEPS[0])
                    tags, near = marks[a:b], tokens[low : b + STEPS[-1]]
                    raw = "\n".join((*near, *whole, f"{a - low} {tags}"))
                    h = xxhash.xxh3_64_intdigest(raw.encode("utf-8", "surrogatepass")) >> 1
                    kind = 2 if any(tags) else int(any(map(_DIGIT.search, tokens[a:b])))
                    found[kind].setdefault(h, (near, a - low, whole, tags))
                for some in found:
                    if len(some) > 4 * most:
                        for h in sorted(some)[most:]:
                            del some[h]
            rows = [
                (h, kind, *some[h]) for kind, some in enumerate(found) for h in sorted(some)[:most]
            ]
            names = ("h", "kind", "near", "start", "whole", "tags")
            yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return work

    schema = "h long, kind int, near array<string>, start int, whole array<string>, tags array<int>"
    return arrow_rows(docs.select("text"), make, schema)


def learned(docs: DataFrame, most: int = LEARNED) -> DataFrame:
    """(text) of at most ``most`` different documents that a pattern may match and as many others,
    those with the smallest digests; only digests are shuffled, and the chosen texts."""
    texts = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    hit = F.col("text").rlike(SUSPECT)
    digests = pin(texts.select("h", hit.alias("hit")).distinct(), "secret-digests")
    chosen, highest = F.lit(False), None
    for kind in (True, False):
        some = digests.where(F.col("hit") == kind).select("h").orderBy("h").limit(most)
        top = some.agg(F.max("h")).first()[0]
        if top is not None:
            chosen = chosen | ((hit == kind) & (F.col("h") <= top))
            highest = top if highest is None else max(highest, top)
    if highest is not None:
        texts = texts.where(F.col("h") <= highest)
    return texts.where(chosen).groupBy("h").agg(F.first("text").alias("text")).select("text")


def train(docs: DataFrame, most: int = TRAINED) -> Field:
    """A field from at most ``most`` distinct labelled windows with digits or a secret, half of them
    with a secret, and as many without either, those with the smallest digests, of the documents
    that ``learned`` picks; altered copies bring the windows with a secret up to ``most``. Without
    windows it finds nothing."""
    rows = pin(labelled_windows(learned(docs), most), "secret-runs")
    picked = []
    for kind, share in enumerate((1, 2, 2)):
        some = rows.where(F.col("kind") == kind).dropDuplicates(["h"]).orderBy("h")
        chosen = some.limit(most // share).collect()
        for r in chosen:
            forms = [(r.near, r.start, list(r.tags))]
            if 1 in r.tags:
                copies = -(-most // len(chosen)) - 1
                forms += [altered(r.near, r.start, r.tags, r.h + k) for k in range(copies)]
            for near, start, tags in forms:
                picked.append((features(near, start, start + len(tags), r.whole), tags))
    field = Field.new()
    if picked:
        field.train([x for x, _ in picked], [t for _, t in picked])
    return field


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    """Both by start, then kind, without those of ``more`` that touch one of ``base``."""
    order, out, k, reach = [*KINDS, FIELD], list(base), 0, 0
    for span in more:
        while k < len(base) and base[k][1] < span[2]:
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= span[1]:
            out.append(span)
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def _together(column) -> Iterator[list[str]]:
    """The texts of a column in order, in lists of about TOGETHER characters; null is empty."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``.

    Counts and digest are of the patterns' spans; ``spans`` has those and the field's, of kind
    ``field``. Places are code points of the text, ends exclusive. The field is trained on
    ``docs`` if none is given.

    A null or empty text has no spans. A null or repeated doc_id is kept like any other row.
    Texts of any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def make():
        decode = shared.value.decoder()

        def work(batch):
            out = {f"n_{k}": [] for k in KINDS}
            out |= {"base_sha256": [], "spans": [], "doc_id": batch["doc_id"].to_pylist()}
            for texts in _together(batch["text"]):
                for text, more in zip(texts, decode(texts)):
                    base = base_spans(text)
                    for kind in KINDS:
                        out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    out["base_sha256"].append(digest)
                    out["spans"].append(joined(merged(base, more)))
            yield out

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    return arrow_rows(docs.select("doc_id", "text"), make, schema)
