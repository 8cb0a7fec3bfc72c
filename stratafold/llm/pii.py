"""Personal data: patterns, and a character-level BiLSTM with CRF transitions beside them."""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows
from stratafold.llm.crf import Adam, gradient, viterbi
from stratafold.llm.lstm import BiLstm
from stratafold.session import pin

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, how far windows overlap, context around digits and at signs.
WINDOW, OVERLAP, CONTEXT = 64, 24, 20
#: Windows that the model is trained on, at most; steps, and windows a step; size of the model.
TRAINED, STEPS, BATCH, HIDDEN, EMBEDDED = 900, 500, 48, 20, 10
#: Altered copies of each window with a span that the model is also trained on.
COPIES = 3
#: Windows that are scored together.
TOGETHER = 256

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match starts inside a run of digits: it would end where the one from its start ends
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]+|[(\[{]\x20?(?:at|dot|\.)\x20?[)\]}]", re.IGNORECASE)
_AT = re.compile(r"\x20*[(\[{]\x20?at\x20?[)\]}]\x20*", re.IGNORECASE)
_DOT = re.compile(r"\x20*[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20*", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTED_CARD = re.compile(r"[0-9](?:[\x20./_-]{0,3}[0-9])+")
_PARTED_PHONE = re.compile(r"[+(]?[0-9]+(?:[\x20()./-]{1,2}[0-9]+)+")

Span = tuple[str, int, int]


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        rest = _DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            found.append(("email", start, rest.end()))
            free = rest.end()
        at = text.find("@", max(at + 1, free))
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _card(match: str) -> bool:
    digits = _digits(match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(match: str) -> bool:
    return 9 <= len(_digits(match)) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that pass, by kind and start."""
    found = _emails(text)
    if _DIGIT.search(text):
        tests = (("ip", _IP, _ip), ("card", _CARD, _card), ("phone", _PHONE, _phone))
        for kind, pattern, good in tests:
            found += [(kind, *m.span()) for m in pattern.finditer(text) if good(m[0])]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, at signs and signs in brackets. None of the four kinds does
    without all of them, so all other characters are outside by definition and need no decoding."""
    out: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def windows(start: int, end: int) -> list[int]:
    """Starts of overlapping windows over a region."""
    step = WINDOW - OVERLAP
    return list(range(start, max(start + 1, end - OVERLAP), step))


_CODES = {c: i for i, c in enumerate("@.+-()_%/:,;'\"=#&?!<>[]{}|*$~^\\`\n\t ", 13)}


def _code(char: str) -> int:
    if "0" <= char <= "9":
        return 3 + int(char)
    if char in _CODES:
        return _CODES[char]
    if char.isalpha():
        return 1 if char.islower() else 2
    return 0


CODES = 13 + len(_CODES)
# O, then begin and inside of each kind
TAGS = 1 + 2 * len(KINDS)


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros((len(texts), WINDOW), np.int64)
    mask = np.zeros((len(texts), WINDOW))
    for i, text in enumerate(texts):
        codes[i, : len(text)] = [_code(c) for c in text]
        mask[i, : len(text)] = 1
    return codes, mask


@dataclass
class Tagger:
    """Embeddings of character codes, the network and the transitions between tags."""

    embedding: np.ndarray
    network: BiLstm
    moves: np.ndarray

    @staticmethod
    def new() -> Tagger:
        rng = np.random.default_rng(3)
        moves = np.zeros((TAGS, TAGS))
        for kind in range(len(KINDS)):
            begin, inside = 1 + 2 * kind, 2 + 2 * kind
            others = [t for t in range(TAGS) if t not in (begin, inside)]
            moves[others, inside] = -8.0  # inside follows its own kind only
        return Tagger(rng.normal(0, 0.5, (CODES, EMBEDDED)), BiLstm(EMBEDDED, HIDDEN, TAGS, 4), moves)

    def emissions(self, texts: list[str]) -> np.ndarray:
        codes, mask = encoded(texts)
        scores = self.network.scores(self.embedding[codes].transpose(1, 0, 2), mask.T)
        return scores.transpose(1, 0, 2)

    def train(self, texts: list[str], tags: np.ndarray) -> None:
        codes, mask = encoded(texts)
        adam = Adam([self.embedding, *self.network.arrays, self.moves], 0.02)
        order = np.random.default_rng(5)
        batches = -(-len(texts) // BATCH)
        rounds = -(-STEPS // batches)
        for number in range(rounds):
            adam.rate = 0.02 * (1 - 0.9 * number / rounds)
            for some in np.array_split(order.permutation(len(texts)), batches):
                x, m = codes[some], mask[some]
                scores, state = self.network.run(self.embedding[x].transpose(1, 0, 2), m.T)
                _, d_scores, d_moves = gradient(scores.transpose(1, 0, 2), tags[some], m, self.moves)
                grads, dx = self.network.gradients(state, d_scores.transpose(1, 0, 2))
                d_embedding = np.zeros_like(self.embedding)
                np.add.at(d_embedding, x, dx.transpose(1, 0, 2))
                adam.step([d_embedding, *grads, d_moves])

    def decode(self, texts: list[str]) -> list[list[Span]]:
        """Spans of whole texts: windows are scored, blended where they overlap, and each
        region is decoded once over its whole length."""
        places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
        cuts = [(r, s) for r, (_, a, b) in enumerate(places) for s in windows(a, b)]
        rise = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
        out: list[list[Span]] = [[] for _ in texts]
        blended = {}
        for at in range(0, len(cuts), TOGETHER):
            some = cuts[at : at + TOGETHER]
            pieces = []
            for r, s in some:
                i, _, b = places[r]
                pieces.append(texts[i][s : min(b, s + WINDOW)])
            scores = self.emissions(pieces)
            for (r, s), piece, emitted in zip(some, pieces, scores):
                _, a, b = places[r]
                if r not in blended:
                    blended[r] = (np.zeros((b - a, TAGS)), np.zeros((b - a, 1)))
                sums, weights = blended[r]
                n, w = len(piece), rise[: len(piece), None]
                sums[s - a : s - a + n] += w * emitted[:n]
                weights[s - a : s - a + n] += w
            for r in [r for r in blended if r < some[-1][0]]:
                self._region(out, places[r], *blended.pop(r))
        for r in list(blended):
            self._region(out, places[r], *blended.pop(r))
        return out

    def _region(self, out, place, sums, weights) -> None:
        i, a, _ = place
        tags = viterbi(sums / np.maximum(weights, 1e-9), self.moves)
        kind, start = -1, 0
        for t, tag in enumerate([*tags.tolist(), 0]):
            inside = tag and tag % 2 == 0 and (tag - 2) // 2 == kind
            if not inside:
                if kind >= 0:
                    out[i].append((KINDS[kind], a + start, a + t))
                kind, start = ((tag - 1) // 2, t) if tag % 2 else (-1, 0)


def _gold(spans: list[list[int]]) -> np.ndarray:
    tags = np.zeros(WINDOW, np.int64)
    for kind, start, end in spans:
        tags[max(start, 0) : min(end, WINDOW)] = 2 + 2 * kind
        if start >= 0:
            tags[start] = 1 + 2 * kind
    return tags


def labelled_windows(docs: DataFrame) -> DataFrame:
    """(window, spans) of windows over all documents, labelled by the patterns."""

    def make():
        def work(batch):
            found, spans = [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                base = base_spans(text)
                for a, b in regions(text):
                    for s in windows(a, b):
                        e = min(b, s + WINDOW)
                        inside = [
                            [KINDS.index(k), x - s, y - s] for k, x, y in base if x < e and y > s
                        ]
                        # a span that the window cuts in two has no clear tags
                        if all(x >= 0 and y <= e - s for _, x, y in inside):
                            found.append(text[s:e])
                            spans.append(inside)
            yield {"window": found, "spans": spans}

        return work

    return arrow_rows(docs.select("text"), make, "window string, spans array<array<int>>")


def _disguised(kind: str, text: str, draw: random.Random) -> str:
    """Personal data in a form that the patterns don't know: spelled signs, other separators, no plus."""
    if kind == "email":
        local, _, host = text.partition("@")
        dot = draw.choice((".", ".", "[.]", "(dot)", " [dot] "))
        return local + draw.choice((" [at] ", "[at]", "(at)", " (at) ")) + host.replace(".", dot)
    if kind == "ip":
        return text.replace(".", draw.choice(("[.]", "(.)", "[dot]")))
    digits = _digits(text)
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return draw.choice((".", "/", "_", " - ", "  ")).join(groups)
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    forms = (f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-7]} {b} {c}")
    return draw.choice(forms)


def altered(window: str, spans: tuple, h: int) -> tuple[str, tuple] | None:
    """The window with all its data disguised; none if that doesn't fit or spans overlap."""
    draw, out, at, found = random.Random(h), "", 0, []
    for kind, start, end in sorted(spans, key=lambda x: x[1]):
        if start < at:
            return None
        out += window[at:start]
        piece = _disguised(KINDS[kind], window[start:end], draw)
        found.append((kind, len(out), len(out) + len(piece)))
        out, at = out + piece, end
    if not found or found[-1][2] > WINDOW:
        return None
    return (out + window[at:])[:WINDOW], tuple(found)


def train(docs: DataFrame, most: int = TRAINED) -> Tagger:
    """A tagger from at most ``most`` labelled windows, those with the smallest digests: a third
    without a span, a sixth for each kind, and COPIES of each with its data disguised. Without
    windows it tags nothing."""
    part = F.coalesce(F.array_max(F.transform("spans", lambda s: s[0])), F.lit(-1))
    rows = pin(
        labelled_windows(docs).withColumns({"part": part, "h": F.xxhash64("window")}), "pii-windows"
    )
    picked = []
    for number in range(-1, len(KINDS)):
        some = rows.where(F.col("part") == number).orderBy("h", "window")
        found = some.limit(most // 3 if number < 0 else most // 6).collect()
        chosen = sorted({(r.window, tuple(map(tuple, r.spans))) for r in found})
        copies = [altered(w, x, i) for w, x in chosen for i in range(COPIES)]
        picked += chosen + [c for c in copies if c]
    tagger = Tagger.new()
    if picked:
        tagger.train([w for w, _ in picked], np.array([_gold(spans) for _, spans in picked]))
    else:
        tagger.network.arrays[-1][0] = 50.0
    return tagger


def _plausible(kind: str, text: str) -> bool:
    """Whether a decoded stretch is of its kind once spelled signs and separators are put right."""
    if kind == "email":
        return bool(_ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == "ip":
        plain = _DOT.sub(".", text)
        return bool(_IP.fullmatch(plain)) and _ip(plain)
    if kind == "card":
        return bool(_PARTED_CARD.fullmatch(text)) and _card(text)
    return bool(_PARTED_PHONE.fullmatch(text)) and _phone(text)


def all_spans(base: list[Span], decoded: list[Span], text: str) -> list[Span]:
    """Base spans, and decoded ones (by start, apart) that are plausible and touch none of them."""
    taken, out, k, reach = sorted((s, e) for _, s, e in base), list(base), 0, 0
    for kind, s, e in decoded:
        while k < len(taken) and taken[k][0] < e:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= s and _plausible(kind, text[s:e]):
            out.append((kind, s, e))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    Counts and digest are of the patterns' spans; ``spans`` has those and the tagger's. Places
    are code points of the text, ends exclusive. The tagger is trained on ``docs`` if none is
    given.

    A null or empty text has no spans. A null or repeated doc_id is kept like any other row.
    Texts of any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(docs))

    def make():
        model = shared.value

        def work(batch):
            texts = [t.as_py() or "" for t in batch["text"]]
            out = {f"n_{k}": [] for k in KINDS}
            out |= {"base_sha256": [], "spans": [], "doc_id": batch["doc_id"].to_pylist()}
            for text, decoded in zip(texts, model.decode(texts)):
                base = base_spans(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(all_spans(base, decoded, text)))
            yield out

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    return arrow_rows(docs.select("doc_id", "text"), make, schema)
