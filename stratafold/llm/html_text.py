"""Main text of web pages: blocks of text, labelled by a recurrent network over the whole page."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows
from stratafold.llm.crf import Adam
from stratafold.llm.lstm import BiLstm

#: Pages learned from, at most, and the longest of them in characters; layouts made of each.
PAGES, LONGEST, LAYOUTS = 160, 30_000, 3
#: Hashed dimensions of the tag path and of the words; size of the network; passes.
PATH, WORD, HIDDEN, EPOCHS, BATCH = 48, 16, 12, 10, 24
#: Blocks of a page that are learned from, at most.
LEARNED = 120

# fixed values: elements of the markup language by what they do to the flow of text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())

_START = re.compile(r"<(?:[!?]|/?[A-Za-z][^\s/>]*)")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
#: Elements around a block, the innermost, that its path names.
DEEP = 64
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_OUTER = re.compile(
    r"nav|menu|foot|side|banner|cookie|consent|notice|promo|advert|\bads?\b|sponsor|comment|reply|"
    r"share|social|related|form|subscribe|newsletter|breadcrumb|masthead|header|popup|modal",
    re.IGNORECASE,
)
_OUTER_TAGS = frozenset(
    "nav header footer aside form script style noscript button select title head template".split()
)


@dataclass
class Block:
    """Text of one block, the elements around it, and how much of it is inside links."""

    text: str
    path: tuple[str, ...]
    linked: float


@dataclass
class _Open:
    name: str
    label: str = ""


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    in_links: int = 0
    blocks: list[Block] = field(default_factory=list)
    opened: Counter[str] = field(default_factory=Counter)

    def pop(self) -> None:
        self.opened[self.stack.pop().name] -= 1

    def end_block(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            around = (x.name + x.label for x in reversed(self.stack) if x.name not in INLINE)
            path = tuple(islice(around, DEEP))[::-1]
            self.blocks.append(Block(text, path, min(1.0, self.in_links / max(1, len(text)))))
        self.parts, self.in_links = [], 0

    def text(self, some: str) -> None:
        self.parts.append(some)
        if self.stack and self.stack[-1].name in INLINE and self.opened["a"]:
            self.in_links += len(some.strip())

    def open(self, tag: str, name: str) -> None:
        if name == "br":
            self.parts.append(" ")
        if name not in INLINE:
            self.end_block()
            while self.stack and self.stack[-1].name in INLINE:
                self.pop()
            if self.stack and self.stack[-1].name in CLOSED_BY_SAME:
                if self.stack[-1].name == name or self.stack[-1].name == "p":
                    self.pop()
        if name not in VOID and not tag.endswith("/>"):
            found = [next(filter(None, m), "") for m in _NAMED.findall(tag)]
            label = "." + ".".join(" ".join(found).lower().split()) if found else ""
            self.stack.append(_Open(name, label))
            self.opened[name] += 1

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        if not self.opened[name]:
            return
        at = len(self.stack) - 1
        while self.stack[at].name != name:
            if name in INLINE and self.stack[at].name not in INLINE:
                return
            at -= 1
        while len(self.stack) > at:
            self.pop()


def blocks(page: str | None) -> list[Block]:
    """Blocks of text in page order, white space in them turned into one space.

    Elements that are never closed end with the next block of their kind; what stands in
    scripts, styles and the like is left out, as are comments of the markup. A tag that the
    page's end cuts off is dropped with what follows. A tag whose quotes never close ends at its
    first ``>``, and from there on quotes don't count. The page is read in one sweep.
    """
    reader, at, text, quoted = _Reader(), 0, page or "", True
    while m := _START.search(text, at):
        if m.start() > at:
            reader.text(text[at : m.start()])
        if text.startswith("<!--", m.start()):
            end = text.find("-->", m.end())
            at = end + 3 if end >= 0 else len(text)
            continue
        closing = _TAG_END.match(text, m.end()) if quoted and text[m.start() + 1] not in "!?" else None
        end = closing.end() if closing else text.find(">", m.end()) + 1
        if not end:
            at = len(text)
            break
        named = _NAME.match(m[0])
        if not named:
            at = end
            continue
        quoted = quoted and closing is not None
        at, tag, name = end, text[m.start() : end], named[1].lower()
        if tag[1] == "/":
            reader.close(name)
        elif name in RAW:
            ends = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(text, at)
            at = ends.end() if ends else len(text)
        else:
            reader.open(tag, name)
    if at < len(text):
        reader.text(text[at:])
    reader.end_block()
    return reader.blocks


def is_main(block: Block) -> bool:
    """The label to learn: inside an article or main element, in nothing that stands beside it."""
    inside = False
    for step in block.path:
        name, _, label = step.partition(".")
        if name in _OUTER_TAGS or (label and _OUTER.search(label)):
            return False
        inside = inside or name in ("article", "main") or bool(
            re.search(r"article|content|post|story|entry", label)
        )
    return inside


INPUTS = PATH + WORD + 8


@lru_cache(20_000)
def _path_cells(path: tuple[str, ...]) -> np.ndarray:
    steps = {f"{s}<{t}" for s, t in zip(("", *path), path)} | {
        x for s in path for x in re.split(r"[.\-_]", s) if x
    }
    cells = [zlib.crc32(s.encode()) % PATH for s in steps]
    return np.bincount(cells, minlength=PATH).astype(float)


@lru_cache(200_000)
def _word_cell(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD


def vectors(found: list[Block]) -> np.ndarray:
    """Tag path and words of every block as hashed vectors, and how long and linked it is."""
    out = np.zeros((len(found), INPUTS))
    last = None
    for i, b in enumerate(found):
        words = b.text.lower().split()
        out[i, :PATH] = _path_cells(b.path)
        cells = np.bincount([_word_cell(w) for w in words], minlength=WORD)
        out[i, PATH : PATH + WORD] = 0.2 * np.log1p(cells)
        n = len(b.text)
        out[i, PATH + WORD :] = [
            math.log1p(n) / 8,
            math.log1p(len(words)) / 6,
            b.linked,
            sum(map(b.text.count, ".,;!?")) / max(1, n) * 10,
            i / max(1, len(found) - 1),
            float(i == 0),
            float(b.path == last),
            1.0,
        ]
        last = b.path
    return out


@dataclass
class Labeller:
    network: BiLstm

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log odds of every block of several pages; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for some in np.array_split(order, max(1, -(-len(order) // 64))):
            if len(some):
                x, mask = _padded([pages[i] for i in some])
                z = self.network.scores(x, mask)[:, :, 0]
                for k, i in enumerate(some):
                    out[i] = z[: len(pages[i]), k]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> None:
        adam = Adam(self.network.arrays, 0.02)
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for some in np.array_split(rng.permutation(len(pages)), -(-len(pages) // BATCH)):
                x, mask = _padded([pages[i] for i in some])
                y = np.zeros(mask.shape)
                for k, i in enumerate(some):
                    y[: len(labels[i]), k] = labels[i]
                z, state = self.network.run(x, mask)
                p = 1 / (1 + np.exp(-np.clip(z[:, :, 0], -30, 30)))
                d = ((p - y) * mask / mask.sum())[:, :, None]
                adam.step(self.network.gradients(state, d)[0])


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, pages))
    x = np.zeros((length, len(pages), INPUTS))
    mask = np.zeros((length, len(pages)))
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


# layouts that pages are also learned in: names of the parts around the text
_WRAPS = (
    ("body", "main", "article"),
    ("body", "div.content", "article.post"),
    ("body", "div.page", "div.post-content"),
    ("body", "section.story", "div.entry"),
    ("body", "article"),
)
_ASIDES = (
    ("body", "nav", "ul", "li"), ("body", "div.menu", "ul", "li"), ("body", "aside"),
    ("body", "div.sidebar", "p"), ("body", "footer"), ("body", "div.footer", "p"),
    ("body", "header"), ("body", "div.cookie-notice", "p"), ("body", "div.ad"),
    ("body", "div.promo"), ("body", "form"), ("body", "form", "p"),
    ("body", "section.comments", "div.comment", "p"), ("body", "div.comments", "p"),
    ("body", "ol.comment-list", "li.comment", "p"), ("body", "div.related", "p"),
)


def relaid(found: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page in another layout, with blocks of its own as comments, notices and the like."""
    main = [b for b in found if is_main(b)]
    if not main:
        return found
    wrap = _WRAPS[rng.integers(len(_WRAPS))]
    middle = [Block(b.text, (*wrap, b.path[-1].partition(".")[0]), b.linked) for b in main]

    def beside(most: int) -> list[Block]:
        out = []
        for _ in range(rng.integers(1, most)):
            path = _ASIDES[rng.integers(len(_ASIDES))]
            linked = 1.0 if path[-1] == "li" else 0.0
            for _ in range(rng.integers(1, 4)):
                text = found[rng.integers(len(found))].text
                words = text.split(" ")
                short = " ".join(words[: rng.integers(1, 30)])
                out.append(Block(short if linked or rng.random() < 0.6 else text, path, linked))
        return out

    inner = []
    for b in middle:
        inner.append(b)
        if rng.random() < 0.06:
            path = (*wrap, ("aside", "div.ad", "div.share", "form")[rng.integers(4)])
            inner.append(Block(found[rng.integers(len(found))].text[:200], path, 0.0))
    return [*beside(5), *inner, *beside(6)]


def train(pages: DataFrame, most: int = PAGES) -> Labeller:
    """A labeller from at most ``most`` pages of bounded length, those with the smallest digests,
    as they are and in other layouts. Without pages it keeps nothing."""
    short = pages.where(F.length("html") <= LONGEST)
    names = short.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    picked = short.join(F.broadcast(names.distinct()), "page_id").select("html").limit(2 * most)
    rng = np.random.default_rng(7)
    labeller = Labeller(BiLstm(INPUTS, HIDDEN, 1, 2))
    inputs, labels = [], []
    for text in sorted(r.html for r in picked.collect()):
        found = blocks(text)
        for page in [found, *(relaid(found, rng) for _ in range(LAYOUTS - 1))]:
            page = page[:LEARNED]
            if page:
                inputs.append(vectors(page))
                labels.append(np.array([is_main(b) for b in page], float))
    if inputs:
        labeller.train(inputs, labels)
    else:
        labeller.network.arrays[-1][0] = -50.0
    return labeller


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    ``text`` is the blocks that the network labels as main text, in page order, joined by one
    line feed; nothing else is dropped or cut. The labeller is trained on ``pages`` if none is
    given.

    A null or empty page, and one without main text, gives the empty text. Null and repeated ids
    and urls are kept. Pages of any length are read whole. An empty table gives no rows. Other
    columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller or train(pages))

    def make():
        model = shared.value

        def work(batch):
            texts = []
            for at in range(0, batch.num_rows, 256):
                found = [blocks(t.as_py()) for t in batch["html"].slice(at, 256)]
                scored = model.scores([vectors(b) for b in found])
                texts += [
                    "\n".join(b.text for b, z in zip(page, odds) if z > 0)
                    for page, odds in zip(found, scored)
                ]
            yield {
                "page_id": batch["page_id"].to_pylist(),
                "url": batch["url"].to_pylist(),
                "text": texts,
                "n_chars": [len(t) for t in texts],
            }

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    return arrow_rows(pages.select("page_id", "url", "html"), make, schema)
