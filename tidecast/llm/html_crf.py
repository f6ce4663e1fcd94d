"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A block is the text between two boundaries of block elements, with the elements it lies in. Its
features are the tags, class and id words above it and what its text looks like; the chain has two
states, article and rest. The field is trained on pages whose own markup labels their blocks
(``<article>`` or ``<main>``), each also with its wrappers renamed and with blocks added that such
pages lack, so that it can read pages without those elements. Decoding is Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the training sample, which is read on the driver.
TRAIN_PAGES, LOOKED_AT = 240, 960
TRAIN_CHARS = 50_000
VARIANTS = 3
ROUNDS = 60

# HTML's elements by how they part text, and words that wrappers are named by.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SILENT = set("script style noscript template head title svg iframe object select option textarea button".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = set("ul ol dl table body article section div nav".split())
_REST_WORDS = set(
    "ad ads advert adverts advertisement adsense alert author aside banner bar bottom breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disqus donate follow foot footer form gdpr head header hint info legal links login logo masthead menu meta modal nav navbar navigation newsletter notice notification "
    "pager pagination popup privacy promo promoted recommended related replies reply respond search share sharing side sidebar signup skip social sponsor sponsored "
    "subscribe tag tags teaser toc toolbar top warning widget".split())
_MAIN_WORDS = set("article body content entry main page post story text".split())
_REST_TAGS = set("nav header footer aside form menu".split())


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: int = 0


@dataclass
class _Reader(HTMLParser):
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.anchors = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(x for x in self.stack if x[0] not in _INLINE)
            self.blocks.append(Block(path, text, self.linked))
        self.parts, self.linked = [], 0

    def _pop_to(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.silent -= tag in _SILENT
            self.anchors -= tag == "a"
        del self.stack[at:]

    def _innermost(self, tags: set[str], scopes: set[str]) -> int | None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                return at
            if self.stack[at][0] in scopes:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.flush()
        if tag == "br" or tag == "hr":
            self.parts.append(" ")
        if tag in _CLOSES_P and (at := self._innermost({"p"}, _SCOPES)) is not None:
            self._pop_to(at)
        if tag in _SIBLINGS and (at := self._innermost(_SIBLINGS[tag], {"ul", "ol", "dl", "table"})) is not None:
            self._pop_to(at)
        if tag in _VOID:
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        words = tuple(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())) if named else ()
        self.stack.append((tag, words))
        self.silent += tag in _SILENT
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("p", "div", "li", "a", "b", "i", "span"):  # a slash closes nothing in HTML
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.flush()
        if (at := self._innermost({tag}, set())) is not None:
            self._pop_to(at)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


def read_blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in page order; none for null, empty and textless pages."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def features(block: Block, place: int, total: int) -> list[str]:
    """Names of the features of a block, the ``place``-th of ``total``."""
    tags, words = [t for t, _ in block.path], [w for _, ws in block.path for w in ws]
    text, n = block.text, block.text.count(" ") + 1
    rest = any(w in _REST_WORDS for w in words) or any(t in _REST_TAGS for t in tags)
    out = {f"own:{tags[-1] if tags else ''}"} | {f"in:{t}" for t in tags} | {f"word:{w}" for w in words}
    out |= {f"rest:{rest}", f"main:{any(w in _MAIN_WORDS for w in words) or 'article' in tags or 'main' in tags}"}
    out |= {f"length:{min(n.bit_length(), 7)}", f"stop:{text[-1] in '.!?:;'}", f"linked:{min(4, 4 * block.linked // len(text))}"}
    out |= {f"start:{min(place, 2)}", f"end:{min(total - 1 - place, 2)}"}
    if "©" in text or "·" in text:
        out.add("sign")
    return sorted(out)


@dataclass
class Field:
    """Weights by feature and state (0 rest, 1 article), of steps between states, and of the ends."""

    weights: dict[str, tuple[float, float]]
    steps: np.ndarray
    first: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest states of the blocks of a page (Viterbi)."""
        if not blocks:
            return []
        back, best = [], None
        (s00, s01), (s10, s11) = self.steps.tolist()
        for k, block in enumerate(blocks):
            e0 = e1 = 0.0
            for name in features(block, k, len(blocks)):
                if name in self.weights:
                    a, b = self.weights[name]
                    e0 += a
                    e1 += b
            if best is None:
                best = (self.first[0] + e0, self.first[1] + e1)
                continue
            from0, from1 = int(best[1] + s10 > best[0] + s00), int(best[1] + s11 > best[0] + s01)
            back.append((from0, from1))
            best = (max(best[0] + s00, best[1] + s10) + e0, max(best[0] + s01, best[1] + s11) + e1)
        state = int(best[1] > best[0])
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


def markup_label(block: Block) -> int:
    """What the page's own markup says: 1 inside article or main, unless a part of it is set apart."""
    inside = next((k for k, (t, _) in enumerate(block.path) if t in ("article", "main")), None)
    if inside is None:
        return 0
    return int(not any(t in _REST_TAGS or _REST_WORDS & set(ws) for t, ws in block.path[inside + 1:]))


_MAIN_WRAPS = [(("article", ()),), (("main", ()),), (("div", ("content",)),), (("div", ("post", "body")),), (("section", ("entry",)),), (("div", ("main",)), ("div", ("story", "text"))), (("div", ()),), ()]
_REST_WRAPS = [("nav", ()), ("div", ("menu",)), ("ul", ("navigation",)), ("header", ()), ("div", ("header",)), ("footer", ()), ("div", ("footer",)),
               ("aside", ()), ("div", ("sidebar",)), ("div", ("ad",)), ("div", ("banner",)), ("section", ("related",)), ("div", ("breadcrumbs",)), ("div", ("share",))]
_ADDED_WRAPS = [("div", ("cookie", "notice")), ("div", ("alert",)), ("form", ()), ("form", ("search",)), ("div", ("newsletter",)), ("section", ("comments",)), ("div", ("comment",)),
                ("ol", ("comment", "list")), ("aside", ()), ("div", ("promo",)), ("div", ("popup",)), ("div", ("sponsored",))]


def _variants(pages: list[tuple[list[Block], list[int]]], rng: random.Random) -> Iterator[tuple[list[Block], list[int]]]:
    spare = [b for blocks, _ in pages for b in blocks]
    for blocks, labels in pages:
        yield blocks, labels
        for _ in range(VARIANTS - 1):
            wrap, out = rng.choice(_MAIN_WRAPS), []
            outer: dict[tuple, tuple] = {}
            for block, label in zip(blocks, labels):
                top = block.path[:3]
                if label:
                    path = tuple(x for w in block.path for x in (wrap if w[0] in ("article", "main") else (w,)))
                else:
                    renamed = outer.setdefault(top, rng.choice(_REST_WRAPS))
                    path = tuple(x for x in block.path if x[0] in ("html", "body")) + (renamed,) + block.path[-1:] * (block.path[-1:] != top[-1:])
                out.append((Block(path, block.text, block.linked), label))
            for _ in range(rng.randint(0, 4)):  # parts such pages lack, before, inside and after the article
                other, named, at = rng.choice(spare), rng.choice(_ADDED_WRAPS), rng.randint(0, len(out))
                base = out[at - 1][0].path if at and rng.random() < 0.5 else (("html", ()), ("body", ()))
                base = tuple(x for x in base if x[0] not in ("p", "h1", "h2", "li"))
                out.insert(at, (Block((*base, named, ("p", ())), other.text), 0))
            yield [b for b, _ in out], [y for _, y in out]


def train(pages: list[str], seed: int = 5) -> Field:
    """A field learned from labelled pages (see ``markup_label``) by penalised likelihood.

    Before learning, wrappers named like rest count against a block and those named like articles
    for it; without labelled pages that is all the field knows.
    """
    read = [(b, [markup_label(x) for x in b]) for b in map(read_blocks, pages) if b]
    made = list(_variants([(b, y) for b, y in read if any(y)], random.Random(seed)))
    names = sorted({f for blocks, _ in made for k, b in enumerate(blocks) for f in features(b, k, len(blocks))} | {"rest:True", "main:True", "rest:False"})
    number = {f: k for k, f in enumerate(names)}
    weights = np.zeros((len(names) + 1, 2))
    weights[number["rest:True"]] = (2, -2)
    weights[number["main:True"], 1] = 1
    weights[number["rest:False"], 1] = 1
    steps, first = np.zeros((2, 2)), np.zeros(2)
    if made:
        rows = [[sorted(number[f] for f in features(b, k, len(blocks))) for k, b in enumerate(blocks)] for blocks, _ in made]
        kinds = sorted({tuple(r) for page in rows for r in page})  # blocks alike share a row
        at, wide, longest = {r: k for k, r in enumerate(kinds)}, max(map(len, kinds)), max(map(len, rows))
        x = np.array([[*r, *[len(names)] * (wide - len(r))] for r in kinds])
        kind = np.zeros((len(rows), longest), int)
        y, there = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
        for i, (page, (_, labels)) in enumerate(zip(rows, made)):
            kind[i, :len(page)] = [at[tuple(r)] for r in page]
            y[i, :len(page)], there[i, :len(page)] = labels, True
        _climb(x, kind, y, there, weights, steps, first)
    return Field({f: tuple(weights[k].tolist()) for f, k in number.items()}, steps, first)


def _climb(x: np.ndarray, kind: np.ndarray, y: np.ndarray, there: np.ndarray, weights: np.ndarray, steps: np.ndarray, first: np.ndarray) -> None:
    """Gradient steps on the log likelihood, by forward and backward sums over all pages at once."""
    n, longest = kind.shape
    prior = weights.copy()
    onehot = np.eye(2)[y] * there[..., None]
    seen_steps = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    speed = [np.zeros_like(p) for p in (weights, steps, first)]
    for _ in range(ROUNDS):
        emit = weights[x].sum(axis=1)[kind]
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            before = alpha[:, t - 1]
            ahead = np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1]) + emit[:, t]
            alpha[:, t] = np.where(there[:, t, None], ahead, before)
        for t in range(longest - 2, -1, -1):
            after = emit[:, t + 1] + beta[:, t + 1]
            behind = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
            beta[:, t] = np.where(there[:, t + 1, None], behind, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        state = np.exp(alpha + beta - total[:, None, None]) * there[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + steps + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        missing = np.stack([np.bincount(kind.ravel(), (onehot - state)[..., c].ravel(), len(x)) for c in (0, 1)], axis=1)
        slope = np.zeros_like(weights)
        np.add.at(slope, x, np.broadcast_to(missing[:, None, :], (*x.shape, 2)))
        slope[-1] = 0
        slopes = (slope - 0.5 * (weights - prior), seen_steps - pair.sum(axis=(0, 1)) - 0.5 * steps, (onehot - state)[:, 0].sum(axis=0) - 0.5 * first)
        for p, g, s in zip((weights, steps, first), slopes, speed):
            s += g * g
            p += 0.3 * g / (np.sqrt(s) + 1e-8)


def training_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """At most TRAIN_PAGES pages of at most TRAIN_CHARS characters that have an article or main element, by hash of the id.

    All such pages are counted first; of those a share by hash that holds LOOKED_AT on average is ordered, so that
    no more than about so many pages reach the driver, however many tasks read the table and however rare they are.
    """
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 40))
    labelled = pages.where(F.col(html_col).rlike("(?i)<(article|main)[ >]") & (F.char_length(html_col) <= TRAIN_CHARS))
    share = F.lit((1 << 40) * LOOKED_AT // max(LOOKED_AT, labelled.count()))
    sample = labelled.where(place <= share).select(F.col(html_col).alias("html"), place.alias("place"))
    return [r["html"] for r in sample.orderBy("place", "html").limit(TRAIN_PAGES).collect()]


def train_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Field:
    """Learns from the training pages of a table."""
    return train(training_pages(pages, id_col, html_col))


def main_text(pages: DataFrame, crf: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): one row per row of ``pages``, the article's blocks joined by a newline.

    Character references are decoded, white space inside a block is one space. Null, empty and
    textless pages give an empty text; whole pages are read. Repeated rows give a row each, null
    ids and urls stay. Other columns are not looked at.
    """

    def each(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for html in f["html"]:
                blocks = read_blocks(html)
                texts.append("\n".join(b.text for b, state in zip(blocks, crf.decode(blocks)) if state))
            yield f[["id", "url"]].assign(text=texts)

    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, url string, text string"
    return kept.mapInPandas(each, schema)
