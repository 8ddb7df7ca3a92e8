"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that stand in a line of text; any other element's start or end closes a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp".split())
#: Elements whose start closes an open p.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end where the next of their kind starts.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    """A leaf block: its text, the tags and names that it lies in, and how much of it is a link."""

    __slots__ = ("text", "tags", "names", "link")

    def __init__(self, text: str, tags: tuple, names: tuple, link: float) -> None:
        self.text, self.tags, self.names, self.link = text, tags, names, link


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order; white space in a block is one space, references are decoded."""
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    links = [0, 0]  # depth of a, characters in it

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links[0]:
                links[1] += len("".join(text.split()))

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), links[1] / max(1, len(text.replace(" ", "")))))
            parts.clear()
        links[1] = 0

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end
            if tag in INLINE:
                if tag == "a" and links[0]:
                    links[0] -= 1
                if tag == "br":
                    parts.append(" ")
                continue
            close()
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|</{re.escape(tag)}\Z", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links[0] += 1
            continue
        close()
        links[0] = 0
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in SIBLINGS and stack and stack[-1][0] in SIBLINGS[tag]:
            while stack and stack[-1][0] in SIBLINGS[tag]:
                stack.pop()
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            names = []
            for name, *values in _ATTR.findall(m[3]):
                value = next((v for v in values if v), "").lower()
                if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none", value):
                    names.append("#hidden")
                elif name.lower() != "style":
                    names += _WORD.findall(value)
            stack.append((tag, tuple(names)))
    close()
    return found


N_BITS = 14


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    """A feature's place: names are hashed, so unseen ones need no table."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & (1 << N_BITS) - 1


def features(page: list[Block]) -> list[list[int]]:
    """Per block the places of its features: ancestors, names, and its text's shape."""
    out = []
    n = len(page)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        stop = b.text[-1:]
        names = ["bias", f"words{min(9, words.bit_length())}", f"link{math.ceil(b.link * 4)}", f"stop{stop in '.!?…:'}", f"place{4 * i // n}", f"sign{b.text[:1] in '©@#|·'}"]
        names += [f"in:{t}" for t in set(b.tags)] + [f"name:{x}" for x in set(b.names)]
        names += [f"last:{b.tags[-1] if b.tags else ''}", f"top:{b.tags[2] if len(b.tags) > 2 else ''}"]
        low = b.text.lower()
        names += [f"says:{k}" for k in ("©", "cookie", "subscribe", "comment", "advert", "sponsored", "reserved", "sign in", "log in", "share") if k in low]
        out.append([_slot(x) for x in names])
    return out


class Crf:
    """Two labels, 0 around and 1 main text; weights of features by label, and of pairs of labels."""

    def __init__(self) -> None:
        self.w = np.zeros((1 << N_BITS, 2))
        self.t = np.zeros((2, 2))

    def _scores(self, x: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((j for f in x for j in f), np.int64)
        ends = np.cumsum([len(f) for f in x])
        return np.add.reduceat(self.w[flat], np.r_[0, ends[:-1]], axis=0)

    def gradient(self, x: list[list[int]], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts of each block's label and of label pairs, by forward-backward."""
        s = self._scores(x)
        n = len(x)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[0] = s[0]
        for i in range(1, n):
            a[i] = s[i] + np.logaddexp(a[i - 1][0] + self.t[0], a[i - 1][1] + self.t[1])
        for i in range(n - 2, -1, -1):
            v = s[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.t[:, 0] + v[0], self.t[:, 1] + v[1])
        z = np.logaddexp(*a[-1])
        node = -np.exp(a + b - z)
        node[np.arange(n), y] += 1
        pair = np.zeros((2, 2))
        if n > 1:
            pair -= np.exp(a[:-1, :, None] + self.t + (s + b)[1:, None, :] - z).sum(axis=0)
            np.add.at(pair, (y[:-1], y[1:]), 1)
        return node, pair

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 6, rate: float = 0.3, seed: int = 0) -> Crf:
        """Maximum likelihood by adaptive gradient steps, a page at a time, in a seeded order."""
        order, seen, seen_t = list(range(len(pages))), np.full((1 << N_BITS, 2), 1e-6), np.full((2, 2), 1e-6)
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                x, y = pages[i]
                node, pair = self.gradient(x, y)
                flat = np.fromiter((j for f in x for j in f), np.int64)
                g = np.zeros((0, 2)) if not len(flat) else np.repeat(node, [len(f) for f in x], axis=0)
                at, inverse = np.unique(flat, return_inverse=True)
                total = np.zeros((len(at), 2))
                np.add.at(total, inverse, g)
                total -= 1e-4 * self.w[at]
                seen[at] += total**2
                self.w[at] += rate * total / np.sqrt(seen[at])
                seen_t += pair**2
                self.t += rate * pair / np.sqrt(seen_t)
        return self

    def decode(self, x: list[list[int]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        s = self._scores(x).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = s[0]
        back = []
        for u, v in s[1:]:
            back.append((b + t10 > a + t00, b + t11 > a + t01))
            a, b = u + max(a + t00, b + t10), v + max(a + t01, b + t11)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


#: Fixed values of the page generator: names that sites give to what is around an article, and to articles.
_AROUND = {
    "menu": ("nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "topbar"),
    "header": ("header", "masthead", "banner", "site header", "page header", "branding", "logo"),
    "footer": ("footer", "site footer", "copyright", "colophon", "bottom", "legal"),
    "side": ("sidebar", "aside", "widget", "related", "rail", "recommended", "popular", "tags", "author box", "share", "social"),
    "notice": ("cookie", "cookie notice", "consent", "gdpr", "notice", "alert", "newsletter", "popup", "modal", "overlay", "subscribe", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner ad"),
    "comments": ("comments", "comment", "comment list", "disqus", "responses", "replies", "discussion", "reviews"),
    "form": ("search", "login", "signup", "form", "contact form", "search form"),
}
_MAIN = ("article", "content", "post", "entry", "post content", "entry content", "article body", "main", "story", "text", "body", "page content")
_TAGS = {"menu": ("nav", "div", "ul", "nav", "nav"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer", "footer"), "side": ("aside", "div", "aside"), "notice": ("div", "section", "div"), "ad": ("div", "aside", "ins", "div"), "comments": ("section", "div", "ol"), "form": ("form", "form", "div")}


class PageMaker:
    """Labelled pages for training: articles and what stands around them, in the ways that sites mark them up.

    Their words are nonsense syllables, so only structure and shape can be learned; what is around
    an article often reads like the article.
    """

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeiou") + r.choice("bdklmnrst") for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(1, 30).capitalize() + "."

    def prose(self, lo: int = 1, hi: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def around(self, kind: str) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        tag = r.choice(_TAGS[kind])
        name = r.choice(_AROUND[kind])
        attr = "" if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else f' {r.choice(("class", "class", "id"))}="{r.choice(("", "", "main-", "site-", "js-"))}{name.replace(" ", r.choice(("-", " ", "_")))}"'
        inner, texts = [], []
        if kind == "menu" or kind in ("footer", "side", "header") and r.random() < 0.5:
            for _ in range(r.randint(2, 7)):
                w = self.words(1, 3)
                inner.append(f'<li><a href="/{r.randint(1, 99)}">{w}</a></li>')
                texts.append(w)
            body = "".join(inner) if tag in ("ul", "ol") else "<ul>" + "".join(inner) + "</ul>"
            if r.random() < 0.3 and tag not in ("ul", "ol"):
                w = self.words(1, 4)
                body, texts = f"<h3>{w}</h3>" + body, [w, *texts]
        else:
            body = ""
            for i in range(1 if r.random() < 0.6 else r.randint(2, 5)):
                w = self.prose(1, 3) if r.random() < 0.7 else self.words(1, 8)
                if kind == "footer" and i == 0 and r.random() < 0.7:
                    w = f"© {self.words(1, 2)} · {w}"
                if kind == "comments" and r.random() < 0.5:
                    w = f"{self.words(1, 2)}: {w}"
                form = r.choice(("bare", "p", "p", "div", "label" if kind == "form" else "p"))
                if form == "bare" and not body:
                    body += w
                elif form == "bare":
                    body += f"<p>{w}</p>"
                else:
                    body += f"<{form}>{w}</{form}>" if form != "label" else f"<p><label>{w}</label><input></p>"
                texts.append(w)
            if r.random() < 0.5:
                w, h = self.words(1, 4).capitalize(), r.choice(("h1", "h2", "h2", "h3", "h4"))
                body, texts = f"<{h}>{w}</{h}>" + body, [w, *texts]
            if kind == "comments" and r.random() < 0.5:
                body = f'<div class="{r.choice(("comment-body", "reply", "media", "item"))}">{body}</div>'
        return f"<{tag}{attr}>{body}</{tag}>", [(t, 0) for t in texts]

    def article(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        attr = f' {r.choice(("class", "id"))}="{r.choice(_MAIN).replace(" ", "-")}"' if tag in ("div", "section") or r.random() < 0.4 else ""
        out, texts = "", []
        if r.random() < 0.8:
            w = self.words(2, 12).capitalize() + r.choice(("", "."))
            out, texts = f"<h1>{w}</h1>", [w]
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.75:
                w = self.prose() if r.random() < 0.8 else self.words(1, 6)
                form = r.choice(("p", "p", "p", "open", "b", "link"))
                texts.append(w)
                out += {"p": f"<p>{w}</p>", "open": f"<p><b>{w}<br>", "b": f"<p><b>{w}</b></p>", "link": f'<p><a href="/x">{w.split(" ")[0]}</a>{w[len(w.split(" ")[0]):]}</p>'}[form]
            elif kind < 0.85:
                w = self.words(1, 6).capitalize()
                out += f"<h2>{w}</h2>"
                texts.append(w)
            elif kind < 0.93:
                items = [self.words(1, 9) for _ in range(r.randint(2, 4))]
                out += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
                texts += items
            else:
                w = self.prose(1, 2)
                out += f"<blockquote>{w}</blockquote>"
                texts.append(w)
            if r.random() < 0.06:
                more, labels = self.around(r.choice(("ad", "side", "notice", "form", "comments")))
                out += more
                texts += labels
        return f"<{tag}{attr}>{out}</{tag}>", [t if isinstance(t, tuple) else (t, 1) for t in texts]

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        parts = [self.around(k) for k in ("notice", "header", "menu", "form", "ad", "side") if r.random() < 0.5]
        main, labels = self.article()
        if main.startswith("<article") and r.random() < 0.4:
            extra = [self.around(k) for k in ("side", "comments") if r.random() < 0.3]
            main, labels = f"<main>{main}{''.join(x for x, _ in extra)}</main>", labels + [t for _, texts in extra for t in texts]
        parts.append((main, labels))
        parts += [self.around(k) for k in ("ad", "side", "comments", "notice", "menu", "form") if r.random() < 0.3]
        if r.random() < 0.85:
            parts.append(self.around("footer"))
        if r.random() < 0.3:
            parts = [(f"<div class=\"{r.choice(('wrapper', 'container', 'page', 'row', 'layout'))}\">", []), *parts, ("</div>", [])]
        body = "".join(p for p, _ in parts)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>", [t for _, texts in parts for t in texts]


def labelled_pages(n: int, seed: int) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages of the generator as blocks and labels."""
    maker = PageMaker(seed)
    while n:
        html, texts = maker.page()
        found = blocks(html)
        want = [(" ".join(t.split()), y) for t, y in texts]
        if [b.text for b in found] == [t for t, _ in want]:
            yield found, [y for _, y in want]
            n -= 1


@lru_cache(maxsize=4)
def trained(n_pages: int = 2000, seed: int = 7) -> Crf:
    """The field fitted on n_pages labelled pages; the same weights on every call."""
    return Crf().fit([(features(b), y) for b, y in labelled_pages(n_pages, seed)])


def main_text(html: str, crf: Crf) -> str:
    """The blocks that the field labels as main text, joined by line feeds."""
    page = [b for b in blocks(html) if "#hidden" not in b.names]
    if not page:
        return ""
    return "\n".join(b.text for b, y in zip(page, crf.decode(features(page))) if y)


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), n_pages: int = 2000) -> DataFrame:
    """The main text of every page: (keep..., text, n_chars in code points).

    Scripts, styles and other raw elements give no blocks; the rest is cut into leaf
    blocks, labelled by the field and joined in page order. Null and empty pages, and
    pages without main text, have an empty text. Repeated rows are extracted alike; an
    empty table gives an empty result. The field is fitted on the driver (a fixed number
    of generated pages) and sent to the tasks, 256 KB at most.
    """
    crf = trained(n_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", crf) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*(f"k{i}" for i in range(len(keep))), "text"])

    source = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    found = source.mapInArrow(run, f"{kinds}, text string")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))
