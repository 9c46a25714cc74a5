"""Main text of web pages by a linear-chain conditional random field.

A page becomes a sequence of leaf blocks, each the text between two block
boundaries with its ancestor tags. Indicator features of the ancestors (tags,
words of class and id) and of the text (length, links, punctuation) score a
block; transition weights tie neighbours; Viterbi finds the best labelling.
The field is trained here by gradient ascent on the exact log-likelihood over
labelled pages that ``labelled_pages`` composes: sites with menus, headers,
notices, adverts, sidebars, forms, reader comments and footers around articles.

Hidden elements (scripts, forms' controls, the attributes hidden and
aria-hidden="true", inline display:none and visibility:hidden) have no text,
inside a block either.

Defined results: null or empty html gives an empty text; malformed markup never
fails (unknown or unclosed tags are tolerated) and is read in linear time;
repeated pages are extracted one by one; an empty table gives an empty result;
extra columns are ignored; memory is in proportion to one page.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_code

#: Fixed values of HTML: elements that bound a block, have no content, or hold no page text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object canvas textarea select option button head title math audio video".split())
RAW = frozenset(("script", "style", "textarea", "title"))
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table body html div section article main".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?][^>]*+>", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"']*+)))?+")
HIDING = re.compile(r"hidden|display", re.I)
STYLED_AWAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")

#: Words of class, id or role that speak for a kind of block, by feature.
HINTS = {
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense taboola outbrain",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc skip toolbar tabs",
    "head": "header masthead topbar logo branding hero site tagline",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside side related recommended widget popular trending teaser more rail tags tag",
    "note": "cookie cookies consent notice gdpr modal popup overlay alert newsletter subscribe signup paywall disclaimer privacy",
    "talk": "comment comments respond reply replies disqus discussion reader readers thread responses reviews review",
    "share": "share sharing social follow like buttons byline meta author date",
    "body": "article content main post entry story text body prose page column",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}


@dataclass
class Block:
    text: str
    features: frozenset = field(default_factory=frozenset)


class _Element:
    __slots__ = ("hidden", "marks", "tag")

    def __init__(self, tag: str, attributes: str, above: frozenset, hidden: bool):
        self.tag = tag
        mine = {"<" + tag} if tag in BLOCKS else set()
        self.hidden = hidden or tag in HIDDEN
        if attributes:
            for m in NAMED.finditer(attributes):
                for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
                    if w in HINT_OF:
                        mine.add("@" + HINT_OF[w])
            self.hidden = self.hidden or _hides(attributes)
        self.marks = above | mine if mine else above


def _hides(attributes: str) -> bool:
    """Whether attributes hide an element: by name, for readers' aids, or by inline style."""
    if HIDING.search(attributes) is None:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true") or (name == "style" and STYLED_AWAY.search(value)):
            return True
    return False


class _Stack:
    """Open elements, with the places of each tag, so that looking one up does not walk the stack."""

    def __init__(self) -> None:
        self.open: list[_Element] = []
        self.at: dict[str, list[int]] = {}
        self.marks: frozenset = frozenset()
        self.hidden = False

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, -1 if none is."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, attributes: str) -> None:
        element = _Element(tag, attributes, self.marks, self.hidden)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(element)
        self.marks, self.hidden = element.marks, element.hidden

    def pop_to(self, i: int) -> None:
        for e in self.open[i:]:
            self.at[e.tag].pop()
        del self.open[i:]
        self.marks, self.hidden = (self.open[-1].marks, self.open[-1].hidden) if self.open else (frozenset(), False)


def leaf_blocks(page: str) -> list[Block]:
    """The page's visible text blocks in order, with their ancestors' marks."""
    stack = _Stack()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not stack.hidden:
            parts.append(text)
            if stack.at.get("a"):
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            parts.clear()
            if text:
                out.append(Block(text, stack.marks | _text_features(text, linked)))
        linked = 0

    # Behind the last > there is no tag to look for; a comment that never ends is no text.
    at, last = 0, page.rfind(">") + 1
    match = TOKEN.search(page, 0, last)
    while match:
        if match.start() > at:
            say(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag:
            tag = tag.lower()
            bound = tag in BLOCKS
            if bound:
                flush()
            elif tag == "br":
                say(" ")
            if match[1]:
                i = stack.last((tag,))
                if i >= 0:
                    stack.pop_to(i)
            elif tag not in VOID:
                ends = CLOSES.get(tag) or (("p",) if bound else ())
                i = stack.last(ends)
                if i >= 0 and i > stack.last(FENCE):
                    stack.pop_to(i)
                if not match[3].endswith("/>") or bound:
                    stack.push(tag, match[3][:-1])
                if tag in RAW:
                    end = RAW_END[tag].search(page, at)
                    at = end.start() if end else len(page)
        match = TOKEN.search(page, at, last) if at < last else None
    if at < len(page) and "<!--" in page[at:]:
        say(page[at : page.index("<!--", at)])
    elif at < len(page):
        say(page[at:])
    flush()
    return out


def _text_features(text: str, linked: int) -> frozenset:
    n, words = len(text), text.count(" ") + 1
    out = {"bias", "words" + str(min(5, words.bit_length() - 1))}
    share = linked / n
    out.add("links" + ("0" if share < 0.1 else "1" if share < 0.6 else "2"))
    if text[-1] in ".!?…\"”»":
        out.add("ends")
    if "©" in text or "copyright" in text.lower():
        out.add("copyright")
    if sum(map(text.count, "|»›•·")) * 8 > words:
        out.add("bars")
    return frozenset(out)


@dataclass
class Field:
    """Weights of a two-label chain: 1 is main text."""

    weights: dict[str, float]
    stay: tuple[float, float]
    first: float

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi. Scores are those of label 1 against label 0."""
        get = self.weights.get
        zero, one, back = 0.0, self.first, []
        for i, block in enumerate(blocks):
            s = sum(get(f, 0.0) for f in block.features)
            if i == 0:
                zero, one = 0.0, one + s
                continue
            a, b = zero + self.stay[0] >= one, one + self.stay[1] >= zero
            back.append((0 if a else 1, 1 if b else 0))
            zero, one = max(zero + self.stay[0], one), max(one + self.stay[1], zero) + s
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1] if blocks else []


def extract(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


# ---- labelled pages -------------------------------------------------------


def labelled_pages(count: int, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    """Composed pages with a label for every leaf block: 1 inside the article's text."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi zo an er in ou".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def phrase(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(phrase(1, 14).capitalize() + rng.choice("...!?") for _ in range(rng.randint(low, high)))

    for _ in range(count):
        parts: list[str] = []
        labels: list[int] = []

        def put(markup: str, *marks: int) -> None:
            parts.append(markup)  # noqa: B023
            labels.extend(marks)  # noqa: B023

        def some(p: float) -> bool:
            return rng.random() < p

        def menu(tag: str, cls: str) -> None:
            n = rng.randint(1, 9)
            put(f"<{tag}{cls}><ul>" + "".join(f'<li><a href="/x">{phrase(1, 3)}</a></li>' for _ in range(n)) + f"</ul></{tag}>", *[0] * n)

        def boxed(names: str, low: int = 1, high: int = 3, unnamed: float = 0.15) -> None:
            tag = rng.choice(["div", "section", "aside", "div"])
            n = rng.randint(1, 3)
            text = lambda: sentences(low, high) if some(0.7) else phrase(1, 6)
            inner = text() if n == 1 and some(0.6) else "".join(f"<p>{text()}</p>" for _ in range(n))
            key = rng.choice(["class", "class", "id"])
            # Many sites name their boxes by words that tell nothing.
            name = rng.choice(names.split()) if not some(unnamed) else word() + rng.choice(["", "-wide", " overflow-hidden"])
            put(f'<{tag} {key}="{name if some(0.7) else name + rng.choice(["-box", "_1", " wide"])}">{inner}</{tag}>', *[0] * inner.count("<p>") or [0])

        def form() -> None:
            put(f'<form action="/s"><label>{phrase(1, 3)}</label><input name="q"><button>{phrase(1, 1)}</button></form>', 0)

        put(f"<!DOCTYPE html><html><head><title>{phrase(2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>")
        if some(0.3):
            boxed(HINTS["note"])
        if some(0.45):
            put(f"<header><div>{phrase(1, 4)}</div>" + (f"<p>{sentences(1, 1)}</p>" if (tag_line := some(0.4)) else "") + "</header>", *[0] * (1 + tag_line))
        elif some(0.2):
            boxed(HINTS["head"])
        if some(0.8):
            menu(*rng.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="menu"'), ("div", ' id="navigation"')]))
        if some(0.25):
            form()
        if some(0.6):
            boxed(HINTS["ad"])
        if some(0.2):
            boxed(HINTS["side"])
        plain = f'div class="{word()}"'
        shell = rng.choice(["article", "article", "article", f'article class="{word()} overflow-hidden"', plain, "main", '<main><article', 'div class="content"', 'div id="main-content"', 'div class="post"', 'section class="entry"', "div", 'td class="body"'])
        opened = shell if shell.startswith("<") else "<" + shell
        tags = re.findall(r"<([a-z]+)", opened)
        put(opened + ">" if "td" not in tags else "<table><tr>" + opened + ">")
        if some(0.85):
            put(f"<h1>{phrase(1, 12)}</h1>", 1)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12]) or 1):
            kind = rng.random()
            if kind < 0.72:
                text = sentences(1, 6) if some(0.85) else phrase(1, 6)
                text = text if some(0.8) else f"<b>{text}<br>" if some(0.5) else f'{text} <a href="/y">{phrase(1, 2)}</a> {phrase(1, 4)}.'
                put(f"<p>{text}</p>" if some(0.7) else f"<p>{text}", 1)
            elif kind < 0.8:
                put(f"<h2>{phrase(1, 6)}</h2>", 1)
            elif kind < 0.88:
                n = rng.randint(1, 4)
                put("<ul>" + "".join(f"<li>{phrase(1, 9)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
            elif kind < 0.93:
                put(f"<blockquote>{sentences(1, 2)}</blockquote>", 1)
            elif kind < 0.96:
                put(f"<pre>{phrase(1, 9)}</pre>", 1)
            elif some(0.6):
                boxed(HINTS[rng.choice(["ad", "side", "note", "share"])], unnamed=0)
            else:
                form()
        put("".join(f"</{t}>" for t in reversed(tags)) + ("</tr></table>" if "td" in tags else ""))
        if some(0.25):
            boxed(HINTS["ad"])
        if some(0.3):
            put("<aside>")
            menu("div", rng.choice(["", ' class="related"']))
            put(f"<p>{sentences(1, 2)}</p></aside>", 0)
        if some(0.4):
            outer = rng.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="respond"', 'ol class="replies"'])
            n = rng.randint(1, 5)
            inner = rng.choice(["p", "div", "li", 'article class="comment"', 'div class="comment"'])
            put(f"<{outer}>" + "".join(f"<{inner}>{sentences(1, 4)}</{inner.split()[0]}>" for _ in range(n)) + f"</{outer.split()[0]}>", *[0] * n)
        if some(0.2):
            form()
        if some(0.9):
            text = f"&copy; {phrase(1, 3)} &middot; {sentences(1, 2)}" if some(0.6) else sentences(1, 2)
            put(f"<footer>{text}</footer>" if some(0.8) else f'<div class="{rng.choice(HINTS["foot"].split())}">{text}</div>', 0)
        put("</body></html>")
        yield "".join(parts), labels


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, decay: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the log-likelihood; forward-backward over all pages at once."""
    names = sorted({f for blocks, _ in pages for b in blocks for f in b.features})
    place = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(b) for b, _ in pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        for j, block in enumerate(blocks):
            x[i, j, [place[f] for f in block.features]] = 1
            y[i, j], mask[i, j] = labels[j], True
    theta = np.zeros(len(names) + 3)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    for step in range(1, rounds + 1):
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = x @ theta[:-3].astype(np.float32)
        emit[:, 0, 1] += theta[-1]
        move = np.array([[theta[-3], 0.0], [0.0, theta[-2]]])
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = emit[:, 0]
        for j in range(1, longest):
            new = np.logaddexp.reduce(fwd[:, j - 1, :, None] + move, axis=1) + emit[:, j]
            fwd[:, j] = np.where(mask[:, j, None], new, fwd[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(move + (emit[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(mask[:, j + 1, None], new, 0.0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1] * mask
        pair = np.exp(fwd[:, :-1, :, None] + move + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grad = np.zeros_like(theta)
        miss = (y - p) * mask
        grad[:-3] = np.einsum("ij,ijk->k", miss.astype(np.float32), x)
        grad[-3] = ((y[:, :-1] == 0) & (y[:, 1:] == 0) & both).sum() - pair[:, :, 0, 0].sum()
        grad[-2] = ((y[:, :-1] == 1) & (y[:, 1:] == 1) & both).sum() - pair[:, :, 1, 1].sum()
        grad[-1] = miss[:, 0].sum()
        grad = grad / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in place.items()}, (float(theta[-3]), float(theta[-2])), float(theta[-1]))


@lru_cache(maxsize=2)
def trained_field(count: int = 500, seed: int = 5) -> Field:
    """The field over ``count`` composed pages; a few seconds on the driver."""
    pages = []
    for page, labels in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            pages.append((blocks, labels))
    return train(pages)


def extract_pages(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [extract(t.as_py(), own) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship_code(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_field())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(body, "page_id long, url string, text string, n_chars long")
