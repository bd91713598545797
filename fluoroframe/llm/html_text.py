"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each
block gets features of its ancestors (tags, words of class, id and role names) and
of its text; a two-state chain, trained on the labelled pages below, is decoded by
Viterbi, and the blocks of the main state are the text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluoroframe.llm.common import filled

# Fixed values of the HTML standard: elements of scripts, styles and form controls, those without an end, and those that run inside a line.
SILENT = ("script", "style", "template", "textarea", "select", "option", "button", "iframe", "title", "noembed", "datalist")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr audio canvas map noscript object output picture svg video math mfrac mi mn mo mrow ms msqrt mspace msub msubsup msup mtext semantics annotation".split())
# A start tag of the second kind ends an open element of the first.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=silent)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<open_end>/?)(?P<open_tag>[a-zA-Z][^\s/>]*)(?P<open_attrs>[^>]*)(?:>|\Z)",  # a quote that nothing closes
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # of all ancestors
    parent: str  # tag of the innermost one, "" if none
    names: frozenset[str]
    linked: int  # characters inside links


@dataclass
class _Open:
    """An open element; tags, names and hiding include those of its ancestors."""

    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    hidden: bool


def _described(attrs: str) -> tuple[set[str], bool]:
    """Words of the names of an element, and whether its attributes hide it."""
    words: set[str] = set()
    hidden = False
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in _NAMING:
            words.update(w.lower() for w in _WORDS.findall(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= bool(_NOT_SHOWN.search(value))
    return words, hidden


def leaf_blocks(page: str) -> list[Block]:
    """Runs of visible text between block-level tags, in page order, with their ancestors.

    Of an element's attributes only ``hidden``, ``aria-hidden="true"`` and a style of ``display: none`` hide its text.
    """
    blocks: list[Block] = []
    top = _Open("", frozenset(), frozenset(), False)
    stack = [top]
    count: dict[str, int] = {}  # open elements by tag
    words: list[str] = []
    state = {"link": 0, "linked": 0}

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        here = stack[-1]
        if text and not here.hidden:
            blocks.append(Block(text, here.tags, here.tag, here.names, state["linked"]))
        state["linked"] = 0

    def say(raw: str) -> None:
        if raw:
            words.append(raw)
            if state["link"]:
                state["linked"] += len(raw.strip())

    def close(upto: int) -> None:
        for gone in stack[upto:]:
            count[gone.tag] -= 1
        del stack[upto:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["open_tag"] or "").lower()
        if not tag:
            if m["silent"]:
                words.append(" ")
            continue
        end, attrs = m["end"] or m["open_end"], m["attrs"] or m["open_attrs"] or ""
        if tag in INLINE:
            if tag == "a":
                state["link"] = 0 if end else 1
            if tag == "br":
                words.append(" ")
            continue
        flush()
        state["link"] = 0
        if end:
            if count.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        last = stack[-1].tag
        if tag in CLOSES_P and last == "p" or tag == "li" and last == "li" or tag in ("td", "th", "tr") and last in ("td", "th"):
            close(len(stack) - 1)
        elif tag in CLOSES_P and len(stack) > 2 and stack[-2].tag == "p":
            close(len(stack) - 2)
        if tag not in VOID and not attrs.endswith("/"):
            above = stack[-1]
            found, hidden = _described(attrs) if attrs else ((), False)
            tags = above.tags if tag in above.tags else above.tags | {tag}
            names = above.names if above.names.issuperset(found) else above.names.union(found)
            stack.append(_Open(tag, tags, names, above.hidden or hidden))
            count[tag] = count.get(tag, 0) + 1
    rest = page[at:]
    open_tag = rest.rfind("<")
    if open_tag >= 0 and re.match(r"</?[a-zA-Z!]", rest[open_tag:]) and ">" not in rest[open_tag:]:
        rest = rest[:open_tag]  # a tag cut off at the end of the page
    say(rest)
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        marks = [f"in:{t}" for t in b.tags] + [f"name:{w}" for w in b.names if w in NAME_WORDS]
        marks.append(f"tag:{b.parent}")
        marks.append(f"long:{min(5, n.bit_length() // 2)}")
        marks.append(f"link:{min(3, 4 * b.linked // max(1, n))}")
        marks.append("stop" if b.text[-1] in ".!?:;\"”" else "nostop")
        if b.text[0] in "©®" or "©" in b.text[:40]:
            marks.append("sign")
        if not b.tags:
            marks.append("bare")
        if i == 0:
            marks.append("first")
        if i == len(blocks) - 1:
            marks.append("last")
        out.append(marks)
    return out


# Labelled pages: words of names that pages use for the main text and for what stands around it.
MAIN_NAMES = ("article", "content", "post", "entry", "story", "main", "body", "text")
OTHER_NAMES = (
    "nav", "menu", "navbar", "breadcrumb", "header", "masthead", "banner", "footer", "sidebar", "aside", "widget", "related",
    "cookie", "consent", "notice", "alert", "popup", "modal", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo",
    "comment", "comments", "reply", "respond", "form", "search", "login", "newsletter", "subscribe", "share", "social", "copyright", "legal", "tags", "pagination", "toolbar",
)
NAME_WORDS = frozenset(MAIN_NAMES + OTHER_NAMES)


def labelled_pages(count: int = 240, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of many layouts, each with the labels (1: main text) of its blocks in page order."""
    rng = random.Random(seed)
    pages = []

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))

    def sentence(low: int, high: int) -> str:
        return words(rng.randint(low, high)).capitalize() + rng.choice(["."] * 8 + ["!", "?"])

    for _ in range(count):
        marks: list[int] = []

        def block(tag: str, text: str, main: int) -> str:
            marks.append(main)
            return f"<{tag}>{text}</{tag}>"

        def link(n: int = 2) -> str:
            return f'<a href="/{words(1)}">{words(rng.randint(1, n))}</a>'

        def attr(name: str) -> str:
            style = rng.choice(['class="{}"', 'id="{}"', 'class="site-{} wide"', 'class="{}-box"', 'id="{}-1"', 'role="{}"'])
            return " " + style.format(name)

        def around(tag: str, name: str, inner: str) -> str:
            """Boilerplate under a telling tag, a telling name, or both."""
            tag, named = rng.choice([(tag, ""), ("div", attr(name)), (tag, attr(name)), ("section", attr(name)) if tag != "nav" else (tag, "")])
            if tag == "div" and not named:
                named = attr(name)
            return f"<{tag}{named}>{inner}</{tag}>"

        def menu() -> str:
            items = "".join(block("li", link(), 0) for _ in range(rng.randint(2, 8)))
            return around("nav", rng.choice(["nav", "menu", "navbar", "breadcrumb"]), f"<ul>{items}</ul>")

        def top() -> str:
            return around("header", rng.choice(["header", "masthead", "banner"]), rng.choice(["h1", "p", "div"]).join(["<", ">"]) + (marks.append(0) or words(3)) + "</p>")

        def bottom() -> str:
            said = rng.choice([f"&copy; {words(2)}", f"&copy; {words(1)} &middot; {sentence(4, 16)}", sentence(4, 14), link(3)])
            return around("footer", rng.choice(["footer", "copyright", "legal"]), block("p", said, 0) if rng.random() < 0.5 else (marks.append(0) or said))

        def side() -> str:
            name = rng.choice(["sidebar", "aside", "widget", "related"])
            inner = block("h3", words(2), 0) + "".join(block(*rng.choice([("li", link(6)), ("p", sentence(5, 40))]), 0) for _ in range(rng.randint(1, 4)))
            return around("aside", name, inner)

        def notice() -> str:
            name = rng.choice(["cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "promo"])
            return f"<div{attr(name)}>" + (block("p", sentence(5, 30), 0) if rng.random() < 0.6 else (marks.append(0) or sentence(5, 30))) + "</div>"

        def advert() -> str:
            name = rng.choice(["ad", "ads", "advert", "advertisement", "sponsor", "sponsored"])
            return f"<div{attr(name)}>" + (block("p", sentence(4, 30), 0) if rng.random() < 0.3 else (marks.append(0) or sentence(4, 30))) + "</div>"

        def form() -> str:
            marks.append(0)
            return f"<form{attr(rng.choice(['search', 'login', 'form', 'newsletter'])) if rng.random() < 0.5 else ''}><label>{words(2)}</label><input type='text'></form>"

        def comments() -> str:
            name = rng.choice(["comment", "comments", "reply", "respond"])
            inner = block("h3", words(2), 0) + "".join(block(*rng.choice([("p", sentence(5, 50)), ("li", sentence(4, 40)), ("div", sentence(5, 40))]), 0) for _ in range(rng.randint(1, 5)))
            return f"<{rng.choice(['div', 'section', 'ol'])}{attr(name)}>{inner}</div>"

        def main() -> str:
            parts = [block("h1", words(rng.randint(2, 9)), 1)] if rng.random() < 0.85 else []
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.72:
                    parts.append(block("p", " ".join(sentence(1, 30) for _ in range(rng.choice([1, 1, 2, 5]))), 1))
                elif kind < 0.8:
                    parts.append(block(rng.choice(["h2", "h3"]), words(rng.randint(1, 6)), 1))
                elif kind < 0.88:
                    parts.append("<ul>" + "".join(block("li", rng.choice([words(3), sentence(3, 15)]), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
                elif kind < 0.92:
                    parts.append("<blockquote>" + block("p", sentence(5, 20), 1) + "</blockquote>")
                elif kind < 0.95:
                    parts.append("<table><tr>" + "".join(block("td", words(2), 1) for _ in range(3)) + "</tr></table>")
                elif kind < 0.975:
                    parts.append(rng.choice([advert, notice])())
                else:
                    parts.append(block("pre", words(8), 1))
            shape = rng.random()
            if shape < 0.55:
                return f"<article{attr(rng.choice(MAIN_NAMES)) if rng.random() < 0.3 else ''}>{''.join(parts)}</article>"
            if shape < 0.75:
                return f"<main>{''.join(parts)}</main>"
            if shape < 0.9:
                return f"<div{attr(rng.choice(MAIN_NAMES))}>{''.join(parts)}</div>"
            return "".join(parts)

        before = [f for f in (top, menu, notice, advert, form, side) if rng.random() < 0.5]
        after = [f for f in (side, comments, advert, form, menu, bottom, notice) if rng.random() < 0.45]
        rng.shuffle(before)
        body = "".join(f() for f in [*before, main, *after])
        pages.append((f"<html><head><title>{words(3)}</title></head><body>{body}</body></html>", list(marks)))
    return pages


@dataclass
class ChainField:
    """Weights of a two-state chain: per feature and state, and per pair of states."""

    weights: dict[str, tuple[float, float]]
    steps: np.ndarray
    start: np.ndarray

    def decode(self, marks: list[list[str]]) -> list[int]:
        """Viterbi path; equal paths prefer the main state."""
        if not marks:
            return []
        none = (0.0, 0.0)
        (s00, s01), (s10, s11) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        a, b = self.start.tolist()
        for i, fs in enumerate(marks):
            e0 = e1 = 0.0
            for f in fs:
                w = self.weights.get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i:
                to0 = (1, b + s10) if b + s10 >= a + s00 else (0, a + s00)
                to1 = (1, b + s11) if b + s11 >= a + s01 else (0, a + s01)
                back.append((to0[0], to1[0]))
                a, b = to0[1], to1[1]
            a, b = a + e0, b + e1
        path = [1 if b >= a else 0]
        for pair in reversed(back):
            path.append(pair[path[-1]])
        return path[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 150, rate: float = 0.3, ridge: float = 0.002) -> ChainField:
    """Maximum likelihood by gradient steps with adaptive rates; forward and backward sums give the expectations."""
    data = []
    for page, labels in pages:
        marks = features(leaf_blocks(page))
        if marks and len(marks) == len(labels):
            data.append((marks, labels))
    index = {f: i for i, f in enumerate(sorted({f for marks, _ in data for fs in marks for f in fs}))}
    size = max(len(m) for m, _ in data)
    batch = len(data)
    x = np.zeros((batch, size, len(index)), dtype=np.float32)
    y = np.zeros((batch, size), dtype=int)
    there = np.zeros((batch, size), dtype=bool)
    for i, (marks, labels) in enumerate(data):
        for t, fs in enumerate(marks):
            x[i, t, [index[f] for f in fs]] = 1
        y[i, : len(labels)] = labels
        there[i, : len(labels)] = True
    w, steps, start = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.zeros_like(v) for v in (w, steps, start)]
    onehot = np.eye(2)[y] * there[..., None]
    flat = x.reshape(-1, len(index))
    pair_there = there[:, 1:] & there[:, :-1]
    true_pairs = np.einsum("bti,btj->ij", onehot[:, :-1] * pair_there[..., None], onehot[:, 1:])
    for _ in range(rounds):
        emit = (flat @ w).reshape(batch, size, 2)
        forward, backward = np.zeros((batch, size, 2)), np.zeros((batch, size, 2))
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, size):
            step = np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1]) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(size - 2, -1, -1):
            ahead = emit[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(ahead[:, :1] + steps[:, 0], ahead[:, 1:] + steps[:, 1])
            backward[:, t] = np.where(there[:, t + 1, None], step, 0.0)
        node = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        pairs = np.exp(
            forward[:, :-1, :, None] + steps[None, None] + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * pair_there[..., None, None]
        grads = (
            flat.T @ (onehot - node).reshape(-1, 2) / batch - ridge * w,
            (true_pairs - pairs.sum(axis=(0, 1))) / batch - ridge * steps,
            (onehot[:, 0] - node[:, 0]).mean(axis=0),
        )
        for value, grad, old in zip((w, steps, start), grads, seen):
            old += grad**2
            value += rate * grad / np.sqrt(old + 1e-8)
    return ChainField({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, steps, start)


def main_text(page: str, field: ChainField) -> str:
    """Blocks of the main state, one per line."""
    blocks = leaf_blocks(page)
    kept = field.decode(features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


_TRAINED: list[ChainField] = []


def default_field() -> ChainField:
    """The field trained on ``labelled_pages``; once per process."""
    if not _TRAINED:
        _TRAINED.append(train(labelled_pages()))
    return _TRAINED[0]


def extract(pages: DataFrame, field: ChainField | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars`` (code points).

    Whole pages count; a null or empty page has an empty text.  Null ids and repeated rows keep their rows; other
    columns are left behind.
    """
    field = field or default_field()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([main_text(p, field) for p in some], dtype=object)

    rows = pages.select(F.col(f"`{id_column}`"), F.col(f"`{url_column}`"), texts(filled(html_column)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
