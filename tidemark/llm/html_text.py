"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the borders of block elements. Features of a block are its
element, ancestor elements and their class and id words, and shape features of its text that hold in any language.
Two labels, kept and dropped, form a chain in page order; weights are trained by gradient ascent on the likelihood
of labelled pages (`labelled_pages`) and the best labelling is found by Viterbi. Pages are independent rows: the
model is trained once on the driver, has a fixed size, and is used in one pass without a shuffle.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.registry import query

# Elements that break text into blocks, that end when one like them begins, and whose text is not shown.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split())
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW_TEXT_TAGS = frozenset("script style title textarea".split())
HIDDEN_TAGS = frozenset("template noscript svg iframe object math".split())
SECTIONS = frozenset("article main header footer nav aside form section blockquote figure table".split())

#: Quotes count where a value begins, so ">" inside quoted values ends no tag.
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _closing(page: str, tag: str, at: int) -> re.Match | None:
    """The end tag that belongs to an element whose start tag ends at `at`; None if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else (not m[0].endswith("/>"))
        if not depth:
            return m
    return None


def blocks_of(page: str | None) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block with text, in page order.

    Text of hidden elements is left out: up to the end tag, or where there is none, until the element around it ends or,
    for svg and math, the next block element begins.
    """
    if not isinstance(page, str):
        return []
    stack: list[tuple[str, list[str]]] = []
    out: list[tuple[str, list[str]]] = []
    text: list[str] = []
    linked = in_link = 0
    hidden: tuple[str, int] | None = None  # an unclosed hidden element, and how deep the stack was at its start

    def flush() -> None:
        nonlocal linked
        if text:
            shown = " ".join("".join(text).split())
            if shown:
                out.append((shown, _features(shown, linked / max(1, sum(map(len, text))), stack)))
            text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not hidden and (m[0][0] != "<" or m[0] == "<"):
                part = html.unescape(m[0])
                text.append(part)
                linked += len(part) if in_link else 0
            continue
        tag = tag.lower()
        if tag in RAW_TEXT_TAGS:
            if not m[1]:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = close.start() if close else end
                text.append(" ")
        elif tag in HIDDEN_TAGS:
            if not m[1] and not m[3].endswith("/"):
                close = _closing(page, tag, at)
                if close:
                    at = close.end()
                elif not hidden:
                    hidden = tag, len(stack)
                text.append(" ")
        elif tag == "a":
            in_link = 0 if m[1] else 1
        elif tag not in BLOCK_TAGS:
            if tag in ("br", "img", "input"):
                text.append(" ")
        else:
            flush()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                if hidden and len(stack) < hidden[1]:
                    hidden = None
                continue
            if stack and (stack[-1][0] in SELF_ENDING.get(tag, ()) or (stack[-1][0] == "p" and tag not in ("label", "button", "select"))):
                stack.pop()
            if hidden and (len(stack) < hidden[1] or hidden[0] in ("svg", "math")):
                hidden = None
            if tag != "hr":
                names = [w.lower() for n in _NAMES.findall(m[3]) for w in _PARTS.findall(n[0] or n[1] or n[2])]
                stack.append((tag, names))
    flush()
    return out


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def _features(text: str, links: float, stack: list[tuple[str, list[str]]]) -> list[str]:
    own = stack[-1][0] if stack else "none"
    near = next((t for t, _ in reversed(stack) if t in SECTIONS), "none")
    tags = {t for t, _ in stack}
    names = {n for _, ns in stack for n in ns}
    out = ["one", f"own {own}", f"near {near}", f"near {near} own {own}"]
    out += [f"in {t}" for t in tags] + [f"near {near} in {t}" for t in tags & SECTIONS] + [f"named {n}" for n in names]
    letters = sum(map(str.isalpha, text))
    return out + [
        f"length {_bin(len(text), 4, 15, 40, 100, 300)}", f"links {_bin(links, 0.01, 0.3, 0.8)}",
        f"ends {text[-1] in '.!?…:;\"”»'}", f"sign {'©' in text}", f"letters {_bin(letters / len(text), 0.3, 0.6, 0.75)}",
    ]


# ------------------------------------------------------------------ labelled pages

# How pages mark the parts around an article, and the article itself.
MARKED = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc tabs pagination pager links skip",
    "head": "header masthead banner top logo topbar branding site hero",
    "foot": "footer bottom copyright legal colophon credits imprint disclaimer",
    "side": "sidebar side aside widget related recommended trending popular tags categories archive rail more author bio",
    "note": "cookie cookies notice consent gdpr alert popup modal overlay paywall privacy message announcement warning",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adsense banner outbrain taboola",
    "form": "form subscribe newsletter signup login search contact register input field",
    "talk": "comments comment responses discussion replies reply thread disqus commentlist reader feedback",
    "share": "share social sharing follow buttons",
    "meta": "meta byline date posted toolbar actions print caption",
}
CONTENT = "article content post entry story main body text copy page prose document blog news markdown"
NEUTRAL = "wrapper container row col inner outer box block grid layout page site wrap section panel"
OF_TAG = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}
_SYLLABLES = "an ber ci da en fo gu ha in jo ka lo mi nu or pa qui re sa tu un va wo xe yo zi".split()


def labelled_pages(n: int = 600, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Pages composed from the parts above with filler text, and for each leaf block whether it belongs to the article.

    Articles hold short and long blocks, lists, quotes, tables and unclosed elements, comments and adverts may be as
    long as articles and may stand inside them, so that the model must weigh where a block stands.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choices(_SYLLABLES, k=r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(k: int) -> str:
        s = " ".join(word() for _ in range(k)).capitalize()
        return s + r.choice(("." * 6 + "!?") + " ").strip()

    def prose() -> str:
        k = r.choice((1, 1, 2, 3, 6, 12))
        return " ".join(sentence(r.randint(1, 16)) for _ in range(k))

    def short() -> str:
        return r.choice(("", "&copy; ", "")) + " ".join(word() for _ in range(r.randint(1, 7))) + r.choice(("", "", ".", " | " + word()))

    def attrs(name: str | None) -> str:
        if not name:
            return ""
        if r.random() < 0.3:
            name += r.choice(("-", "_", " ")) + r.choice(NEUTRAL.split() + ["list", "item", "area", "left", "right", "2"])
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def aside(kind: str, out: list[bool], depth: int = 0) -> str:
        """A part that is no article."""
        by_tag = kind in OF_TAG and r.random() < 0.5
        tag = OF_TAG[kind] if by_tag else r.choice(("div", "div", "div", "section", "ul" if kind == "menu" else "div"))
        name = r.choice(MARKED[kind].split()) if not by_tag or r.random() < 0.4 else None
        items = []
        for _ in range(r.randint(1, 8 if kind in ("menu", "talk", "side") else 3)):
            long = kind == "talk" or (kind in ("ad", "note", "side", "foot") and r.random() < 0.6)
            body = prose() if long else short()
            if kind in ("menu", "share") or (kind == "side" and r.random() < 0.5):
                body = f'<a href="/{word()}">{body}</a>'
            form = r.choice(("li", "li", "div", "p") if kind in ("menu", "share") else ("p", "p", "div", "li", "label" if kind == "form" else "p", "h3", ""))
            items.append(f"<{form}>{body}</{form}>" if form else body + "<hr>")
            out.append(False)
        inner = "".join(items)
        if tag not in ("ul",) and "<li" in inner and r.random() < 0.7:
            inner = f"<ul>{inner}</ul>"
        return f"<{tag}{attrs(name)}>{inner}</{tag}>"

    def article(out: list[bool]) -> str:
        tag = r.choice(("article", "article", "article", "main", "div", "section", "div"))
        named = tag in ("div", "section") or r.random() < 0.3
        items = []
        if r.random() < 0.8:
            out.append(True)
            h = f"<h1>{sentence(r.randint(1, 9)).rstrip('.')}</h1>"
            items.append(f"<header>{h}</header>" if r.random() < 0.2 else h)
        for _ in range(r.randint(1, 14)):
            form = r.choice(("p",) * 8 + ("h2", "h3", "ul", "ul", "ol", "blockquote", "pre", "table", "open", "div"))
            if form in ("ul", "ol"):
                k = r.randint(1, 4)
                items.append(f"<{form}>" + "".join(f"<li>{r.choice((prose, short))()}</li>" for _ in range(k)) + f"</{form}>")
                out += [True] * k
            elif form == "table":
                items.append("<table><tr>" + "".join(f"<td>{short()}</td>" for _ in range(3)) + "</tr></table>")
                out += [True] * 3
            elif form == "open":
                items.append(f"<p><b>{prose()}<br><p>{prose()}</p>")
                out += [True, True]
            else:
                body = prose()
                if r.random() < 0.15:
                    body += f' <a href="/{word()}">{short()}</a> {sentence(3)}'
                items.append(f"<{form}>{body}</{form}>")
                out.append(True)
            if r.random() < 0.12:
                items.append(aside(r.choice(("ad", "side", "share", "meta", "note", "form")), out, 1))
        if r.random() < 0.12:
            items.append(aside(r.choice(("talk", "foot", "share", "side")), out, 1))
        inner = "".join(items)
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = f"<div{attrs(r.choice(NEUTRAL.split()))}>{inner}</div>"
        return f"<{tag}{attrs(r.choice(CONTENT.split()) if named else None)}>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        out: list[bool] = []
        parts = [aside(k, out) for k in ("note", "head", "menu", "ad", "share") if r.random() < 0.5]
        parts.append(article(out))
        parts += [aside(k, out) for k in ("share", "talk", "side", "ad", "form", "foot") if r.random() < 0.5]
        inner = "".join(parts)
        if r.random() < 0.5:
            inner = f"<div{attrs(r.choice(NEUTRAL.split()))}>{inner}</div>"
        pages.append((f"<html><head><title>{short()}</title></head><body>{inner}</body></html>", out))
    return pages


# ------------------------------------------------------------------ the field


class ChainField:
    """Two-label linear-chain CRF: label scores by feature, and scores of neighbouring labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, blocks: list[list[str]]) -> np.ndarray:
        get = self.index.get
        rows = [[i for f in b if (i := get(f)) is not None] for b in blocks]
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(len(rows), 2)

    def decode(self, blocks: list[list[str]]) -> np.ndarray:
        """Viterbi; of equal paths the one that drops later blocks wins."""
        if not blocks:
            return np.zeros(0, bool)
        s, m = self.scores(blocks).tolist(), self.moves.tolist()
        best, back = s[0], []
        for row in s[1:]:
            step, came = [], []
            for y in (0, 1):
                a, b = best[0] + m[0][y], best[1] + m[1][y]
                came.append(0 if a >= b else 1)
                step.append(max(a, b) + row[y])
            best = step
            back.append(came)
        y = 0 if best[0] >= best[1] else 1
        path = [y]
        for came in reversed(back):
            y = came[y]
            path.append(y)
        return np.array(path[::-1], bool)


def train_field(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = 150, ridge: float = 0.02) -> ChainField:
    """Maximum likelihood with a ridge, by forward-backward over all pages at once and Adam steps."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for b in blocks for f in b})
    index = {f: i for i, f in enumerate(names)}
    longest = max((len(b) for b, _ in pages), default=1)
    row, col = [], []
    y = np.full((len(pages), longest), -1)
    for p, (blocks, labels) in enumerate(pages):
        for t, b in enumerate(blocks):
            y[p, t] = labels[t]
            row += [p * longest + t] * len(b)
            col += [index[f] for f in b]
    row, col = np.array(row), np.array(col)
    real = y >= 0
    target = np.zeros((len(pages), longest, 2))
    target[real, y[real]] = 1
    pair_seen = np.zeros((2, 2))
    both = real[:, 1:] & real[:, :-1]
    np.add.at(pair_seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for turn in range(1, rounds + 1):
        s = np.stack([np.bincount(row, weights=w[col, k], minlength=y.size) for k in (0, 1)], axis=1)
        s = s.reshape(len(pages), longest, 2)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(real[:, t, None], log_sum(a[:, t - 1, :, None] + m, 1) + s[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = log_sum(m[None] + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(real[:, t + 1, None], nxt, 0)
        total = log_sum(a[:, -1], 1)[:, None, None]
        marginal = np.exp(a + b - total) * real[..., None]
        pair = np.exp(a[:, :-1, :, None] + m + (s + b)[:, 1:, None, :] - total[..., None])
        gap = (target - marginal).reshape(-1, 2)
        gw = np.stack([np.bincount(col, weights=gap[row, k], minlength=len(names)) for k in (0, 1)], axis=1) - ridge * w
        gm = pair_seen - (pair * both[..., None, None]).sum(axis=(0, 1)) - ridge * m
        for x, g, k in ((w, gw, 0), (m, gm, 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            x += 0.1 * (state[k] / (1 - 0.9**turn)) / (np.sqrt(state[k + 1] / (1 - 0.99**turn)) + 1e-6)
    return ChainField(index, w, m)


@lru_cache(1)
def default_field() -> ChainField:
    pages = []
    for page, labels in labelled_pages():
        found = [f for _, f in blocks_of(page)]
        if len(found) == len(labels):
            pages.append((found, labels))
    return train_field(pages)


def main_text(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the kept blocks of each page joined by newlines.

    Null and empty pages, and pages without article blocks, give an empty text. White space in a block is one space;
    character references are decoded. Repeated rows each give a row; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())  # as large as its feature names

    def run(frames) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            texts = []
            for page in frame["html"]:
                blocks = blocks_of(page)
                keep = model.decode([f for _, f in blocks])
                texts.append("\n".join(t for (t, _), k in zip(blocks, keep) if k))
            yield pd.DataFrame({
                "page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


@query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
