"""Main text of pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Each word has a score from the elements it stands in, positive in
what looks like content, each tag a negative one; the contiguous stretch with the greatest sum is the content
region, found by one linear scan.  Words in it whose own score is negative (an advert or a form amid the
article) are left out.  The weights are fitted on labelled pages, which ``labelled_pages`` makes by templates.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import ship

#: A comment, declaration, tag or text that is just a character; attributes may hold > in quotes.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
MAIN, OTHER = "\ue000", "\ue001"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no content; the first five are read up to their end tag as they stand.
RAW = frozenset("script style template textarea xmp".split())
SKIP = RAW | frozenset("head title noscript svg select option button iframe object canvas datalist audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _context(tag: str, attributes: str) -> tuple[str, ...]:
    """The features that an element lends to the words in it."""
    out = [f"tag:{tag}"]
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            if name == "hidden" or value.strip("\"'").lower() == "true":
                out.append("hidden")
        else:
            out += [f"name:{w}" for w in _WORDS.findall(value.lower())]
    return tuple(dict.fromkeys(out))


def pieces(page: str, known: frozenset[str] | None = None) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """The page as ("text", decoded text, features), ("tag", name, ()) and ("break", name, ()) where a block begins or ends.

    Features are those of all open elements; only those in ``known`` where given, so that what a level holds is bounded.
    Each level keeps its own, and how many elements of a name are open is counted, so deep nesting costs no more than flat."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    at, n, skipping = 0, len(page), 0

    def cut(depth: int) -> None:
        nonlocal skipping
        for tag, _ in stack[depth:]:
            opened[tag] -= 1
            skipping -= tag in SKIP
        del stack[depth:]

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not skipping:
            yield "text", html.unescape(text), stack[-1][1] if stack else ()
        if not m:
            return
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not skipping and tag not in SKIP:
            yield ("tag" if tag in INLINE else "break"), tag, ()
        if closing:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                cut(depth)
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW:
            continue
        if tag in ENDS_P:
            depth = len(stack) - 1 if opened["p"] > 0 else -1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] == "p":
                cut(depth)
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            if stack and stack[-1][0] == tag:
                cut(len(stack) - 1)
        if tag == "body" and opened["head"] > 0:  # a head that was never ended
            cut(next(depth for depth, (t, _) in enumerate(stack) if t == "head"))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        own = [f for f in _context(tag, m[3]) if known is None or f in known]
        above = stack[-1][1] if stack else ()
        stack.append((tag, above if all(f in above for f in own) else tuple(dict.fromkeys([*above, *own]))))
        opened[tag] += 1
        skipping += tag in SKIP


class Model:
    """Weights of the features, a bias, and the score of a tag."""

    def __init__(self, weights: dict[str, float], bias: float, tag: float):
        self.weights, self.bias, self.tag = weights, bias, tag
        self._known = frozenset(weights)
        self._seen: dict[tuple[str, ...], float] = {}

    def score(self, features: tuple[str, ...]) -> float:
        s = self._seen.get(features)
        if s is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            # text that stands in no element tells nothing against itself
            s = self._seen[features] = max(-0.5, min(1.0, self.bias + sum(self.weights.get(f, 0.0) for f in features))) if features else 1.0
        return s

    def extract(self, page: str | None) -> str:
        """The main text: blocks of the best region, white space turned into one space, joined by an empty line."""
        found = list(pieces(page or "", self._known))
        best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
        for i, (kind, text, features) in enumerate(found):
            total += self.score(features) * len(text.split()) if kind == "text" else self.tag
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, best_from, best_to = total, start, i + 1
        blocks, now = [], []
        for kind, text, features in found[best_from:best_to]:
            if kind == "break":
                blocks.append("".join(now))
                now = []
            elif kind == "tag":
                if text == "br":
                    now.append(" ")
            elif self.score(features) > 0:
                now.append(text)
        blocks.append("".join(now))
        return "\n\n".join(t for b in blocks if (t := " ".join(b.split())))


_TOPICS = "river stone lamp garden winter market silver bridge harbour letter music window valley captain orchard mirror thunder carpet engine shadow".split()


def labelled_pages(n: int = 120, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (markup, is it main text), of a dozen layouts filled by a seeded generator."""
    r = np.random.default_rng(seed)
    words = lambda a, b: " ".join(r.choice(_TOPICS, int(r.integers(a, b))))
    links = lambda k: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))
    out = []
    for _ in range(n):
        pick = lambda *xs: str(r.choice(xs))
        page = [(f'<html><head><title>{words(3, 9)}</title></head><body class="{pick("page", "site", "home")}">', False)]
        page.append((pick(f"<header><h1>{words(1, 4)}</h1></header>", f'<div class="header">{words(2, 6)}</div>', f'<div id="masthead" role="banner">{words(2, 6)}</div>', ""), False))
        page.append((pick(f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(8)}</ul></div>', f'<ul class="nav navbar">{links(7)}</ul>', f'<div role="navigation">{links(5)}</div>', f'<div class="breadcrumb breadcrumbs"><a href="/">{words(1, 3)}</a></div>'), False))
        page.append((pick(f'<div class="cookie notice">{words(6, 20)}</div>', f'<div id="cookie-banner">{words(6, 20)}</div>', f'<div class="consent popup modal">{words(6, 20)}</div>', f'<p class="alert notification">{words(5, 12)}</p>', "", ""), False))
        page.append((pick(f'<div class="ad">{words(5, 25)}</div>', f'<div class="advert ads advertisement">{words(5, 25)}</div>', f'<div class="sponsored promo">{words(5, 25)}</div>', f'<div class="banner">{words(3, 9)}</div>', ""), False))
        opening, closing = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div class="content article-body">', "</div>"), ('<div id="main" class="post entry">', "</div>"), ('<div class="story text">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ('<main id="content">', "</main>")][int(r.integers(8))]
        page.append((f"{opening}<h1>{words(3, 9)}</h1>", True))
        for i in range(int(r.integers(2, 14))):
            page.append((pick(*[f"<p>{words(8, 60)}</p>"] * 6, f"<h2>{words(2, 7)}</h2>", f"<blockquote><p>{words(8, 30)}</p></blockquote>", f"<ul><li>{words(4, 14)}</li><li>{words(4, 14)}</li></ul>", f"<p>{words(4, 12)} <a href='/x'>{words(1, 3)}</a> {words(4, 12)} <b>{words(1, 3)}</b></p>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(4, 16)}</pre>", f"<figure><figcaption>{words(3, 9)}</figcaption></figure>"), True))
            if r.random() < 0.12:
                page.append((pick(f'<div class="ad inline">{words(5, 20)}</div>', f"<aside>{words(8, 25)}</aside>", f'<div class="related more"><ul>{links(4)}</ul></div>', f'<form class="newsletter subscribe signup">{words(4, 12)}</form>', f'<div class="share social">{links(3)}</div>'), False))
        page.append((closing, True))
        page.append((pick(f'<aside class="sidebar"><h3>{words(1, 3)}</h3><ul>{links(6)}</ul><p>{words(8, 20)}</p></aside>', f'<div id="sidebar" class="widget">{words(6, 20)}<ul>{links(5)}</ul></div>', f'<div class="related recommended">{links(6)}</div>', ""), False))
        page.append((pick(f'<section class="comments" id="comments"><div class="comment"><p>{words(8, 40)}</p></div><div class="comment reply"><p>{words(8, 40)}</p></div></section>', f'<div id="disqus" class="comment-list responses"><p>{words(8, 40)}</p><p>{words(8, 40)}</p></div>', "", ""), False))
        page.append((pick(f"<form>{words(3, 10)}<label>{words(1, 3)}</label></form>", f'<form class="search login">{words(2, 6)}</form>', ""), False))
        page.append((pick(f"<footer>{words(5, 20)}</footer>", f'<div class="footer copyright">{words(5, 20)}</div>', f'<div id="footer" role="contentinfo"><p>{words(5, 20)}</p></div>') + "</body></html>", False))
        out.append(page)
    return out


def nested_pages(n: int = 60, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """More labelled pages: what is no main text stands inside the article, with paragraphs and lists of its own."""
    r = np.random.default_rng(seed)
    words = lambda a, b: " ".join(r.choice(_TOPICS, int(r.integers(a, b))))
    out = []
    for _ in range(n):
        pick = lambda *xs: str(r.choice(xs))
        opening, closing = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div class="content article-body">', "</div>"), ("<main><section>", "</section></main>"), ('<article class="post entry">', "</article>")][int(r.integers(5))]
        page = [(f"<html><body>{opening}<h1>{words(3, 9)}</h1>", True)]
        for _ in range(int(r.integers(3, 9))):
            page.append((pick(*[f"<p>{words(8, 60)}</p>"] * 5, f"<section><h2>{words(2, 7)}</h2><p>{words(8, 40)}</p></section>", f"<div><p>{words(8, 40)}</p></div>", f"<ul><li>{words(4, 14)}</li><li><p>{words(4, 14)}</p></li></ul>", f"<p>{words(4, 9)} <math><mi>{words(1, 2)}</mi></math> {words(4, 9)}</p>"), True))
            if r.random() < 0.3:
                name = pick("ad", "advert", "ads advertisement", "sponsored promo", "banner", "cookie notice", "consent popup", "sidebar widget", "related more", "newsletter subscribe signup", "share social", "menu nav")
                inner = pick(f"<p>{words(5, 25)}</p>", f"<p>{words(5, 15)}</p><ul><li>{words(1, 4)}</li></ul>", f"<h3>{words(1, 4)}</h3><p>{words(5, 15)}</p>")
                page.append((pick(f'<div class="{name}">{inner}</div>', f'<div class="{name}">{inner}</div>', f"<aside>{inner}</aside>", f'<section class="{name}">{inner}</section>', f"<form>{inner}</form>", f"<nav>{inner}</nav>"), False))
        name = pick("comments", "comment-list", "comments-area", "responses", "discussion comments", "replies", "disqus", "reader-comments")
        own = lambda: pick(f'<div class="comment"><p>{words(3, 40)}</p></div>', f"<p>{words(3, 40)}</p>", f"<article><p>{words(3, 40)}</p></article>", f'<ol><li class="comment reply"><p>{words(3, 40)}</p></li></ol>')  # noqa: E731, B023
        page.append((pick(f"<section class='{name}'>{own()}{own()}</section>", f'<div id="{name}">{own()}{own()}{own()}</div>', f'<section id="{name}"><h2>{words(1, 3)}</h2>{own()}</section>'), False))
        page.append((closing, True))
        page.append((f"<footer><p>{words(5, 20)}</p></footer></body></html>", False))
        out.append(page)
    return out


def train(pages: list[list[tuple[str, bool]]] | None = None) -> Model:
    """Logistic weights of the features by word, and the tag score that keeps most labelled words right."""
    pages = labelled_pages() + nested_pages() if pages is None else pages
    rows: dict[tuple[tuple[str, ...], bool], int] = {}
    for page in pages:
        # a private character before each part tells whether it is main text
        marked = "".join((MAIN if main else OTHER) + part for part, main in page)
        main = False
        for kind, text, features in pieces(marked):
            if kind != "text":
                continue
            for part in re.split(f"([{MAIN}{OTHER}])", text):
                if part in (MAIN, OTHER):
                    main = part == MAIN
                elif n := len(part.split()):
                    rows[features, main] = rows.get((features, main), 0) + n
    names = sorted({f for fs, _ in rows for f in fs})
    code = {f: i for i, f in enumerate(names)}
    x, y, w = np.zeros((len(rows), len(names))), np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((fs, main), n) in enumerate(rows.items()):
        x[i, [code[f] for f in fs]] = 1
        y[i], w[i] = main, n
    w /= w.sum()
    theta, bias = np.zeros(len(names)), 0.0
    for _ in range(3000):
        g = w * (1 / (1 + np.exp(-np.clip(x @ theta + bias, -30, 30))) - y)
        theta -= 4.0 * (x.T @ g + 1e-5 * theta)
        bias -= 4.0 * g.sum()
    weights = {f: round(float(t), 4) for f, t in zip(names, theta)}
    weights["hidden"] = -6.0
    best = (-1.0, 0.0)
    for tag in (-0.05, -0.2, -0.5, -1.0, -2.0):
        model = Model(weights, float(bias), tag)
        right = sum(model.extract("".join(p for p, _ in page)) == _truth(page) for page in pages[::3])
        best = max(best, (right, tag))
    return Model(weights, round(float(bias), 4), best[1])


def _truth(page: list[tuple[str, bool]]) -> str:
    """The main text of a labelled page, by reading its main parts alone."""
    return Model({}, 1.0, 0.0).extract("".join(part for part, main in page if main))


_model: Model | None = None


def main_text(df: DataFrame, html_col: str = "html", *, out_col: str = "main_text", model: Model | None = None) -> DataFrame:
    """df with the main text of each page: character references decoded, white space inside a block turned into one
    space, blocks in page order joined by an empty line; empty if there is none, as for null and empty pages.

    Nothing is cut off or capped.  A column of df named out_col is replaced, all others stay.  One pass, no shuffle.
    """
    global _model
    ship(df.sparkSession)
    if model is None:
        _model = _model or train()
        model = _model
    weights, bias, tag = model.weights, model.bias, model.tag

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias, tag)
        for p in parts:
            yield pd.Series([own.extract(x) for x in p], dtype=object)

    return df.withColumn(out_col, extract(F.col(html_col).cast("string")))
