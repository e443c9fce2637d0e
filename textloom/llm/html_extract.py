"""HTML main-text extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

Each block-level node gets a log-odds of belonging to the article from boosted trees over its
features: subtree density, attribute words, depth and siblings. Decoding picks the set of nodes with
the greatest total log-odds in which no node is kept under a dropped one, so the text never mixes a
dropped container with kept descendants.

The trees are fitted here, on pages that this module makes up from site templates with known labels
(`training_pages` of them, seeded), so nothing is learned from the table and reruns agree.

Defined results: null or empty html gives an empty text of 0 characters; unclosed and stray tags are
repaired; repeated rows repeat; only the key, url and html columns are read; an empty table gives an
empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table, text_batches
from .html_tree import Node, features, read

BINS = 24


class Boosted:
    """Logistic gradient boosting with histogram splits on quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and threshold of inner nodes, values of leaves
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                place = at - first
                best = np.full(width, 1e-6)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    slot = place * (len(e) + 1) + binned[:, f]
                    shape = (width, len(e) + 1)
                    gs = np.bincount(slot, g, shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                    hs = np.bincount(slot, h, shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                    gl, hl = gs[:, :-1], hs[:, :-1]
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    b = gain.argmax(axis=1)
                    top = gain[np.arange(width), b]
                    for n in np.flatnonzero(top > best):
                        best[n], feature[first + n], cut[first + n] = top[n], f, e[b[n]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[every, feature[at]] > cut[at])
            score += value[at - len(feature)]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the best total of log-odds among sets closed under parents. The root is kept."""
    worth = odds.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[nodes[i].parent] += worth[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and worth[i] > 0
    return kept


def main_text(runs: list[tuple[int, str]], kept: list[bool]) -> str:
    return "\n\n".join(text for node, text in runs if kept[node])


# ---- made-up training pages -------------------------------------------------------------------


class PageMaker:
    """Pages of made-up words, built from site templates; data-label tells what is article and what is not."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = ["".join(self.r.choice("bcdfglmnprstv") + self.r.choice("aeiouéä") for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def words(self, a: int, b: int) -> str:
        return " ".join(self.r.choice(self.parts) for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        return self.words(3, 22).capitalize() + self.r.choice([".", ".", ".", "!", "?", ", " + self.words(2, 8) + "."])

    def prose(self, a: int = 1, b: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def attrs(self, *pool: str, label: str | None = None) -> str:
        name = self.r.choice(pool) if pool else ""
        how = self.r.choice(["class", "class", "id"])
        text = f' {how}="{name}"' if name else ""
        return text + (f' data-label="{label}"' if label else "")

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(n))

    def boiler(self, kind: str) -> str:
        r, label = self.r, "0"
        if kind == "nav":
            if r.random() < 0.2:
                return f"<div class={self.dull()} data-label=\"0\">" + r.choice([" ", " | ", ""]).join(f'<a href="/{self.words(1, 1)}">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 9))) + "</div>"
            return r.choice([f"<nav{self.attrs('', '', 'nav', 'main-nav', label=label)}><ul>{self.links(r.randint(2, 9))}</ul></nav>", f"<ul{self.attrs('menu', 'navigation', 'nav-list', 'breadcrumb', label=label)}>{self.links(r.randint(2, 9))}</ul>", f"<div{self.attrs('menu', 'navbar', 'top', label=label)}>" + " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 8))) + "</div>"])
        if kind == "header":
            return f"<header{self.attrs('', '', 'site-header', 'masthead', label=label)}><div{self.attrs('', 'logo', 'brand')}>{self.words(1, 4)}</div>{r.choice(['', f'<p>{self.words(2, 8)}</p>', f'<h1>{self.words(1, 3)}</h1>'])}</header>"
        if kind == "footer":
            if r.random() < 0.2:
                return f"<div class={self.dull()} data-label=\"0\">{r.choice(['&copy; ', 'Copyright &copy; '])}{r.randint(1990, 2030)} {self.words(1, 3)}. {r.choice(['', self.sentence()])}</div>"
            return r.choice([f"<footer{self.attrs('', '', 'site-footer', label=label)}>&copy; {self.words(1, 2)} &middot; {self.prose(1, 2)}</footer>", f"<div{self.attrs('footer', 'copyright', 'page-footer', 'legal', label=label)}><p>&copy; {self.prose(1, 2)}</p><p>{self.words(2, 8)}</p></div>", f"<footer{self.attrs('', label=label)}><ul>{self.links(3)}</ul><p>{self.sentence()}</p></footer>"])
        if kind == "sidebar":
            tag = r.choice(["aside", "div"])
            pool = ("", "", "sidebar") if tag == "aside" else ("sidebar", "side-col", "right-rail", "widget")
            return f"<{tag}{self.attrs(*pool, label=label)}><h3>{self.words(1, 3)}</h3><ul>{self.links(r.randint(2, 6))}</ul>{r.choice(['', f'<p>{self.prose(1, 3)}</p>'])}</{tag}>"
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'section', 'aside', 'p']))}{self.attrs('ad', 'ads', 'advert', 'banner-ad', 'sponsored', 'promo-box', label=label)}>{self.prose(1, 3)}</{t}>"
        if kind == "notice":
            return f"<div{self.attrs('cookie-notice', 'cookie-banner', 'notice', 'alert', 'gdpr-consent', 'popup', 'modal', label=label)}>{r.choice(['<p>' + self.prose(1, 3) + '</p>', self.prose(1, 2)])}<button>{self.words(1, 2)}</button></div>"
        if kind == "form":
            return r.choice([f'<form action="/s"{self.attrs("", "search", "newsletter-form", label=label)}><label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button></form>', f"<div{self.attrs('newsletter', 'subscribe', 'signup', label=label)}><p>{self.prose(1, 2)}</p><form><input><button>{self.words(1, 1)}</button></form></div>"])
        if kind == "share":
            return f"<{(t := r.choice(['ul', 'div']))}{self.attrs('share', 'social-links', 'share-buttons', label=label)}>" + (self.links(3) if t == "ul" else " ".join(f'<a href="#">{self.words(1, 1)}</a>' for _ in range(3))) + f"</{t}>"
        if kind == "related":
            return f"<{(t := r.choice(['div', 'section', 'aside']))}{self.attrs('related', 'related-posts', 'recommended', 'read-more', label=label)}><h3>{self.words(1, 3)}</h3><ul>{self.links(r.randint(2, 6))}</ul></{t}>"
        if r.random() < 0.5:
            one = lambda: f"<{(t := r.choice(['li', 'div', 'article']))}{self.attrs('comment', 'comment-body', 'reply')}><p>{r.choice(['', f'<b>{self.words(1, 2)}</b> '])}{self.prose(1, 4)}</p></{t}>"
            many = "".join(one() for _ in range(r.randint(1, 6)))
            return f"<{(t := r.choice(['section', 'div', 'ol']))}{self.attrs('comments', 'comment-list', 'reader-comments', 'responses comments', 'discussion comments', label=label)}><h3>{self.words(1, 2)}</h3>{many}</{t}>"
        # Threads whose names say nothing: like entries in a row, each with a name, often a date, and a few words.
        tag, inner, name = r.choice(["li", "div", "div", "section"]), r.choice(["p", "div", ""]), r.choice(["", self.dull(), self.dull()])
        date = r.choice(["", f"<i>{r.randint(1, 28)} {self.words(1, 1)}</i> ", f"<span>{r.randint(1, 28)}.{r.randint(1, 12)}.</span> ", f"<time>{r.randint(1, 12)} h</time> "])
        entry = lambda: f"<b>{self.words(1, 2)}</b> {date}{self.prose(1, 3)}{r.choice(['', f' <a href=#>{self.words(1, 1)}</a>'])}"
        wrap = lambda x: f"<{tag}{f' class={name}' if name else ''}>{f'<{inner}>{x}</{inner}>' if inner else x}</{tag}>"
        many = "".join(wrap(entry()) for _ in range(r.randint(2, 9)))
        t = "ol" if tag == "li" else r.choice(["div", "section", "div"])
        return f"<{t} class={self.dull()} data-label=\"0\">{r.choice(['', f'<h3>{self.words(1, 3)}</h3>'])}{many}</{t}>"

    def dull(self) -> str:
        """A class name without a meaning."""
        return self.r.choice([f"c{self.r.randint(1, 40)}", self.r.choice(self.parts), f"{self.r.choice('uxqz')}-{self.r.choice(self.parts)}", "wrap", "box", "thread", "item"])

    def block(self) -> str:
        r = self.r
        pick = r.random()
        if pick < 0.62:
            text = self.prose()
            if r.random() < 0.25:
                cut = text.split(" ")
                i = r.randrange(len(cut))
                cut[i] = f'<{(t := r.choice(["b", "i", "em", "strong", "a", "span"]))}{" href=#" if t == "a" else ""}>{cut[i]}</{t}>'
                text = " ".join(cut)
            return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"])
        if pick < 0.68:
            return f"<p>{self.words(1, 4)}.</p>"
        if pick < 0.78:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 8)}</h{n}>"
        if pick < 0.86:
            return "<ul>" + "".join(f"<li>{self.words(2, 14)}{r.choice(['', '.'])}</li>" for _ in range(r.randint(2, 7))) + "</ul>"
        if pick < 0.90:
            return f"<blockquote>{r.choice(['<p>' + self.prose(1, 3) + '</p>', self.prose(1, 2)])}</blockquote>"
        if pick < 0.94:
            return f"<div{self.attrs('', 'para', 'paragraph', 'section')}>{self.prose()}</div>"
        if pick < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f"<figure><img src=x.png><figcaption>{self.words(3, 12)}.</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 4, 8, 14]))]
        if r.random() < 0.8:
            blocks.insert(0, f"<h1>{self.words(1, 12)}</h1>")
        if r.random() < 0.12:  # stubs: a title, or a few words more
            blocks = [f"<h1>{(title := self.words(1, 9))}</h1>", r.choice(["", f"<p>{title}</p>", f"<p><b>{title}<br>", f"<p>{self.words(1, 6)}.</p>"])]
        for kind in ("ad", "share", "related", "form", "notice", "sidebar"):
            if r.random() < 0.12:
                blocks.insert(r.randint(1, len(blocks)), self.boiler(kind))
        inner = "".join(blocks)
        if r.random() < 0.15:
            inner = f"<div{self.attrs('entry-content', 'post-body', 'article-text', 'content')}>{inner}</div>"
        return r.choice([f"<article{self.attrs('', '', 'post', label='1')}>{inner}</article>", f"<main{self.attrs('', label='1')}>{inner}</main>", f"<div{self.attrs('content', 'article', 'post-content', 'main-content', 'story', 'entry', label='1')}>{inner}</div>", f"<section{self.attrs('', 'article', 'content', label='1')}>{inner}</section>", f"<div{self.attrs('', 'wrap', 'container', 'c1', label='1')}>{inner}</div>"])

    def page(self) -> str:
        r = self.r
        top = [self.boiler(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < (0.7 if k == "nav" else 0.4)]
        bottom = [self.boiler(k) for k in ("comment", "related", "sidebar", "share", "form", "ad", "notice", "footer") if r.random() < (0.85 if k == "footer" else 0.3)]
        r.shuffle(top)
        body = "".join(top) + self.article() + "".join(bottom)
        if r.random() < 0.4:
            body = f"<div{self.attrs('', 'wrapper', 'page', 'container', 'site')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labels_of(nodes: list[Node]) -> np.ndarray:
    """1 for nodes of the article and for those around it, 0 for the rest."""
    own = [""] * len(nodes)
    for i, n in enumerate(nodes):
        own[i] = n.mark or (own[n.parent] if n.parent >= 0 else "")
    y = np.array([x == "1" for x in own])
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] and not own[nodes[i].parent]:
            y[nodes[i].parent] = True
    return y


@lru_cache(2)
def model(training_pages: int = 1200, seed: int = 5) -> "Boosted":
    maker = PageMaker(seed)
    read_ = [read(maker.page())[0] for _ in range(training_pages)]
    return Boosted().fit(np.concatenate([features(n) for n in read_]), np.concatenate([labels_of(n) for n in read_]).astype(np.float64))


def extract_batch(pages: list[str], trees: Boosted) -> list[str]:
    parsed = [read(p) for p in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.concatenate([features(n) for n, _ in parsed]))
    out, at = [], 0
    for nodes, runs in parsed:
        out.append(main_text(runs, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row. The trees' size is set by their parameters."""
    trees = model()
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in text_batches(batches, page):
            texts = extract_batch(pages, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    return arrow_map(df.select(key, url, page), run, f"{key} {df.schema[key].dataType.simpleString()}, {url} string, text string, n_chars bigint")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
