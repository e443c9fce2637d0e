"""A small tolerant HTML reader: block-level nodes, their text runs and features of each node."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^>]*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+|\d+")
BLANK = re.compile(r"\s+")
MARKS = re.compile(r"[.,;:!?…。、]")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
RAW_TEXT = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("html body article section div main table ul ol dl td th nav aside header footer form fieldset blockquote figure".split())

#: Words of class, id and role that tell what an element is for.
UNWANTED = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs footer header masthead sidebar side rail widget "
    "comment comments reply replies respond disqus cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended more "
    "pagination pager toolbar tools tags meta hidden login search legal copyright skip print".split()
)
WANTED = frozenset("article content main post entry story body text blog page copy prose markdown".split())
FLAGS = ("ad", "nav", "menu", "footer", "header", "sidebar", "comment", "cookie", "notice", "share", "related", "newsletter", "hidden", "article", "content", "post", "main")
#: Different words for one thing.
ALIKE = {"ads": "ad", "advert": "ad", "advertisement": "ad", "banner": "ad", "sponsor": "ad", "sponsored": "ad", "promo": "ad", "promotion": "ad", "navigation": "nav", "navbar": "nav", "breadcrumb": "nav", "breadcrumbs": "nav", "side": "sidebar", "rail": "sidebar", "widget": "sidebar", "comments": "comment", "cmt": "comment", "cmts": "comment", "reply": "comment", "replies": "comment", "respond": "comment", "disqus": "comment", "consent": "cookie", "gdpr": "cookie", "alert": "notice", "popup": "notice", "modal": "notice", "overlay": "notice", "sharing": "share", "social": "share", "recommended": "related", "more": "related", "subscribe": "newsletter", "signup": "newsletter", "entry": "post", "story": "post", "blog": "post", "body": "content", "text": "content", "copy": "content", "prose": "content"}
KINDS = ("p", "h", "list", "li", "table", "article", "section", "div", "nav", "header", "footer", "aside", "form", "figure", "quote", "body")
KIND_OF = {"p": "p", "ul": "list", "ol": "list", "dl": "list", "li": "li", "dt": "li", "dd": "li", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table", "th": "table", "caption": "table", "article": "article", "main": "article", "section": "section", "div": "div", "center": "div", "nav": "nav", "menu": "nav", "header": "header", "hgroup": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "select": "form", "dialog": "form", "figure": "figure", "figcaption": "figure", "blockquote": "quote", "pre": "quote", "address": "footer", "html": "body", "body": "body", **{f"h{i}": "h" for i in range(1, 7)}}


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "text", "link", "marks", "words", "own", "size", "start", "depth", "mark", "inline", "legal")

    def __init__(self, tag: str, parent: int, tokens: frozenset, depth: int, start: int, mark: str = ""):
        self.tag, self.parent, self.tokens, self.depth, self.start, self.mark = tag, parent, tokens, depth, start, mark
        self.children: list[int] = []
        self.text = self.link = self.marks = self.words = self.own = self.inline = self.legal = 0
        self.size = 1


def names(attributes: str) -> tuple[frozenset, str]:
    """Words of class, id and role (with `hidden` where the element is not shown), and data-label."""
    found, label = set(), ""
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role", "aria-label", "itemprop"):
                found.update(ALIKE.get(w, w) for w in NAME.findall(value.lower()))
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value) or key == "aria-hidden" and value == "true":
                found.add("hidden")
            elif key == "data-label":
                label = value
    return frozenset(found), label


def read(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block-level nodes in page order, runs of text: node and collapsed text, one a block)."""
    nodes = [Node("html", -1, frozenset(), 0, 0)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # inline elements stand for the node around them
    piece: list[str] = []
    links = seen = at = 0
    open_ = Counter()  # how many of each tag are open

    def flush() -> None:
        nonlocal seen
        if piece:
            text = BLANK.sub(" ", html.unescape("".join(piece))).strip()
            piece.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.own += len(text)
                node.words += text.count(" ") + 1
                node.marks += len(MARKS.findall(text))
                node.legal += "©" in text
                seen += len(text)
                runs.append((stack[-1][1], text))

    def pop_to(i: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[i:]):
            flush()
        open_.subtract(t for t, _ in stack[i:])
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            chunk = page[at : m.start()]
            piece.append(chunk)
            if links:
                nodes[stack[-1][1]].link += len(BLANK.sub(" ", html.unescape(chunk)).strip())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if not open_[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if (tag in INLINE or tag == "p") and stack[i][0] in SCOPE:
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW or tag == "head":
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body)", re.I).search(page, at)
                # What is left open takes the rest of the page only if it holds no markup.
                at = end.end() if end else len(page) if tag in RAW_TEXT else at
            if tag != "title":
                piece.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                piece.append(" ")
            continue
        if tag in ("html", "body") and len(nodes) > 1 and any(n.tag == tag for n in nodes):
            continue
        if tag == "html":
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            open_[tag] += 1
            nodes[stack[-1][1]].inline += 1
            links += tag == "a"
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in SAME:
            low = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SAME[tag]:
                    low = i
                elif stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
            if low < len(stack):
                pop_to(low)
        flush()
        tokens, label = names(attributes)
        parent = stack[-1][1]
        nodes.append(Node(tag, parent, tokens, nodes[parent].depth + 1, seen, label))
        nodes[parent].children.append(len(nodes) - 1)
        stack.append((tag, len(nodes) - 1))
        open_[tag] += 1
    if at < len(page):
        piece.append(page[at:])
    flush()
    for node in reversed(nodes):
        node.text += node.own
        if node.parent >= 0:
            up = nodes[node.parent]
            for field in ("text", "link", "marks", "words", "size", "inline", "legal"):
                setattr(up, field, getattr(up, field) + getattr(node, field))
    return nodes, runs


N_FEATURES = len(KINDS) + 2 * len(FLAGS) + 26


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node: kind, words of its attributes and of its ancestors', density, depth and siblings."""
    total = max(1, nodes[0].text)
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    above: list[frozenset] = []
    kinds_above: list[frozenset] = []
    # One pass over each parent's children: place, neighbours' text, average text, how many have which tag.
    place, before, after = ([0] * len(nodes) for _ in range(3))
    looks = [0.0] * len(nodes)  # share of the siblings of the same tag and attribute words
    average, tags = [total / 100.0] * len(nodes), [Counter()] * len(nodes)
    for p, n in enumerate(nodes):
        average[p] = sum(nodes[c].text for c in n.children) / max(1, len(n.children)) / 100
        tags[p] = Counter(nodes[c].tag for c in n.children)
        seen = Counter((nodes[c].tag, nodes[c].tokens) for c in n.children)
        for k, c in enumerate(n.children):
            looks[c] = seen[nodes[c].tag, nodes[c].tokens] / len(n.children)
            place[c] = k
            before[c] = nodes[n.children[k - 1]].text if k else 0
            after[c] = nodes[n.children[k + 1]].text if k + 1 < len(n.children) else 0
    for i, n in enumerate(nodes):
        kind = KIND_OF.get(n.tag, "div")
        up = above[n.parent] if n.parent >= 0 else frozenset()
        kinds_up = kinds_above[n.parent] if n.parent >= 0 else frozenset()
        above.append(up | n.tokens)
        kinds_above.append(kinds_up | {kind})
        row = out[i]
        row[KINDS.index(kind)] = 1
        k = len(KINDS)
        for f in FLAGS:
            row[k], row[k + 1] = f in n.tokens, f in up
            k += 2
        n_siblings = len(nodes[n.parent].children) if n.parent >= 0 else 1
        alike = tags[n.parent][n.tag] / n_siblings if n.parent >= 0 else 1.0
        around = average[n.parent] if n.parent >= 0 else total / 100
        parent_text = max(1, nodes[n.parent].text) if n.parent >= 0 else total
        row[k:] = (
            np.log1p(n.text), n.link / max(1, n.text), n.text / n.size, n.marks / max(1, n.words), np.log1p(n.words / n.size), n.own / max(1, n.text), n.depth, np.log1p(n.size),
            n.text / total, n.start / total, n.text / parent_text, n_siblings, place[i] / n_siblings, alike, around,
            np.log1p(before[i]), np.log1p(after[i]), bool(n.tokens & UNWANTED), bool(up & UNWANTED), bool(n.tokens & WANTED), bool(up & WANTED), 2 * bool(kinds_up & {"nav", "header", "footer", "aside", "form"}) + ("article" in kinds_up),
            looks[i], n.inline / max(1, n.words), n.legal > 0, len(n.children),
        )
    return out
