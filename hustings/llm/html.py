"""Operator 4: main-text extraction by a tree-structured graphical model over DOM nodes.

Block elements are the nodes of a tree; each is content, noise or the frame around both. A node's features (tag, words
of its class, id and role, length, share of links) have a likelihood in each state, and a parent and its child
have a 3 x 3 potential. Messages are passed up and down the tree (sum-product), which gives every node's exact marginal;
text of nodes whose marginal is at least one half is the page's content. All potentials are smoothed counts from labelled pages.

Defined results: a null, empty or textless page gives the empty string; broken mark-up is closed as browsers do for
paragraphs, lists and tables, a quote opens an attribute's value only behind an equals sign, and a tag cut off at the end
is dropped; formulas and words of drawings belong to the text around them, form controls (buttons too) are left out;
text outside any block counts as a paragraph; repeated rows are extracted each; other columns are not carried; an empty
table gives an empty table. A marginal of exactly one half counts as content.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import table

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object canvas select textarea button datalist video audio".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics svg g defs use path circle rect line polyline polygon ellipse text tspan".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table html body".split())

ITEMS = frozenset("td th li dd dt tr".split())


def _token(inside: str) -> re.Pattern[str]:
    """Comments, elements of raw text, declarations, tags and a tag cut off at the end; `inside` is what a tag may hold.

    Group 5 is the start of a tag that nothing closes.
    """
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe)\b{inside}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({inside})>|<[a-zA-Z/][^<>]*\Z|(<)(?=/?[a-zA-Z])",
        re.S | re.I,
    )


# A quote opens a value only behind an equals sign. Behind a tag that nothing closes, tags end before the next `<`, so
# that no start of a tag reads on to the end of the page.
TOKEN = _token(r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+")
CLOSED = _token(r"(?:=\s*\"[^\"<]*\"|=\s*'[^'<]*'|[^<>])*+")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    label: bool | None = None
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    """nodes in page order (parents first); runs of (node, raw text) in page order."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Block elements as nodes; the text of inline elements belongs to the block around them."""
    page = Page([Node("html", -1)])
    stack, links, silent = [("html", 0)], 0, 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
    containers, blocks = [0], [0]  # places of what an end implied by an item or cell, or by another block, doesn't cross
    at = loose = 0

    def text(raw: str) -> None:
        nonlocal loose
        if raw and not silent:
            node = stack[-1][1] or loose
            if not node and raw.strip():  # text outside any block is a paragraph
                page.nodes.append(Node("p", 0))
                node = loose = len(page.nodes) - 1
            page.runs.append((node, raw))
            size = len(raw.strip())
            page.nodes[node].chars += size
            if links:
                page.nodes[node].linked += size

    def open_(tag: str, node: int) -> None:
        nonlocal links, silent
        k = len(stack)
        stack.append((tag, node))
        places[tag].append(k)
        links += tag == "a"
        silent += tag in SILENT
        if tag in CONTAINERS:
            containers.append(k)
        if tag in CONTAINERS or (tag not in INLINE and tag not in ITEMS):
            blocks.append(k)

    def close(k: int) -> None:
        nonlocal links, silent
        for tag, _ in stack[k:]:
            links -= tag == "a"
            silent -= tag in SILENT
            places[tag].pop()
        for known in (containers, blocks):
            while known[-1] >= k:
                known.pop()
        del stack[k:]

    def tokens() -> Iterator[re.Match[str]]:
        for m in TOKEN.finditer(html):
            if m[5]:
                yield from (m for m in CLOSED.finditer(html, m.start()) if not m[5])
                return
            yield m

    for m in tokens():
        text(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag == "br":
            text("\n")
        if tag in VOID:
            continue
        if tag in INLINE or tag in SILENT:
            if not m[4].endswith("/"):
                open_(tag, stack[-1][1])
            continue
        if tag in ("html", "body"):
            continue
        # A block ends an open paragraph, an item or cell ends its predecessor; not beyond a container of its own.
        k = max((places[x][-1] for x in (*CLOSES.get(tag, ()), "p") if places[x]), default=0)
        if k and k >= (containers if tag in CLOSES else blocks)[-1]:
            close(k)
        words, label = [], None
        for name, *values in ATTRIBUTE.findall(m[4]):
            value = next(filter(None, values), "").lower()
            if name.lower() == "data-content":
                label = value == "1"
            else:
                words += re.findall(r"[a-z]+", value)
        page.nodes.append(Node(tag, stack[-1][1], tuple(words), label))
        loose = 0
        open_(tag, len(page.nodes) - 1)
    text(html[at:])
    return page


def features(node: Node) -> tuple[str, ...]:
    out = [f"tag {node.tag}", f"chars {min(8, node.chars.bit_length())}"]
    if node.chars:
        out.append(f"links {round(4 * min(1.0, node.linked / node.chars))}")
    return (*out, *(f"word {w}" for w in dict.fromkeys(node.words)), *([] if node.words else ["no words"]))


FRAME, CONTENT, NOISE = range(3)


@dataclass
class Potentials:
    """Log-likelihood of a feature in each state, of an unseen one, and the potentials [parent][child]."""

    seen: dict[str, tuple[float, float, float]]
    unseen: tuple[float, float, float]
    edge: list[list[float]]

    def evidence(self, found: tuple[str, ...]) -> tuple[float, float, float]:
        """Relative likelihoods of a node's features, the largest 1."""
        logs = [sum(x) for x in zip(*(self.seen.get(f, self.unseen) for f in found), strict=True)]
        high = max(logs)
        return tuple(math.exp(max(-300.0, x - high)) for x in logs)


def fit(pages: list[str], smoothing: float = 0.5) -> Potentials:
    """Smoothed counts over labelled pages: data-content of 1 or 0 holds for an element and what is below it."""
    seen, edges, states = [Counter(), Counter(), Counter()], np.full((3, 3), smoothing), np.zeros(3)
    for html in pages:
        page = parse(html)
        labels: list[int] = []
        for node in page.nodes:
            labels.append((NOISE, CONTENT)[node.label] if node.label is not None else labels[node.parent] if node.parent >= 0 else FRAME)
            states[labels[-1]] += 1
            if node.parent >= 0:
                edges[labels[node.parent], labels[-1]] += 1
            seen[labels[-1]].update(features(node))
    log = lambda f: tuple(math.log((seen[s][f] + smoothing) / (states[s] + 2 * smoothing)) for s in range(3))
    unseen = math.log(smoothing)
    return Potentials({f: log(f) for f in set().union(*seen)}, (unseen, unseen, unseen), (edges / edges.sum(axis=1, keepdims=True)).tolist())


def marginals(nodes: list[Node], model: Potentials) -> list[float]:
    """P(content) of each node by one upward and one downward pass of messages over the three states."""
    edge = model.edge
    n = len(nodes)
    known: dict[tuple[str, ...], tuple[float, float, float]] = {}
    up: list[tuple[float, float, float]] = []  # own evidence, then the children's
    for x in nodes:
        found = features(x)
        if found not in known:
            known[found] = model.evidence(found)
        up.append(known[found])
    up[0] = (1.0, 0.0, 0.0)  # the document itself is frame
    sent = [(1.0, 1.0, 1.0)] * n
    for k in range(n - 1, 0, -1):
        a, b, c = up[k]
        x, y, z = (e[0] * a + e[1] * b + e[2] * c for e in edge)
        high = max(x, y, z)
        sent[k] = x, y, z = x / high, y / high, z / high
        a, b, c = up[nodes[k].parent]
        a, b, c = a * x, b * y, c * z
        high = max(a, b, c)
        up[nodes[k].parent] = a / high, b / high, c / high
    belief = [up[0]] * n
    for k in range(1, n):
        a, b, c = belief[nodes[k].parent]
        x, y, z = sent[k]  # the parent without what came from this child
        a, b, c = a / max(x, 1e-300), b / max(y, 1e-300), c / max(z, 1e-300)
        u = up[k]
        x, y, z = (u[s] * (a * edge[0][s] + b * edge[1][s] + c * edge[2][s]) for s in range(3))
        total = x + y + z
        belief[k] = x / total, y / total, z / total
    return [x[CONTENT] / sum(x) for x in belief]


def extract(html: str | None, model: Potentials) -> str:
    page = parse(html or "")
    chance = marginals(page.nodes, model)
    out: list[str] = []
    block, parts = -1, []
    for node, raw in [*page.runs, (-2, "")]:
        if node != block:
            if parts and (whole := " ".join(unescape("".join(parts)).split())):
                out.append(whole)
            block, parts = node, []
        if node >= 0 and chance[node] >= 0.5:
            parts.append(raw)
    return " ".join(out)


def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Made-up pages of common layouts whose elements say whether they are content."""
    rng = random.Random(seed)
    syllables = "la mi ten or que sta ver on di re al to".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    words = lambda low, high: " ".join(word() for _ in range(rng.randrange(low, high)))
    pick = lambda *x: rng.choice(x)

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(n)) + "</ul>"

    def block(longest: int) -> str:
        kind = rng.random()
        if kind < 0.64:
            return f"<p>{words(1, longest)}.</p>"
        if kind < 0.72:
            return f"<{(h := pick('h2', 'h3'))}>{words(1, 8)}</{h}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{words(2, pick(20, 50))}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote><p>{words(5, 40)}.</p></blockquote>"
        if kind < 0.89:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{words(10, 60)}</div>" if kind < 0.98 else f"<figure><figcaption>{words(3, 12)}</figcaption></figure>"

    def noise(*kinds: str) -> str:
        kind = pick(*kinds)
        if kind == "nav":
            tag, name = pick("nav", "div", "ul"), pick("menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "topbar", "toc", "links")
            return f"<{tag} data-content=0 class='{name}'>{links(rng.randrange(2, 9))}</{tag}>" if tag != "nav" or rng.random() < 0.5 else f"<nav data-content=0>{links(rng.randrange(2, 9))}</nav>"
        if kind == "header":
            return f"<header data-content=0 class='{pick('header', 'site', 'masthead', 'banner')}'><div class='logo'>{words(1, 3)}</div>{links(3)}</header>" if rng.random() < 0.7 else f"<div data-content=0 id='header'><p>{words(1, 8)}</p></div>"
        if kind == "footer":
            return f"<footer data-content=0>{words(3, 25)}{links(2) if rng.random() < 0.5 else ''}</footer>" if rng.random() < 0.7 else f"<div data-content=0 class='footer {pick('copyright', 'bottom', 'legal')}'><p>{words(3, 20)}</p></div>"
        if kind == "side":
            name = pick("sidebar", "side", "related", "recommended", "widget", "popular", "trending", "promo")
            return f"<{(t := pick('aside', 'div', 'section'))} data-content=0 class='{name}'><h3>{words(1, 4)}</h3>{links(4)}<p>{words(3, 30)}</p></{t}>" if rng.random() < 0.8 else f"<aside data-content=0><h3>{words(1, 4)}</h3><p>{words(3, 40)}</p></aside>"
        if kind == "notice":
            return f"<div data-content=0 class='{pick('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'popup', 'modal', 'alert', 'newsletter', 'subscribe', 'paywall')}'><p>{words(4, 40)}.</p></div>"
        if kind == "ad":
            return f"<div data-content=0 class='{pick('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'banner', 'promo', 'adsense')}'>{words(2, 30)}.</div>"
        if kind == "form":
            return f"<form data-content=0><label>{words(1, 4)}</label><p>{words(1, 12)}</p><input></form>"
        if kind == "share":
            return f"<div data-content=0 class='{pick('share', 'social', 'tags', 'pagination', 'pager', 'meta')}'>{links(3)}</div>"
        one = lambda: f"<{(t := pick('div', 'div', 'li', 'li', 'article'))} class='comment'><div class='author'>{words(1, 3)}</div><p>{words(3, 60)}.</p></{t}>"
        return f"<{(t := pick('section', 'div', 'ol'))} data-content=0 {pick('class', 'id')}='{pick('comments', 'comment', 'discussion', 'replies', 'respond')}'><h3>{words(1, 4)}</h3>{''.join(one() for _ in range(rng.randrange(1, 6)))}</{t}>"

    out = []
    for _ in range(count):
        longest = pick(8, 30, 90)
        body = [block(longest) for _ in range(rng.randrange(1, 25))]
        for kind in ("ad", "side", "share", "comment", "form", "notice"):
            if rng.random() < 0.2:
                body.insert(rng.randrange(0, len(body) + 1), noise(kind))
        head = f"<h1>{words(2, 12)}</h1>" if rng.random() < 0.8 else ""
        if rng.random() < 0.3:
            head = f"<header>{head}<p>{words(3, 20)}</p></header>"
        shape = rng.random()
        name = pick("content", "post", "article", "entry", "story", "main", "text", "body")
        if shape < 0.55:
            main = f"<article data-content=1>{head}{''.join(body)}</article>"
        elif shape < 0.67:
            main = f"<main data-content=1>{head}{''.join(body)}</main>"
        elif shape < 0.79:
            main = f"<main><div data-content=1 class='{name}'>{head}{''.join(body)}</div></main>"
        else:
            main = f"<div data-content=1 {pick('class', 'id')}='{name}'>{head}{''.join(body)}</div>"
        before = "".join(noise(k) for k in ("header", "nav", "notice", "ad") if rng.random() < 0.6)
        after = "".join(noise(k) for k in ("side", "comment", "share", "ad", "form", "footer") if rng.random() < 0.5)
        wrap = rng.random()
        whole = f"<div class='{pick('wrapper', 'container', 'page')}'>{before}{main}{after}</div>" if wrap < 0.4 else before + main + after
        out.append(f"<html><body>{whole}</body></html>")
    # Pages without a frame (a few blocks straight below the body, boxes without a name) and tables that lay a page out.
    for _ in range(count):
        blocks = "".join(re.sub(r"^<\w+", r"\g<0> data-content=1", block(pick(3, 8, 30))) for _ in range(rng.randrange(1, 5)))
        head = f"<h1 data-content=1>{words(1, 8)}</h1>" if rng.random() < 0.4 else ""
        shape = rng.random()
        if shape < 0.4:
            whole = head + blocks
        elif shape < 0.6:
            whole = f"<div data-content=1>{head}{blocks}</div>"
        elif shape < 0.85:
            whole = head + "".join(f"<div data-content=1>{words(1, 30)}.</div>" for _ in range(rng.randrange(1, 4)))
        else:
            menu = "<br>".join(f"<a href='/{word()}'>{words(1, 3)}</a>" for _ in range(rng.randrange(2, 8)))
            whole = f"<table><tr><td data-content=0>{menu}</td><td data-content=1>{head}{blocks}</td></tr></table>"
        out.append(f"<html><body>{whole}</body></html>" if rng.random() < 0.5 else whole)
    return out


@lru_cache(maxsize=1)
def trained() -> Potentials:
    return fit(labelled_pages())


def main_text(pages: DataFrame, model: Potentials | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, text) of every page."""
    own = model or trained()
    keep = tuple(c for c in keep if c not in (id_col, "text"))  # the result's own columns come first
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [extract(x.as_py(), own) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [id_col, *keep, "text"])

    return pages.select(id_col, *keep, F.col(html_col).alias("html")).mapInArrow(run, f"{kept}, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), keep=("url",)).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
