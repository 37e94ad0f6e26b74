"""Main-text extraction by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags). A logistic classifier gives
each block the cost of calling it content and of calling it boilerplate; these are the
capacities of its edges to the two terminals. Neighbouring blocks, and blocks that follow each
other under one parent, are joined by smoothness edges that weaken with their distance in the
tree. The minimum cut, found by maximum flow, is the cheapest labelling of the whole page.

The classifier is trained here, on pages that this module makes up: layouts with known labels,
drawn from a seeded generator (``TRAINING_PAGES`` of them, the only bound in the module).
"""

from __future__ import annotations

import html as html_entities
import math
import random
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that break lines, that have no end tag, whose contents are no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg iframe object canvas audio video title textarea noframes annotation annotation-xml".split())
RAW_TAGS = frozenset("script style title textarea".split())  # of these, what runs to the end of the page unless an end tag comes
#: An element of the key is closed by the start of one of these.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"html", "body", "head", "button", "option", "optgroup", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"} | {"li", "dd", "dt", "td", "th", "tr"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"},
}
#: Words in class, id and role that speak against or for content.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent"
    " gdpr notice alert notification popup modal overlay newsletter subscribe subscription signup login register share sharing social"
    " related recommended recommendations trending popular nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar aside"
    " widget widgets footer foot header masthead topbar toolbar copyright legal disclaimer privacy pagination pager search form"
    " comment comments commentlist discussion disqus reply replies respond feedback reactions skip hidden hide contentinfo complementary".split()
)
FOR = frozenset("article content post entry story body text main prose maintext articlebody".split())
#: Parts that a compound name against content may have beside words of ``AGAINST`` (``site-footer``, ``comment-list``).
FILLER = frozenset(
    "site page reader readers user users list lists box boxes bar bars button buttons btn link links post posts article articles story stories item items"
    " section block area slot unit inner outer holder container wrap wrapper panel module global primary secondary main the our my blog author social".split()
)
#: Parts of a compound name that make it say something of state or layout, and nothing of what is inside.
STATE = frozenset(
    "has have with without no not non is are in on off at open opened close closed show shown visible active enabled disabled loaded ready"
    " fixed sticky left right top bottom wide full width height collapsed expanded single page layout col cols column columns grid row container wrap wrapper".split()
)

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
END_TAG = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in SILENT_TAGS}
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SITE_NAME = re.compile(r"""(?<![\w-])(?:class|id)\s*=[^>]*(?:logo|brand|site)""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STOP = re.compile(r"[.!?…。！？][\"'”’)\]]*(?:\s|$)")

TRAINING_PAGES = 240
ADJACENT, SAME_PARENT = 1.2, 1.5  # smoothness at distance 0; over (1 + distance)
SCALE = 10_000  # capacities are whole numbers
FEATURES = (
    "bias", "length", "sentences", "links", "paragraph", "heading", "item", "cell", "article", "main", "chosen", "nav", "header", "footer",
    "aside", "form", "against", "for", "hidden", "short", "control",
)
RESULT = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_content bigint"


class Node:
    __slots__ = ("tag", "parent", "depth", "flags", "against", "good", "hidden", "block", "wraps", "form", "headline", "named_site", "inside", "names")

    def __init__(self, tag, parent, attrs):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.flags, self.hidden, self.block = (parent.flags, parent.hidden, parent.block) if parent else (frozenset(), False, self)
        self.against, self.good, self.wraps, self.headline = frozenset(), 0, False, False
        self.form = self if tag == "form" else parent.form if parent else None  # one that holds the page is told apart later
        if tag in BLOCK_TAGS:
            self.block = self
        if tag in ("article", "main", "nav", "header", "footer", "aside", "button", "select", "menu", "dialog", "figure"):
            self.flags = self.flags | {tag}
        self.inside = parent.inside if parent else None  # the nearest article or main around this one
        if parent and parent.tag in ("article", "main"):
            self.inside = parent
        self.names = None
        self.named_site = bool(attrs) and SITE_NAME.search(attrs) is not None
        if attrs:
            if tag not in ("html", "body"):
                self.against, self.good = spoken(attrs)
            self.hidden = self.hidden or bool(HIDDEN.search(attrs))


class Block:
    __slots__ = ("node", "parts", "linked", "text")

    def __init__(self, node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


def spoken(attrs: str) -> tuple[frozenset, int]:
    """(words against content, number of words for it) in the class, id and role of an element.

    A name counts whole. A compound name speaks against content if that is all it says
    (``cookie-notice``, ``siteFooter``, but not ``share-price``), and never if a part makes it a
    state or a layout (``has-sidebar``, ``modal-open``).
    """
    against, good = set(), set()
    for m in NAMES.findall(attrs):
        for name in (m[0] or m[1] or m[2]).split():
            parts = [w.lower() for w in NAME_PART.findall(name)]
            if len(parts) > 1 and not STATE.isdisjoint(parts):
                continue
            if all(w in AGAINST or w in FILLER for w in parts):
                against.update(AGAINST.intersection(parts))
            good.update(FOR.intersection(parts))
    return frozenset(against), len(good)


def tokens_of(page: str):
    """(text, tag, closing, attributes) in turn; the text comes before the tag, the last tag is empty.

    One pass: no part of the page is looked at more than a fixed number of times. A quote opens a
    value only behind an equals sign; one that is never closed is a plain character.
    """
    at, begin, size = 0, 0, len(page)
    unclosed = {}  # from here on, these never come again

    def find(what, start):
        if unclosed.get(what, size + 1) <= start:
            return -1
        place = page.find(what, start)
        if place < 0:
            unclosed[what] = min(start, unclosed.get(what, size + 1))
        return place

    while (at := find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = find("-->", at + 2)
            yield page[begin:at], "", False, ""
            at = begin = end + 3 if end >= 0 else size
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = find(">", at)
            yield page[begin:at], "", False, ""
            at = begin = end + 1 if end >= 0 else size
            continue
        m = TAG.match(page, at)
        if not m:
            at += 1
            continue
        pos = m.end()
        while True:
            end, equals = find(">", pos), find("=", pos)
            if end < 0 or equals < 0 or equals > end:
                break
            pos = equals + 1
            while pos < size and page[pos].isspace():
                pos += 1
            if page[pos : pos + 1] in ('"', "'"):
                shut = find(page[pos], pos + 1)
                pos = shut + 1 if shut >= 0 else pos + 1
        if end < 0:
            at = m.end()  # never closed: text
            continue
        closing, tag, attrs = bool(m[1]), m[2].lower(), page[m.end() : end]
        yield page[begin:at], tag, closing, attrs
        at = begin = end + 1
        if tag in SILENT_TAGS and not closing and not (attrs.endswith("/") and tag not in RAW_TAGS):
            over = None if tag in unclosed else END_TAG[tag].search(page, at)
            if over:
                at = begin = over.end()
            elif tag in RAW_TAGS:
                at = begin = size
            else:
                unclosed[tag] = at  # what follows is page
    yield page[begin:], "", False, ""


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, comments, scripts and the like leave nothing."""
    root = Node("html", None, "")
    stack, out, current, links = [root], [], None, 0
    places: dict[str, list[int]] = {"html": [0]}  # where in the stack each tag stands
    walls = [0]  # where block elements stand
    articles, titles = [], []

    def end():
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
            current = None

    def cut(i):
        for n in stack[i:]:
            places[n.tag].pop()
        del stack[i:]
        while walls[-1] >= i:
            walls.pop()

    for raw, tag, closing, attrs in tokens_of(page):
        if raw and (current is not None or not raw.isspace()):
            if current is None:
                current = Block(stack[-1].block)
            text = html_entities.unescape(raw) if "&" in raw else raw
            current.parts.append(text)
            if links:
                current.linked += len(text)
        if not tag:
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in SILENT_TAGS:
            continue
        if tag in BLOCK_TAGS:
            end()
            links = 0
        if closing:
            if tag == "a":
                links = 0
            at = places[tag][-1] if places.get(tag) else 0
            if at and (tag in BLOCK_TAGS or at > walls[-1]):  # a stray inline end tag doesn't close blocks
                cut(at)
            continue
        if tag == "a":
            links = 1
        if tag in VOID_TAGS or attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS and tag in CLOSED_BY.get(stack[walls[-1]].tag, ()):
            cut(walls[-1])
        node = Node(tag, stack[-1], attrs)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            walls.append(len(stack))
        stack.append(node)
        if tag in ("article", "main"):
            articles.append(node)
        elif tag == "h1":
            titles.append(node)
    end()
    _free_wrappers(out, articles + titles)
    _choose(out, articles, titles)
    return out


def _free_wrappers(blocks: list[Block], landmarks: list[Node]) -> None:
    """A form around more than half of the text, or around nearly all, is a page's wrapper and no form."""
    held, total = {}, 0
    for b in blocks:
        total += len(b.text)
        if b.node.form is not None:
            held[b.node.form] = held.get(b.node.form, 0) + len(b.text)
    known = {n.form for n in landmarks}
    wrappers = {f for f, n in held.items() if n > 0.5 * total and f in known or n > 0.9 * total}
    if wrappers:
        for node in {b.node for b in blocks} | set(landmarks):
            if node.form in wrappers:
                node.form = None


def _choose(blocks: list[Block], articles: list[Node], titles: list[Node]) -> None:
    """Marks what wraps the main article: names of these elements tell of the page, and not of what is inside.

    The main article is the article, or else main, element with the most sentences; without
    either, the element around the first h1. What its own h1 stands in wraps it, too.
    """
    said: dict = {}
    for b in blocks:
        n = len(b.text) if STOP.search(b.text) else 0
        node = b.node if b.node.tag in ("article", "main") else b.node.inside
        while n and node is not None:
            said[id(node)] = said.get(id(node), 0) + n
            node = node.inside
    best = None
    for kind in ("article", "main"):
        known = [a for a in articles if a.tag == kind and not a.hidden and not a.against - {"form", "search"}] or [a for a in articles if a.tag == kind and not a.hidden]
        known = [a for a in known if not a.flags & {"aside", "nav", "footer"}] or known
        if known and best is None:
            best = max(known, key=lambda a: said.get(id(a), 0))
    if best is not None:
        own = [t for t in titles if _within(t, best)]
        if not own and len(titles) == 1 and _is_headline(titles[0]):
            titles[0].headline = True  # the article's only title, set above it
        titles = own
    plain = [t for t in titles if not t.flags & {"header", "nav", "aside", "footer"} and t.form is None and not t.hidden] or titles
    for node in (best, plain[0].parent if plain else None):
        while node is not None:
            node.wraps = True
            node = node.parent


def _is_headline(title: Node) -> bool:
    """Whether a title in a page's header may be that of the article: nothing calls it the site's."""
    own = title
    while own is not None and own.tag not in ("header", "body", "html"):
        if own.hidden or own.against or own.flags & {"nav", "aside", "footer"} or own.named_site:
            return False
        own = own.parent
    return True


def _within(node: Node, outer: Node) -> bool:
    while node.depth > outer.depth:
        node = node.parent
    return node is outer


def names_around(node: Node) -> tuple[frozenset, int, bool]:
    """Words against and for content in the names of an element and those around it, below what wraps the main
    article; and whether it is inside that. Each element is looked at once."""
    path = []
    while node is not None and node.names is None and not node.wraps:
        path.append(node)
        node = node.parent
    if node is None:
        known = frozenset(), 0, False
    else:
        known = node.names or (frozenset(), 0, node.tag not in ("html", "body"))
    for node in reversed(path):
        known = known[0] | node.against if node.against else known[0], known[1] + node.good, known[2]
        node.names = known
    return known


def features(b: Block) -> list[float]:
    n, node, text = len(b.text), b.node, b.text
    f = node.flags
    inside = "article" in f or node.headline
    against, good, chosen = names_around(node)
    return [
        1.0,
        min(math.log1p(n) / 5, 1.6),
        min(len(STOP.findall(text)), 3) / 3,
        min(b.linked / n, 1.0),
        float(node.tag in ("p", "blockquote", "pre")),
        float(node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(node.tag in ("li", "dt", "dd")),
        float(node.tag in ("td", "th", "caption")),
        float(inside),
        float("main" in f),
        float(chosen),
        float("nav" in f or "menu" in f),
        float("header" in f and not inside),
        float("footer" in f),
        float("aside" in f),
        float(node.form is not None or "dialog" in f),
        float(min(len(against), 2)),
        float(min(good, 2)),
        float(node.hidden),
        float(n < 30),
        float("button" in f or "select" in f or node.tag in ("label", "legend", "option", "fieldset")),
    ]


def _made_up_page(rng: random.Random) -> str:
    """A page whose content words all start with q and whose other words never do."""
    syllables = "ba be di do fa ke li mo nu po ra se ti vu za lo".split()

    def words(n, mark):
        return " ".join((mark + rng.choice(syllables) + rng.choice(syllables)) for _ in range(n))

    def sentences(k, mark):
        return " ".join(words(rng.randint(3, 18), mark).capitalize() + rng.choice(".,.!?.")[0].replace(",", ".") for _ in range(k))

    def links(k, tag="li"):
        return "".join(f"<{tag}><a href='/x'>{words(rng.randint(1, 3), 'x')}</a></{tag}>" for _ in range(k))

    def wrap(tag, names, inner):
        style = rng.random()
        if style < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        return f"<{'div' if style < 0.8 else tag} class='{rng.choice(names)}'>{inner}</{'div' if style < 0.8 else tag}>"

    def content():
        parts = [f"<h1>{words(rng.randint(2, 9), 'q')}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                parts.append(f"<p>{sentences(rng.randint(1, 6), 'q')}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.78:
                parts.append(f"<h2>{words(rng.randint(1, 6), 'q')}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{sentences(1, 'q')}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{sentences(2, 'q')}</blockquote>")
            elif kind < 0.92:
                parts.append("<table><tr>" + "".join(f"<td>{words(2, 'q')}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.93:
                parts.append(f"<p>{words(2, 'q')}.</p>")
            elif kind < 0.955:
                parts.append(f"<div class='{rng.choice(['ad', 'advert', 'promo', 'related', 'share'])}'>{sentences(rng.randint(1, 2), 'x')}</div>")
            elif kind < 0.965:
                parts.append(f"<div {rng.choice(['hidden', 'style=display:none'])}>{sentences(1, 'x')}</div>")
            else:
                tag = rng.choice(["aside", "aside", "nav", "form", "footer"])
                parts.append(f"<{tag}><p>{sentences(rng.randint(1, 3), 'x')}</p></{tag}>")
        return "".join(parts)

    def around(names, tag, k):
        kind = rng.random()
        body = f"<ul>{links(k)}</ul>" if kind < 0.5 else f"<p>{sentences(rng.randint(1, 4), 'x')}</p>" if kind < 0.8 else f"{sentences(rng.randint(1, 3), 'x')}"
        return wrap(tag, names, body)

    article = content()
    comments = "".join(rng.choice([f"<p>{sentences(rng.randint(1, 3), 'x')}</p>", f"<div>{sentences(1, 'x')}</div>"]) for _ in range(rng.randint(1, 4)))
    box = f"<{rng.choice(['div', 'section'])} class='{rng.choice(['comments', 'comment-list', 'reader-comments', 'replies'])}'><h3>{words(1, 'x')}</h3>{comments}</div>"
    inside = rng.random() < 0.25
    article += box if inside else ""
    shape = rng.random()
    named = f" class='{rng.choice(['post print', 'entry', 'story comment-open', 'post related', 'hentry notice', 'content'])}'" if rng.random() < 0.3 else ""
    if shape < 0.45:
        article = f"<article{named}>{article}</article>"
    elif shape < 0.6:
        article = f"<main{named}>{article}</main>"
    else:
        article = f"<div class='{rng.choice(['content', 'post', 'entry-content', 'wrap', 'col', 'story', 'c1'])}'>{article}</div>"
    before = [around(["nav", "menu", "navbar", "topbar"], "nav", rng.randint(2, 7))] if rng.random() < 0.9 else []
    if rng.random() < 0.6:
        before.append(wrap("header", ["header", "masthead", "banner"], f"<p>{words(rng.randint(1, 5), 'x')}</p>"))
    if rng.random() < 0.7:
        before.append(f"<div class='{rng.choice(['ad', 'ads', 'cookie-notice', 'notice', 'alert', 'banner', 'consent', 'promo', 'advert'])}'>{rng.choice(['', '<p>'])}{sentences(rng.randint(1, 4), 'x')}</div>")
    after = [] if inside or rng.random() < 0.5 else [box]
    if rng.random() < 0.5:
        after.append(around(["sidebar", "widget", "related"], "aside", rng.randint(2, 6)))
    if rng.random() < 0.4:
        after.append(f"<form><label>{words(1, 'x')}</label><p>{sentences(1, 'x')}</p><button>{words(1, 'x')}</button></form>")
    after.append(wrap("footer", ["footer", "copyright", "legal"], f"<p>&copy; {words(2, 'x')} {sentences(rng.randint(0, 2), 'x')}</p>"))
    if rng.random() < 0.15:  # teasers are articles too
        after.append("<aside class='related'>" + "".join(f"<article><h2>{words(3, 'x')}</h2><p>{sentences(1, 'x')}</p></article>" for _ in range(rng.randint(1, 4))) + "</aside>")
    parts = [*before, article, *after]
    if rng.random() < 0.5:  # an everyday wrapper, around the article alone or around all
        names = "page has-sidebar|layout with-header|search page|main-wrap modal-open|site related|widget page|form-layout|promo|story"
        first = len(before) if rng.random() < 0.5 else 0
        last = len(before) + 1 if first else len(parts)
        parts[first:last] = [f"<div class='{rng.choice(names.split('|'))}'>", *parts[first:last], "</div>"]
    return f"<html><body>{''.join(parts)}</body></html>"


def train(pages: int = TRAINING_PAGES, seed: int = 7) -> list[float]:
    """Weights of the classifier, by gradient descent on the made-up pages; the same for a seed."""
    import numpy as np

    rng = random.Random(seed)
    blocks = [b for _ in range(pages) for b in blocks_of(_made_up_page(rng))]
    x = np.array([features(b) for b in blocks])
    y = np.array([float(any(w[:1].lower() == "q" for w in b.text.split())) for b in blocks])
    w = np.zeros(x.shape[1])
    for _ in range(600):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 1.0 * (x.T @ (p - y) / len(y) + 0.0005 * w)
    return w.tolist()


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, capacity): each block with the next one, and with the next under the same parent; weaker with distance in the tree."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, int(SCALE * ADJACENT / (1 + _distance(blocks[i - 1].node, b.node)))))
        j = last.get(id(b.node.parent))
        if j is not None:
            edges.append((j, i, int(SCALE * SAME_PARENT / (1 + _distance(blocks[j].node, b.node)))))
        last[id(b.node.parent)] = i
    return edges


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for each node on the source side of a minimum cut.

    ``source[i]`` and ``sink[i]`` are terminal capacities, ``edges`` undirected. Dinic's maximum
    flow; what a node could pass straight through is taken first, so most nodes keep one
    terminal edge. Of several minimum cuts the one with the smallest source side is taken.
    """
    n = len(source)
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def add(a, b, forth, back):
        adj[a].append(len(to))
        to.append(b)
        cap.append(forth)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        through = min(source[i], sink[i])
        if source[i] > through:
            add(s, i, source[i] - through, 0)
        elif sink[i] > through:
            add(i, t, sink[i] - through, 0)
    for a, b, c in edges:
        if c:
            add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in adj[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path, a = [], s
        while True:  # blocking flow, without recursion
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[a] < len(adj[a]):
                e = adj[a][place[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(adj[a]):
                path.append(e)
                a = to[e]
            elif a == s:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1


def main_text(page: str | None, weights: list[float]) -> tuple[str, int, int]:
    """(text, blocks, content blocks) of one page."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return "", 0, 0
    source, sink = [], []
    unseen = sum(len(b.text) for b in blocks if b.node.hidden)
    dark = 2 * unseen < sum(len(b.text) for b in blocks)  # else it is the page that is hidden until a script shows it
    for b in blocks:
        z = sum(w * x for w, x in zip(weights, features(b)))
        z = -12.0 if b.node.hidden and dark else max(-12.0, min(12.0, z))
        # a block on the source side is content: cutting it off costs what calling it boilerplate costs
        source.append(int(SCALE * math.log1p(math.exp(z))))
        sink.append(int(SCALE * math.log1p(math.exp(-z))))
    content = minimum_cut(source, sink, smoothness(blocks))
    kept = [b.text for b, c in zip(blocks, content) if c]
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content for each row of ``pages``.

    White space in a block is one space, blocks are joined by one line feed. A null, empty or
    textless page has the empty text. Repeated rows stay, null ids and urls pass through, other
    columns are ignored, an empty table gives an empty result. One pass, no shuffle.
    """
    known = weights or train()

    def label(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [main_text(p, known) for p in part.column(2).to_pylist()]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string())] + [pa.array(x, pa.int64()) for x in ([len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found])],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
                )

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(label, RESULT)
