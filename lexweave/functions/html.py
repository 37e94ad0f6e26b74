"""Article prose from HTML: chrome stripped, container chosen, blocks joined by line feeds.

Spark has no lenient HTML parser, so this is the one place (next to Unicode folding) where text
goes through an Arrow function. The tree is built with the standard library's parser.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql.pandas.functions import pandas_udf

from lexweave.functions.text import clean_space

#: Fixed values of the extraction rule.
CHROME = frozenset("script style noscript nav header footer aside form button iframe svg figure".split())
BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote dt dd td".split())
DENSE = frozenset("div section body".split())
RETAIN = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu"
    " nav ol p pre section table ul".split()
)
ENDED_BY = {
    "p": ENDS_P | {"li", "dt", "dd", "td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"},
}
HEAD = frozenset("head title meta link base style script".split())
KEEPS_IN = DENSE | CHROME | {"ul", "ol", "dl", "table", "article", "main", "blockquote"}  # what starts inside ends nothing around them


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "depth")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0

    def walk(self):
        """Elements below this one in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Element):
                yield x
                todo.extend(reversed(x.children))

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Element):
                todo.extend(reversed(x.children))
            elif x.strip():
                yield x.strip()

    def text(self) -> str:
        return " ".join(self.strings())


_REFERENCE = re.compile(r"&(?=[#a-zA-Z])(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|(?:amp|lt|gt|quot|nbsp);)([a-zA-Z][a-zA-Z0-9]*;)?")


def _hide_open(page: str) -> tuple[str, str]:
    """(page, mark): the ampersands that begin no reference ended by a semicolon as a mark, which no reference gives."""
    mark = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in page), "\ufdd0")
    return _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else mark + (m[1] or ""), page), mark


class _Builder(HTMLParser):
    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.mark = mark
        self.root = Element("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = self.at
        while node is not self.root:
            if tag in ENDED_BY.get(node.tag, ()):
                self.at = node.parent
                break
            if node.tag in KEEPS_IN:
                break
            node = node.parent
        new = Element(tag, self._shown(attrs), self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, self._shown(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def _shown(self, attrs) -> dict:
        return {k: v.replace(self.mark, "&") if v and self.mark else v for k, v in attrs}

    def handle_data(self, data):
        if self.mark:
            data = data.replace(self.mark, "&")
        if self.at is not self.root or data.strip():
            self.at.children.append(data)


def parse(page: str, closed: bool = False) -> Element:
    """The tree of a page. ``closed``: only references that end in a semicolon are any; else ``&amp`` is one, as browsers have it."""
    page, mark = _hide_open(page) if closed else (page, "")
    builder = _Builder(mark)
    builder.feed(page)
    builder.close()
    _give_body(builder.root)
    return builder.root


def _give_body(root: Element) -> None:
    """A page that names no body has one all the same: what follows the elements of a head."""
    if any(x.tag == "body" for x in root.walk()):
        return
    top = next((c for c in root.children if isinstance(c, Element) and c.tag == "html"), root)
    is_head = lambda c: c.tag in HEAD if isinstance(c, Element) else not c.strip()
    at = next((i for i, c in enumerate(top.children) if not is_head(c)), None)
    if at is None:
        return
    body = Element("body", {}, top)
    body.children, top.children[at:] = top.children[at:], [body]
    for c in body.children:
        if isinstance(c, Element):
            c.parent = body
    for x in body.walk():
        x.depth += 1


def _drop_chrome(root: Element) -> None:
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if not (isinstance(c, Element) and c.tag in CHROME)]
        todo.extend(c for c in x.children if isinstance(c, Element))


_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\]
    |:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""",
    re.VERBOSE,
)
_JOINS = re.compile(r"\s*([>+~])\s*|\s+")
_VALUE_TESTS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}


class SelectorError(ValueError):
    """A selector can't be read or uses a part that isn't known."""


def _siblings(node: Element) -> list[Element]:
    return [c for c in node.parent.children if isinstance(c, Element)] if node.parent else [node]


def _nth(arg: str) -> tuple[int, int]:
    """(step, first) of an ``an+b`` expression, ``odd`` or ``even``."""
    arg = arg.replace(" ", "").lower()
    if arg in ("odd", "even"):
        return 2, int(arg == "odd")
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise SelectorError(f"no position: {arg!r}")
    step = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return step, int(m[2] or 0)


def _pseudo(name: str, arg: str | None):
    """A test of an element for ``:name(arg)``."""
    if name == "not":
        inner = _alternatives(arg or "")
        return lambda x: not any(_reaches(x, path) for path in inner)
    if name == "empty":
        return lambda x: not any(isinstance(c, Element) or c for c in x.children)
    last, typed = "last" in name, name.endswith("-of-type")
    if name.removesuffix("-of-type").removesuffix("-child") in ("nth", "nth-last"):
        step, first = _nth(arg or "")
    elif name in ("first-child", "last-child", "first-of-type", "last-of-type"):
        step, first = 0, 1
    elif name in ("only-child", "only-of-type"):
        return lambda x: sum(not typed or c.tag == x.tag for c in _siblings(x)) == 1
    else:
        raise SelectorError(f"unknown pseudo-class :{name}")

    def counted(x):
        row = [c for c in _siblings(x) if not typed or c.tag == x.tag]
        at = next(i for i, c in enumerate(reversed(row) if last else row, 1) if c is x)
        return at == first if step == 0 else (at - first) % step == 0 and (at - first) // step >= 0

    return counted


def _part(m: re.Match):
    if m["tag"]:
        return lambda x: m["tag"] in ("*", x.tag) or m["tag"].lower() == x.tag
    if m["id"]:
        return lambda x: x.attrs.get("id") == m["id"]
    if m["cls"]:
        return lambda x: m["cls"] in (x.attrs.get("class") or "").split()
    if m["attr"]:
        name, op = m["attr"].lower(), m["op"]
        if not op:
            return lambda x: name in x.attrs
        want = m["val"][1:-1] if m["val"][0] in "\"'" else m["val"]
        return lambda x: name in x.attrs and _VALUE_TESTS[op](x.attrs[name] or "", want)
    return _pseudo(m["pseudo"].lower(), m["arg"])


def _alternatives(selector: str) -> list[list]:
    """For each comma part its compounds from right to left: (how it joins the next one leftwards, tests)."""
    out, path, tests, at = [], [], [], 0
    selector = selector.strip()
    while at < len(selector):
        if m := _SIMPLE.match(selector, at):
            if m["tag"] and tests:
                raise SelectorError(f"a name inside a compound: {selector!r}")
            tests.append(_part(m))
        elif m := re.compile(r"\s*,\s*").match(selector, at):
            if not tests:
                raise SelectorError(f"an empty alternative: {selector!r}")
            out.append([("", tests), *path])
            path, tests = [], []
        elif (m := _JOINS.match(selector, at)) and tests:
            path.insert(0, (m[1] or " ", tests))
            tests = []
        else:
            raise SelectorError(f"can't read {selector!r} at {selector[at:]!r}")
        at = m.end()
    if not tests:
        raise SelectorError(f"an empty alternative: {selector!r}")
    return [*out, [("", tests), *path]]


def _left_of(node: Element, join: str):
    """Elements that a combinator allows to the left of ``node``."""
    if join in " >":
        up = node.parent
        while up is not None and up.parent is not None:
            yield up
            if join == ">":
                return
            up = up.parent
        return
    row = _siblings(node)
    before = row[: next(i for i, c in enumerate(row) if c is node)]
    yield from before[-1:] if join == "+" else reversed(before)


def _reaches(node: Element, path: list) -> bool:
    (_, tests), rest = path[0], path[1:]
    if not all(t(node) for t in tests):
        return False
    return not rest or any(_reaches(x, rest) for x in _left_of(node, rest[0][0]))


def select(root: Element, selector: str) -> Element | None:
    """First element in document order that a CSS selector fits.

    Names, #ids, .classes, attributes, the four combinators, commas, ``:not()``, ``:empty`` and the
    pseudo-classes of position are known; anything else raises :class:`SelectorError`.
    """
    paths = _alternatives(selector)
    return next((x for x in root.walk() if any(_reaches(x, p) for p in paths)), None)


def _first(root: Element, tag: str) -> Element | None:
    return next((x for x in root.walk() if x.tag == tag), None)


def _densest(root: Element) -> Element | None:
    """The deepest div, section or body that keeps most of the best one's paragraph text."""
    length: dict[int, int] = {}
    for p in root.walk():
        if p.tag == "p":
            n, up = len(p.text()), p.parent
            while up is not None:
                length[id(up)] = length.get(id(up), 0) + n
                up = up.parent
    found = [(x, length.get(id(x), 0)) for x in root.walk() if x.tag in DENSE]
    found = [f for f in found if f[1] > 0]
    if not found:
        return None
    cut = max(n for _, n in found) * RETAIN
    return max((f for f in found if f[1] >= cut), key=lambda f: (f[0].depth, f[1]))[0]


def _block_text(container: Element) -> str:
    lines, todo = [], list(reversed(container.children))
    while todo:
        x = todo.pop()
        if not isinstance(x, Element):
            continue
        line = clean_space(x.text()) if x.tag in BLOCKS else ""
        if line:
            lines.append(line)
        else:
            todo.extend(reversed(x.children))
    return "\n".join(lines) or clean_space(container.text())


def extract(page: str, selector: str = "", closed: bool = False) -> tuple[str, str, str | None]:
    """(title, text, error) of a page; error is null where there is text. ``closed`` as in :func:`parse`."""
    root = parse(page, closed)
    if not any(True for _ in root.walk()) and not root.text():
        return "", "", "no document body in page"
    _drop_chrome(root)
    container = (select(root, selector) if selector else None) or _first(root, "article") or _first(root, "main") or _densest(root) or _first(root, "body") or root
    text = _block_text(container)
    head = _first(container, "h1") or _first(root, "h1") or _first(root, "title")
    title = clean_space(head.text()) if head else ""
    return (title, text, None) if text else (title, "", "page has no extractable prose")


def page_text(page: Column, selector: str = "", closed: bool = False) -> Column:
    """struct<title, text, error> of an HTML column; null pages count as empty. ``closed`` as in :func:`parse`.

    A selector that can't be read raises :class:`SelectorError` here, before any page is.
    """
    if selector:
        _alternatives(selector)

    @pandas_udf("title string, text string, error string")
    def each(pages):
        import pandas as pd

        return pd.DataFrame([extract(p or "", selector, closed) for p in pages], columns=["title", "text", "error"])

    return each(page)
