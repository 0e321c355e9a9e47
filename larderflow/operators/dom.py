"""A small tolerant HTML tree, and the texts that extractors read from it."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody",)}
#: An end tag or an implied end doesn't reach beyond these.
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}
_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr blockquote pre hr".split())
_P_SCOPE = frozenset(("td", "th", "li", "button"))
_TABLE, _NO_SCOPE = frozenset(("table",)), frozenset()
#: Elements whose content isn't read like other content, by one version of the parser or another.
_RAW = frozenset("script style title textarea xmp iframe noscript noembed noframes plaintext template svg math".split())
_S = r"[ \t\n\r\f]"
#: A text, or a tag, comment or declaration of the usual form, which every reader takes for the same.
_PLAIN = re.compile(rf"""([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:{_S}+[a-zA-Z][a-zA-Z0-9_:.-]*(?:="[^"<>&]*")?)*){_S}*(/?)>|<!(?:--[^<>-]+--|[dD][oO][cC][tT][yY][pP][eE][^<>]*)>""")
_ATTR = re.compile(rf"""{_S}([a-zA-Z][a-zA-Z0-9_:.-]*)(?:="([^"]*)")?""")
_RAW_END = {"script": re.compile("</script", re.I), "style": re.compile("</style", re.I)}


class Unclear(Exception):
    """A page, or a part of it, that isn't of the usual form, so that the whole parser must read it."""


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def nodes(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                stack += reversed(n.children)
            else:
                yield n

    def text(self) -> str:
        """All texts inside, joined by a space, trimmed."""
        return " ".join(self.texts()).strip()

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.nodes() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.nodes() if test(n)), None)


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()  # tags from here to the root: a search for one that isn't there needn't begin

    def _end(self, tags: tuple[str, ...], scope: frozenset[str] = _NO_SCOPE) -> None:
        if not any(self.open[t] for t in tags):
            return
        n = self.at
        while n.parent is not None and n.tag not in tags:
            if n.tag in scope:
                return
            n = n.parent
        if n.parent is not None:
            at = self.at
            while at is not n.parent:
                self.open[at.tag] -= 1
                at = at.parent
            self.at = at

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._end(("p",), _P_SCOPE)
        if tag in _ENDS:
            self._end(_ENDS[tag], _SCOPE[tag])
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in _VOID:
            self._end((tag,), _TABLE if tag not in ("table", "body", "html") else _NO_SCOPE)

    def handle_data(self, data):
        c = self.at.children
        if c and isinstance(c[-1], str):
            c[-1] += data
        else:
            c.append(data)

    def parse_html_declaration(self, i):
        """Declarations and marked sections, known or not, end at the next '>' and hold nothing."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return -1 if end < 0 else end + 1


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the content ends that isn't read as usual: a script's or style's, or a title's without tags."""
    if tag in _RAW_END:
        m = _RAW_END[tag].search(page, at)
        end = m.start() if m and page.find("<!--", at, m.start()) < 0 else -1
    else:
        end = page.find("<", at) if tag == "title" else -1
    if end < 0 or not page.startswith(f"</{tag}>", end):
        raise Unclear
    return end


def _attrs(s: str) -> list[tuple[str, str]]:
    return [(k.lower(), v) for k, v in _ATTR.findall(s)]


def _plain_tree(page: str) -> Node:
    """The same tree as the parser's for a page of the usual form, at a fraction of its time."""
    b, match, at, n = _Builder(), _PLAIN.match, 0, len(page)
    start, end, data = b.handle_starttag, b.handle_endtag, b.handle_data
    while at < n:
        m = match(page, at)
        if m is None:
            raise Unclear
        text, close, tag, attrs, empty = m.groups()
        at = m.end()
        if text is not None:
            data(html.unescape(text) if "&" in text else text)
        elif tag is not None:
            tag = tag.lower()
            if close:
                if attrs or empty:
                    raise Unclear
                end(tag)
                continue
            if tag in _RAW:
                if empty:
                    raise Unclear
                stop = _raw_end(page, tag, at)
                start(tag, _attrs(attrs))
                if tag in _RAW_END and stop > at:
                    data(page[at:stop])
                    at = stop
            else:
                start(tag, _attrs(attrs) if attrs else None)
    return b.root


def scripts(page: str, kind: str) -> Iterator[str]:
    """Texts of the page's scripts of a type, in order, without a tree; raises Unclear where that isn't safe."""
    match, at, n = _PLAIN.match, 0, len(page)
    while at < n:
        m = match(page, at)
        if m is None:
            raise Unclear
        _, close, tag, attrs, empty = m.groups()
        at = m.end()
        if tag is None:
            continue
        if close:
            if attrs or empty:
                raise Unclear
        elif (tag := tag.lower()) in _RAW:
            if empty:
                raise Unclear
            stop = _raw_end(page, tag, at)
            if tag == "script" and dict(reversed(_attrs(attrs))).get("type") == kind:
                yield page[at:stop]
            at = stop


def _whole_tree(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def parse(page: str) -> Node:
    """The page's tree. Not done: moving misplaced table content, and re-opening inline elements that are closed out of order."""
    try:
        return _plain_tree(page)
    except Unclear:
        return _whole_tree(page)


def tag(*names: str) -> Callable[[Node], bool]:
    return lambda n: n.tag in names


def has_class(name: str) -> Callable[[Node], bool]:
    return lambda n: name in n.attrs.get("class", "").split()


def attr(name: str, value: str | None = None) -> Callable[[Node], bool]:
    return lambda n: name in n.attrs and (value is None or n.attrs[name] == value)


def body_text(root: Node) -> str:
    """Texts of the body joined by a space, scripts and styles too; '' without a body (a page without the tag is all body)."""
    b = root.first(tag("body"))
    if b is None:
        if root.first(tag("frameset")):
            return ""
        b = root
    return " ".join(b.texts())


def unescape_twice(s: str) -> str:
    """Entities decoded two times, as texts are often encoded twice."""
    return html.unescape(html.unescape(s)) if "&" in s else s


def _block_text(root: Node, out: list[str]) -> None:
    def line() -> None:
        if out and out[-1][-1:] != "\n":
            out.append("\n")

    stack: list = list(reversed(root.children))  # None: a block ends
    while stack:
        c = stack.pop()
        if c is None:
            line()
        elif isinstance(c, str):
            t = c.strip()
            if t:
                if out and out[-1][-1:] not in "\n " and t[0] not in ".,!?:;)":
                    out.append(" ")
                out.append(t)
        else:
            if c.tag in _BLOCK:
                line()
                stack.append(None)
            stack += reversed(c.children)


def strip_tags(s: str) -> str:
    """A fragment's text, with line ends at block elements, and lines trimmed and never empty; unchanged if it has no '<'."""
    if "<" not in s:
        return s
    out: list[str] = []
    _block_text(parse(s), out)
    return "\n".join(x for line in "".join(out).split("\n") if (x := line.strip()))


def decode(s: str) -> str:
    return strip_tags(unescape_twice(s))
