"""HTML trees, CSS selection and node values, as Python functions and as vectorised column functions.

The tree builder follows the common recovery rules: void elements, implied end tags, raw text in script and style, end tags
that close what they match and are ignored otherwise. Selectors: tag, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]``,
``[a^=v]``, ``[a$=v]``, ``[a*=v]``, ``:scope``, descendant, ``>`` and ``,``.

Character references: ``refs="html"`` reads all that HTML knows, also those that lack their semicolon; ``refs="escape"`` reads only the five
that ``html.escape`` writes, whole, so that text which was escaped and then cut keeps what is left of its last reference.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {
    "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
} | {t: {"p"} for t in "p div ul ol dl table section article nav aside header footer h1 h2 h3 h4 h5 h6 pre form blockquote main hr".split()}
WALL = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def _strings(self) -> Iterator[str]:
        stack: list[Node | str] = self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                if x.tag == "br" or x.tag in CLOSES:
                    yield " "
                stack += x.children[::-1]

    def text(self) -> str:
        return " ".join("".join(self._strings()).split())

    def own_text(self) -> str:
        return " ".join(self.own_data().split())

    def own_data(self) -> str:
        """Its own text with all white space as it stands."""
        return "".join(c for c in self.children if isinstance(c, str))

    def code(self) -> str:
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        inner = "".join(c.code() if isinstance(c, Node) else (c if self.tag in ("script", "style") else escape(c, quote=False)) for c in self.children)
        if not self.tag:  # the document itself
            return inner
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def formatted_code(self, level: int = 0) -> str:
        """A line for each element and text, indented by depth."""
        pad = "  " * level
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"{pad}<{self.tag}{attrs}>"
        inner = []
        for c in self.children:
            if isinstance(c, Node):
                inner.append(c.formatted_code(level + 1))
            elif c.strip():
                inner.append("  " * (level + 1) + escape(" ".join(c.split()), quote=False))
        return "\n".join([f"{pad}<{self.tag}{attrs}>", *inner, f"{pad}</{self.tag}>"])

    def attr(self, name: str, no_empty: bool = True) -> str | None:
        value = self.attrs.get(name.lower())
        return None if value is None or (no_empty and not value.replace("\xa0", " ").strip()) else value

    def release(self) -> None:
        """Takes the tree apart: its nodes know each other, so else it would stay in memory until a full collection of garbage."""
        stack = [self]
        while stack:
            node = stack.pop()
            stack += node.elements()
            node.parent, node.children = None, []

    def breadcrumb(self) -> list[str]:
        out, node = [], self
        while node is not None and node.tag:
            out.append(node.tag)
            node = node.parent
        return out[::-1]


#: An ampersand that begins none of the references of ``html.escape``.
_BARE = re.compile(r"&(?!(?:amp|lt|gt|quot|#x27);)")


class _Builder(HTMLParser):
    def __init__(self, mark: str = "") -> None:
        """mark: stands for the ampersands that are to stay."""
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.mark = mark

    def kept(self, text: str) -> str:
        return text.replace(self.mark, "&") if self.mark else text

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, wall = CLOSES.get(tag, ()), WALL.get(tag, {"table", "td", "th", "article", "div", "section"} if tag != "p" else ())
        node = self.at
        while node is not None and node.tag and node.tag not in wall:
            if node.tag in closes:
                self.at = node.parent
                if tag not in ("tr", "td", "th"):
                    break
            node = node.parent
        new = Node(self.kept(tag), {self.kept(k): self.kept(v or "") for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == self.kept(tag):
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node, tag = self.at, self.kept(tag)
        while node is not None and node.tag:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(self.kept(data))


def plain(text: str | None) -> Node:
    """A document of text alone: it has its text, and no selector finds anything in it."""
    root = Node("", {}, None)
    root.children.append(text or "")
    return root


def to_html(content: str | None, mime: str) -> str:
    """Text formats as pages: delimited text as a table, other text and JSON as it stands; formats of bytes need tools of their own."""
    text = content or ""
    if mime in ("text/html", "application/xhtml+xml"):
        return text
    if mime in ("text/csv", "text/tab-separated-values"):
        rows = csv.reader(io.StringIO(text), delimiter="," if mime == "text/csv" else "\t")
        body = "".join("<tr>" + "".join(f"<td>{escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows)
        return f"<html><body><table>{body}</table></body></html>"
    if mime.startswith("text/") or mime in ("application/json", "application/xml"):
        return f"<html><body><pre>{escape(text, quote=False)}</pre></body></html>"
    raise ValueError(f"no page can be made of {mime}")


def find_by(node: Node, how: str) -> list[Node]:
    """Matches by a prefixed rule: ``id:``, ``name:``, ``class:``, ``tag:``, ``link:``, ``partial_link:``, or a selector (``css:`` or none)."""
    kind, colon, what = how.partition(":")
    if not colon or kind not in ("id", "name", "class", "tag", "link", "partial_link", "css"):
        return find_all(node, how)
    tests: dict[str, Callable[[Node], bool]] = {
        "id": lambda n: n.attrs.get("id") == what,
        "name": lambda n: n.attrs.get("name") == what,
        "class": lambda n: what in n.attrs.get("class", "").split(),
        "tag": lambda n: n.tag == what.lower(),
        "link": lambda n: n.tag == "a" and n.text() == what,
        "partial_link": lambda n: n.tag == "a" and what in n.text(),
    }
    return find_all(node, what) if kind == "css" else [n for n in node.walk() if tests[kind](n)]


def parse(html: str | None, refs: str = "html") -> Node:
    html, mark = html or "", ""
    if re.match(r"\s*<t[rdh]\b", html, re.I):  # table fragments keep their cells
        html = f"<table>{html}</table>"
    if refs == "escape":
        mark = next(c for c in map(chr, range(0xFDD0, 0x10FFFF)) if c not in html)  # no characters, as a rule absent
        html = _BARE.sub(mark, html)
    b = _Builder(mark)
    b.feed(html)
    b.close()
    return b.root


_STEP = re.compile(r"(?P<scope>:scope)|(?P<tag>[\w*-]+)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[\^$*]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]")


@lru_cache(maxsize=512)
def compile_css(css: str) -> list[list[tuple[str, list[dict[str, str | None]]]]]:
    """Alternatives, each a list of (combinator, simple conditions)."""
    out = []
    for part in css.split(","):
        chain, comb = [], " "
        for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>])+", part.strip()):
            if token == ">":
                comb = ">"
                continue
            conds = [m.groupdict() for m in _STEP.finditer(token)]
            if "".join(m.group() for m in _STEP.finditer(token)) != token:
                raise ValueError(f"unsupported selector: {css}")
            chain.append((comb, conds))
            comb = " "
        if not chain:
            raise ValueError(f"empty selector: {css!r}")
        out.append(chain)
    return out


def _simple(node: Node, conds: list[dict[str, str | None]], scope: Node) -> bool:
    for c in conds:
        if c["scope"]:
            ok = node is scope
        elif c["tag"]:
            ok = c["tag"] == "*" or node.tag == c["tag"].lower()
        elif c["cls"]:
            ok = c["cls"] in node.attrs.get("class", "").split()
        elif c["id"]:
            ok = node.attrs.get("id") == c["id"]
        else:
            v = node.attrs.get(c["name"].lower())
            ok = v is not None and (
                c["op"] is None or {"=": v == c["val"], "^=": v.startswith(c["val"]), "$=": v.endswith(c["val"]), "*=": c["val"] in v}[c["op"]]
            )
        if not ok:
            return False
    return True


def _matches(node: Node, chain: list, i: int, scope: Node) -> bool:
    if not _simple(node, chain[i][1], scope):
        return False
    if i == 0:
        return True
    up = node.parent
    if chain[i][0] == ">":
        return up is not None and _matches(up, chain, i - 1, scope)
    while up is not None:
        if _matches(up, chain, i - 1, scope):
            return True
        up = up.parent
    return False


def find_all(node: Node, css: str) -> list[Node]:
    chains = compile_css(css)
    return [x for x in node.walk() if any(_matches(x, c, len(c) - 1, node) for c in chains)]


def find_only(node: Node, css: str) -> Node:
    got = find_all(node, css)
    if len(got) != 1:
        raise ValueError(f"expected one match of {css}, found {len(got)}")
    return got[0]


def children(node: Node, css: str) -> list[Node]:
    chains = compile_css(css)
    return [x for x in node.elements() if any(_matches(x, c, len(c) - 1, node) for c in chains)]


def with_siblings(found: list[Node], low: int, high: int) -> list[list[Node]]:
    """Each match with its neighbours in [low, high], never reaching past the next match on either side."""
    out, ids = [], {id(x) for x in found}
    for x in found:
        row = x.parent.elements()
        at = next(i for i, y in enumerate(row) if y is x)
        marks = [i for i, y in enumerate(row) if id(y) in ids]
        left = max([at + low, 0, *(m + 1 for m in marks if m < at)])
        right = min([at + high, len(row) - 1, *(m - 1 for m in marks if m > at)])
        out.append(row[left : right + 1])
    return out


def main_text(root: Node, least: int = 12) -> str:
    """Blocks of prose: enough words, and few of them in links."""
    out = []
    for n in root.walk():
        if n.tag in ("p", "td", "div", "article", "section", "pre", "blockquote") and not any(c.tag in CLOSES for c in n.elements()):
            words = len(n.text().split())
            linked = sum(len(a.text().split()) for a in find_all(n, "a"))
            if words >= least and linked < 0.33 * words:
                out.append(n.text())
    return "\n".join(out)


VALUES: dict[str, Callable[[Node, str], str | None]] = {
    "text": lambda n, url: n.text(),
    "own_text": lambda n, url: n.own_text(),
    "own_data": lambda n, url: n.own_data(),
    "code": lambda n, url: n.code(),
    "formatted_code": lambda n, url: n.formatted_code(),
    "tag": lambda n, url: n.tag,
    "breadcrumb": lambda n, url: "/".join(n.breadcrumb()),
    "href": lambda n, url: None if n.attr("href") is None else urljoin(url or "", n.attr("href")),
    "src": lambda n, url: None if n.attr("src") is None else urljoin(url or "", n.attr("src")),
    "main_text": lambda n, url: main_text(n),
}


def value_of(name: str) -> Callable[[Node, str], str | None]:
    return (lambda n, url: n.attr(name[1:])) if name.startswith("@") else VALUES[name]


#: Characters of pages whose values are Python objects at a time; then they are packed.
PIECE = 1 << 20


def _of_pages(kind: DataType, one: Callable[[Node, str], list], refs: str) -> Callable[..., Column]:
    """A column function of pages and their addresses. Of a batch, one tree and the values of one piece are held at a time, beside what is packed."""

    def packed(pages: pa.Array, urls: pa.Array) -> Iterator[pa.Array]:
        held, size, arrow = [], 0, to_arrow_type(kind)
        for page, url in zip(pages, urls):
            doc = page.as_py()
            root = parse(doc, refs)
            held.append(one(root, url.as_py()))
            root.release()
            size += len(doc or "")
            if size >= PIECE:
                yield pa.array(held, arrow)
                held, size = [], 0
        yield pa.array(held, arrow)

    @F.arrow_udf(kind)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.concat_arrays(list(packed(pages, urls)))

    return lambda html, url=None: run(html, url if url is not None else F.lit(""))


def select_all(html: Column, css: str, values: list[str], url: Column | None = None, within: str | None = None, refs: str = "html") -> Column:
    """ARRAY<STRUCT> of the values of all matches, in document order; a value is a key of VALUES or ``@attribute``.

    With ``within`` only direct children of its matches count.
    """
    compile_css(css)
    names = [v.lstrip("@") for v in values]
    kind = ArrayType(StructType([StructField(n, StringType()) for n in names]))
    fns = [value_of(v) for v in values]
    return _of_pages(kind, lambda root, link: [{n: f(x, link) for n, f in zip(names, fns)} for x in matches(root, css, within)], refs)(html, url)


def matches(root: Node, css: str, within: str | None = None) -> list[Node]:
    return find_all(root, css) if within is None else [x for node in find_all(root, within) for x in children(node, css)]


def select_values(html: Column, css: str, value: str = "text", url: Column | None = None, within: str | None = None, refs: str = "html") -> Column:
    """ARRAY<STRING> without missing values."""
    return F.array_compact(F.transform(select_all(html, css, [value], url, within, refs), lambda s: s[value.lstrip("@")]))


def select_first(html: Column, css: str, value: str = "text", url: Column | None = None, refs: str = "html") -> Column:
    return F.try_element_at(F.transform(select_all(html, css, [value], url, refs=refs), lambda s: s[value.lstrip("@")]), F.lit(1))


def select_only(html: Column, css: str, value: str = "text", url: Column | None = None) -> Column:
    """The only match; any other number of matches is an error."""
    got = F.transform(select_all(html, css, [value], url), lambda s: s[value.lstrip("@")])
    return F.when(F.size(got) == 1, F.element_at(got, 1)).otherwise(F.raise_error(F.lit(f"expected one match of {css}")))


def sibling_texts(html: Column, css: str, low: int, high: int, within: str | None = None, refs: str = "html") -> Column:
    """ARRAY<ARRAY<STRING>>: the texts of each match and its neighbours; with ``within``, of direct children of its matches."""
    compile_css(css)
    kind = ArrayType(ArrayType(StringType()))
    return _of_pages(kind, lambda root, _: [[n.text() for n in row] for row in with_siblings(matches(root, css, within), low, high)], refs)(html)


def all_attributes(html: Column, css: str) -> Column:
    """ARRAY<MAP<STRING,STRING>>."""
    return _of_pages(ArrayType(MapType(StringType(), StringType())), lambda root, _: [x.attrs for x in find_all(root, css)], "html")(html)
