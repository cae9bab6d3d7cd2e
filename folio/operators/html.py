"""Text of XHTML files by table-of-contents anchors, as Markdown.

Each file is parsed once, whatever number of rows of the contents point into it. Parsing and tree walks are Python, since
no Spark expression can do them; everything around is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folio.session import ship

# Kinds of elements, and hints in the classes of headings.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(("nav", "script", "style"))
CONTAINERS = frozenset(("section", "article", "div", "main", "aside", "body"))
HEADINGS = frozenset(("h", "h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = frozenset("div p section article aside main header footer li td th blockquote figure".split())
#: An element of one of these ends an open paragraph.
CLOSES_P = frozenset("p div section article aside main header footer ul ol table blockquote figure h1 h2 h3 h4 h5 h6 hr pre".split())
HINTS = ("h", "chap", "chapter-title", "section-title")


class Node:
    """An element with its children, which are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.elements()

    def find(self, wanted) -> Node | None:
        return next((e for e in self.elements() if wanted(e)), None)

    def next_element(self) -> Node | None:
        """The next sibling that is an element."""
        if self.parent is None:
            return None
        own = self.parent.children
        at = next(i for i, c in enumerate(own) if c is self)
        return next((c for c in own[at + 1 :] if isinstance(c, Node)), None)

    def copy(self, drop=lambda e: False, parent: Node | None = None) -> Node:
        """A copy without the elements below for which ``drop`` holds."""
        out = Node(self.tag, self.attrs, parent)
        out.children = [c if isinstance(c, str) else c.copy(drop, out) for c in self.children if isinstance(c, str) or not drop(c)]
        return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and self.at.tag == "p":
            self.at = self.at.parent
        if tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a document; what is never closed ends with its parent."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.top


def _by_id(name: str):
    return lambda e: e.attrs.get("id") == name


def heading_like(e: Node) -> bool:
    """A paragraph whose classes contain one of the hints, the letter h being one of them."""
    return e.tag == "p" and any(x in e.attrs.get("class", "").lower() for x in HINTS)


def chapter_level(top: Node) -> list:
    """What stands in the body before its first direct section, or the body without sections; without navigation, scripts and styles."""
    body = top.find(lambda e: e.tag == "body")
    if body is None:
        return []
    at = next((i for i, c in enumerate(body.children) if isinstance(c, Node) and c.tag == "section"), None)
    if at is not None:
        return [c.strip() if isinstance(c, str) else c for c in body.children[:at] if (c.strip() if isinstance(c, str) else c.tag not in SKIPPED)]
    return body.copy(lambda e: e.tag in SKIPPED or e.tag == "section").children


def siblings(start: Node, stop: str | None) -> list:
    """An element and the elements behind it, up to the one that is the stop or has it inside, which is cut there."""
    out: list = []
    own = start.parent.children if start.parent is not None else [start]
    for cur in own[next(i for i, c in enumerate(own) if c is start) :]:
        if isinstance(cur, str):
            continue
        if stop:
            if cur.attrs.get("id") == stop:
                break
            if cur.find(_by_id(stop)) is not None:
                if cur.tag not in SKIPPED:
                    out.append(_trimmed(cur, stop))
                break
        if cur.tag not in SKIPPED:
            out.append(cur)
    return out


def _trimmed(e: Node, stop: str) -> Node:
    """A copy of an element that ends before the one with the id ``stop``."""
    out = e.copy()
    at = out.find(_by_id(stop))
    while at is not None and at is not out:
        own = at.parent.children
        k = next(i for i, c in enumerate(own) if c is at)
        # the stop itself goes, the elements around it stay
        del own[k + (at.attrs.get("id") != stop) :]
        at = at.parent
    return out


def resolve_heading(e: Node, body: Node | None) -> Node | None:
    """The heading an anchor belongs to: itself, its parent, the next element, or the block around it."""
    is_heading = lambda x: x is not None and (x.tag in HEADINGS or heading_like(x))
    for x in (e, e.parent, e.next_element()):
        if is_heading(x):
            return x
    cur = e.parent
    while cur is not None and cur is not body:
        if cur.tag in BLOCKS:
            return cur
        cur = cur.parent
    return None


def anchors(top: Node) -> dict[str, Node]:
    """The first element of each id, and the first link of each name that is no id."""
    ids: dict[str, Node] = {}
    names: dict[str, Node] = {}
    for e in top.elements():
        if "id" in e.attrs:
            ids.setdefault(e.attrs["id"], e)
        if e.tag == "a" and "name" in e.attrs:
            names.setdefault(e.attrs["name"], e)
    return {**names, **ids}


def extract(top: Node, anchor: str | None, stop: str | None, known: dict[str, Node] | None = None) -> list | None:
    """The nodes of the text at an anchor; None if there is no such anchor. ``known`` has the :func:`anchors`, if they are wanted more than once."""
    if not anchor:
        return chapter_level(top)
    target = (anchors(top) if known is None else known).get(anchor)
    if target is None:
        return None
    if target.tag == "body":
        return chapter_level(top)
    if target.tag in CONTAINERS:
        return [target.copy(lambda e: e.tag == "section")]
    return siblings(resolve_heading(target, top.find(lambda e: e.tag == "body")) or target, stop)


_SPACE = re.compile(r"[ \t\r\n\f]+")


def _inline(nodes: list) -> str:
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(_SPACE.sub(" ", n))
        elif n.tag == "br":
            out.append("  \n")
        elif n.tag in ("em", "i") and (x := _inline(n.children)).strip():
            out.append(f"_{x.strip()}_")
        elif n.tag in ("strong", "b") and (x := _inline(n.children)).strip():
            out.append(f"**{x.strip()}**")
        elif n.tag == "code" and (x := _inline(n.children)).strip():
            out.append(f"`{x.strip()}`")
        elif n.tag not in SKIPPED and n.tag not in ("img", "head"):
            out.append(_inline(n.children))
    return "".join(out)


def _blocks(nodes: list, out: list[str], lead: str = "") -> None:
    run: list = []

    def flush() -> None:
        text = re.sub(r" *\n *", "\n", _inline(run)).strip()
        run.clear()
        if text:
            out.append(lead + text)

    for n in nodes:
        if isinstance(n, str) or n.tag not in CLOSES_P | {"li", "tr", "td", "th", "dl", "dt", "dd", "body", "html", "head", "nav", "script", "style", "title", "tbody", "thead", "figcaption"}:
            run.append(n)
            continue
        flush()
        if n.tag in SKIPPED or n.tag in ("head", "title"):
            continue
        if n.tag[0] == "h" and n.tag[1:].isdigit():
            if x := _inline(n.children).strip():
                out.append("#" * int(n.tag[1:]) + " " + _SPACE.sub(" ", x))
        elif n.tag in ("ul", "ol"):
            items: list[str] = []
            for k, li in enumerate((c for c in n.children if isinstance(c, Node) and c.tag == "li"), 1):
                inner: list[str] = []
                _blocks(li.children, inner)
                if inner:
                    items.append(("  * " if n.tag == "ul" else f"  {k}. ") + "\n\n".join(inner))
            if items:
                out.append("\n".join(items))
        elif n.tag == "hr":
            out.append("* * *")
        elif n.tag == "blockquote":
            inner = []
            _blocks(n.children, inner)
            out += ["> " + x.replace("\n", "\n> ") for x in inner]
        elif n.tag == "pre":
            out.append("".join(e if isinstance(e, str) else _inline([e]) for e in n.children).strip("\n"))
        elif n.tag == "tr":
            out.append(" | ".join(_inline(c.children).strip() for c in n.children if isinstance(c, Node)))
        else:
            _blocks(n.children, out)
    flush()


def to_markdown(nodes: list) -> str:
    """Markdown of nodes: headings, emphasis, lists, quotations and rules; links as their text, images left out; cleaned."""
    out: list[str] = []
    _blocks(nodes, out)
    return clean_text("\n\n".join(out))


def clean_text(s: str) -> str:
    """The rules of :func:`folio.operators.text.clean`, for one string."""
    s = s.replace("\f", "\n")
    s = re.sub(r"-\s*\n\s*(\w)", r"\1", s)
    s = re.sub(r"[ \t]+", " ", s)
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def file_path(c: Column) -> Column:
    """A path without leading ``./``, ``../`` and slashes."""
    return F.regexp_replace(c, r"\A(?:\.{1,2}/)*/*", "")


def extract_texts(stops: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, id, markdown) of the rows of :func:`folio.operators.toc.stop_anchors` whose file and anchor exist and whose text isn't blank.

    ``files`` has (book_id, path, html). Rows of a file travel to it as one array, so a file is parsed once. Null html
    counts as empty.
    """
    ship(files.sparkSession)
    want = stops.groupBy("book_id", file_path(F.col("file")).alias("path")).agg(F.collect_list(F.struct("id", "anchor", "stop_anchor")).alias("rows"))
    j = files.select("book_id", file_path(F.col("path")).alias("path"), F.coalesce("html", F.lit("")).alias("html")).join(want, ["book_id", "path"]).select("book_id", "html", "rows")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for book, html, rows in zip(pdf["book_id"], pdf["html"], pdf["rows"]):
                top = parse(html)
                known = anchors(top)
                for r in rows:
                    nodes = extract(top, r["anchor"], r["stop_anchor"], known)
                    text = to_markdown(nodes) if nodes else ""
                    if text.strip():
                        out.append((book, r["id"], text))
            yield pd.DataFrame(out, columns=["book_id", "id", "markdown"])

    return j.mapInPandas(run, "book_id string, id string, markdown string")


def markdown(files: DataFrame) -> DataFrame:
    """(book_id, path, markdown) of whole files (book_id, path, html)."""

    ship(files.sparkSession)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"book_id": pdf["book_id"], "path": pdf["path"], "markdown": [to_markdown(chapter_level(parse(h or ""))) for h in pdf["html"]]})

    return files.select("book_id", "path", "html").mapInPandas(run, "book_id string, path string, markdown string")
