"""Layout-aware HTML to text.

A small tree builder (void elements, raw-text elements, implied end tags) and a renderer
that keeps what a browser would show: block spacing, list markers, aligned table cells,
cells over several columns or rows, tables within cells as blocks of their own.
Hidden content is left out: script, style, template, noscript, head, the ``hidden``
attribute, ``display:none``, comments, a closed ``details`` but for its summary, a closed ``dialog``.
``visibility`` is inherited: a visible child of a hidden parent shows. Of an SVG its text
elements show; of inputs the labels of buttons.

A null page renders as an empty text and a null title; an empty one likewise. Every row is
rendered on its own, so ties and repeated rows need no rule; very long or deeply nested
pages are walked without recursion, in time that grows with their length only (the open
elements are looked up by name). Unclosed tags are closed at the end; after a tag that never
ends, quotes no longer hide a ``>``. A table has 10,000 columns at most: further cells of its rows
span one column each.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes annotation annotation-xml".split())
#: Blocks with an empty line around them, and plain blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr".split())
BLOCK = SPACED | frozenset(("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form "
                            "header legend li main menu nav search section summary title tr caption thead tbody tfoot option").split())
#: A start tag closes these open elements, searched up to the given scope.
ROW_SCOPE = frozenset({"table"})
IMPLIED = {"li": ({"li"}, frozenset({"ul", "ol", "menu"})), "dt": ({"dt", "dd"}, frozenset({"dl"})),
           "dd": ({"dt", "dd"}, frozenset({"dl"})), "tr": ({"tr", "td", "th", "caption"}, ROW_SCOPE),
           "td": ({"td", "th"}, frozenset({"table", "tr"})), "th": ({"td", "th"}, frozenset({"table", "tr"})),
           "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, ROW_SCOPE),
           "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, ROW_SCOPE),
           "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, ROW_SCOPE),
           "option": ({"option"}, frozenset({"select"})), "body": ({"head"}, frozenset({"html"}))}
P_SCOPE = frozenset("table td th caption button li div section article body".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "option", "title", "legend"}
IN_HEAD = frozenset("title meta link base script style noscript template".split())

#: The next thing that could be a tag; a tag; a tag whose quotes are not looked at.
MARKUP = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements of foreign content, where a closing slash closes, and the places in it that hold HTML again.
FOREIGN = frozenset({"svg", "math"})
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
QUOTED_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
#: Parts of a style: comments, quoted strings and brackets hold no boundary of a declaration.
DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*\"?|'[^']*'?|\([^)]*\)?)+")
#: Values that count for the two properties that hide; a browser skips others.
DISPLAYS = frozenset(("none block inline flow flow-root flex grid table ruby contents list-item inline-block inline-flex inline-grid inline-table "
                      "table-row table-cell table-caption table-column table-row-group table-header-group table-footer-group table-column-group "
                      "run-in ruby-base ruby-text -webkit-box -webkit-inline-box -webkit-flex -ms-flexbox math inherit initial unset revert").split())
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset revert".split())
BLANKS = re.compile(r"[ \t\n\r\f]+")


MOST_COLUMNS = 10_000
#: The element of an SVG whose text shows.
SVG_TEXT = "text"
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}


class Node:
    __slots__ = ("attrs", "children", "foreign", "hidden", "name", "visible")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, hidden: bool = False, visible: bool | None = None, foreign: bool = False):
        self.name, self.attrs, self.hidden, self.visible, self.foreign, self.children = name, attrs or {}, hidden, visible, foreign, []


def whole_number(value: str | None, default: int) -> int:
    """The integer an attribute spells out, as far as it has at most nine digits."""
    m = re.match(r"\s*([+-]?[0-9]{1,9})(?![0-9])", value or "")
    return int(m[1]) if m else default


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _shown(style: str) -> tuple[bool, bool | None]:
    """(whether the declarations leave the element out, whether it is visible; None: as its parent).

    The last valid declaration of a property counts, or the last important one.
    """
    found: dict[str, tuple[bool, str]] = {}
    for part in DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|\Z)", " ", style, flags=re.S)):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip().lower(), value.lower().partition("!")
        known = {"display": DISPLAYS, "visibility": VISIBILITIES}.get(name)
        if known and value.split() and known.issuperset(value.split()) and (mark or not found.get(name, (False,))[0]):
            found[name] = bool(mark), value.strip()
    visibility = found.get("visibility", (0, "inherit"))[1]
    visible = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(visibility)
    return found.get("display", (0, ""))[1] == "none", visible


def _self_closed(raw: str) -> bool:
    """Whether a tag with these attributes ends in a slash that is no part of an unquoted value."""
    return raw.endswith("/") and not re.search(r"=\s*\S+\Z", QUOTED_VALUE.sub(" ", raw))


class Open:
    """The open elements, innermost last, with the places of every name."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close everything from place ``at`` on."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """Place of the innermost open element among ``names``; 0 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def close(self, names, scope) -> None:
        """Close through the outermost open element among ``names`` above the nearest ``scope`` that is none of them."""
        floor = self.last(scope - names)
        found = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, floor)) < len(p)]
        if found:
            self.cut(min(found))

    def end(self, name: str) -> None:
        """An end tag: close its element, unless that lies beyond the cell it stands in."""
        at = self.last((name,))
        wall = 0 if name in ("tr", "table", "tbody", "thead", "tfoot") else self.last(("td", "th", "table"))
        if at and at >= wall:
            self.cut(at)


def build_tree(page: str) -> Node:
    root = Node("#root")
    opened = Open(root)
    at, end, tag = 0, len(page), TAG
    last = page.rfind(">") + 1
    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            break
        here = m.start()
        comment = page.startswith("<!--", here)
        m = tag.match(page, here) if comment or here < last else None
        if not m and here < last and tag is TAG:
            tag = PLAIN_TAG  # an open quote: from here on a tag ends at the next >
            m = tag.match(page, here)
        if not m:
            break  # no tag ends after this
        if here > at:
            opened.stack[-1].children.append(html.unescape(page[at:here]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not opened.places.get("p"):
                opened.stack[-1].children.append(Node("p"))
            opened.end(name)
            continue
        if name in CLOSES_P:
            opened.close({"p"}, P_SCOPE)
        if name in IMPLIED:
            opened.close(*IMPLIED[name])
        elif opened.stack[-1].name == "head" and name not in IN_HEAD:
            opened.cut(len(opened.stack) - 1)  # content starts the body
        attrs = _attributes(m[3])
        left_out, visible = _shown(html.unescape(attrs.get("style", "")))
        hidden = (name in HIDDEN or "hidden" in attrs or left_out or name == "dialog" and "open" not in attrs
                  or name == "input" and attrs.get("type", "").lower() == "hidden")
        parent = opened.stack[-1]
        node = Node(name, attrs, hidden, visible, name in FOREIGN or parent.foreign and parent.name not in HTML_INSIDE)
        parent.children.append(node)
        if node.foreign and _self_closed(m[3]):
            continue
        if name == "img" and attrs.get("alt"):
            node.children.append(html.unescape(attrs["alt"]))
        elif name == "input" and attrs.get("type", "").lower() in BUTTONS:
            node.children.append(html.unescape(attrs.get("value", BUTTONS[attrs["type"].lower()])))
        elif name in RAW and not node.foreign:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at, max(at, last))
            tail = re.compile(rf"</{re.escape(name)}\s*\Z", re.I).search(page, max(at, end - len(name) - 8)) if not stop else None
            body = page[at:(stop or tail).start() if stop or tail else end]
            node.children.append(html.unescape(body) if name in ("title", "textarea") else body)
            at = stop.end() if stop else end
        elif name not in VOID:  # a slash on such an element means nothing outside foreign content
            opened.push(node)
    if at < end:
        opened.stack[-1].children.append(html.unescape(page[at:]))
    return root


class Flow:
    """Text being laid out: finished lines, the open line, and the empty lines owed before the next text."""

    def __init__(self, pre: bool = False):
        self.lines, self.line, self.gap, self.pre = [], "", 0, pre

    def text(self, s: str) -> None:
        if self.pre:
            first, *rest = s.split("\n")
            self._put(first)
            for x in rest:
                self.lines.append(self.line)
                self.line = x
            return
        s = BLANKS.sub(" ", s)
        if not self.line or self.line.endswith(" "):
            s = s.lstrip(" ")
        if s:
            self._put(s)

    def _put(self, s: str) -> None:
        if s and self.gap and self.lines and not self.line:
            self.lines += [""] * (self.gap - 1)
        if s:
            self.gap = 0
        self.line += s

    def end_line(self, gap: int = 1) -> None:
        if self.line:
            self.lines.append(self.line if self.pre else self.line.rstrip(" "))
            self.line, self.gap = "", 0
        self.gap = max(self.gap, gap)

    def newline(self) -> None:
        self.lines.append(self.line.rstrip(" "))
        self.line, self.gap = "", 0

    def add(self, lines: list[str], gap: int = 1) -> None:
        self.end_line(gap)
        if lines:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.lines += lines
            self.gap = 0

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
        return lines


#: A cell: its lines, and the columns and rows it spans.
Cell = tuple[list[str], int, int]


def _table(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table, its columns aligned; a cell of several lines makes its row as high."""
    taken: dict[int, int] = {}  # column -> rows below that a cell from above still covers
    placed: list[list[tuple[int, int, list[str]]]] = []  # per row: first column, columns, lines
    for row in rows:
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        at, cells = 0, []
        for lines, columns, high in row:
            while at in taken:
                at += 1
            columns = max(1, min(columns, 1000, MOST_COLUMNS - at))
            cells.append((at, columns, lines))
            if high > 1:
                below |= dict.fromkeys(range(at, at + columns), high - 1)
            at += columns
        placed.append(cells)
        taken = below
    widths = [0] * max((c + n for row in placed for c, n, _ in row), default=0)
    for spans in (False, True):
        for row in placed:
            for c, n, lines in row:
                if (n > 1) == spans:
                    room = sum(widths[c:c + n]) + 3 * (n - 1)
                    widths[c + n - 1] += max(0, max(map(len, lines), default=0) - room)
    out = []
    for row in placed:
        if not any(x for _, _, lines in row for x in lines):
            continue
        first = {c: (n, lines) for c, n, lines in row}
        last = max(c + n for c, n, _ in row)
        columns, c = [], 0
        while c < last:
            n, lines = first.get(c, (1, []))
            columns.append((sum(widths[c:c + n]) + 3 * (n - 1), lines))
            c += n
        high = max(len(lines) for _, lines in columns)
        for parts in zip_longest(*(lines + [""] * (high - len(lines)) for _, lines in columns), fillvalue=""):
            out.append(" | ".join(x.ljust(w) for x, (w, _) in zip(parts, columns)).rstrip())
    return out


def render(root: Node) -> tuple[str | None, str]:
    """(title, visible text)."""
    title: str | None = None
    flows: list[Flow] = [Flow()]
    lists: list[list] = []  # [ordered, next number]
    tables: list[list[list[Cell]]] = []
    blocks: list[bool] = []  # per open cell: whether it holds a table
    todo: list[tuple[object, bool, bool]] = [(root, False, True)]  # node, leaving, whether its text shows
    while todo:
        node, leaving, shows = todo.pop()
        if isinstance(node, str):
            if shows:
                flows[-1].text(node)
            continue
        name, flow = node.name, flows[-1]
        if not leaving:
            if name == "title" and not node.foreign and title is None:
                title = BLANKS.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip()
                continue
            if node.hidden and name != "head":
                continue
            if name == "head":
                todo += [(x, False, shows) for x in reversed(node.children) if isinstance(x, Node) and x.name == "title"]
                continue
            if name == "br":
                flow.newline()
                continue
            if node.foreign and name == "svg":
                todo += [(x, False, shows) for x in reversed(list(_svg_text(node)))]
                continue
            if node.visible is not None:
                shows = node.visible
            todo.append((node, True, shows))
            if name in ("ul", "ol", "menu"):
                flow.end_line(1 if lists else 2)
                lists.append([name == "ol", whole_number(node.attrs.get("start"), 1)])
            elif name == "table":
                flow.end_line(2)
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                flows.append(Flow())
                blocks.append(False)
            elif name == "li":
                flows.append(Flow())
            elif name == "pre":
                flow.end_line(2)
                flows.append(Flow(pre=True))
            elif name in BLOCK:
                flow.end_line(2 if name in SPACED else 1)
            children = node.children
            if name == "details" and "open" not in node.attrs:
                children = [x for x in children if isinstance(x, Node) and x.name == "summary"][:1]
            todo += [(x, False, shows) for x in reversed(children)
                     if not (isinstance(x, str) and name in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol") and not x.strip())]
        elif name in ("ul", "ol", "menu"):
            lists.pop()
            flow.end_line(1 if lists else 2)
        elif name == "table":
            flow.add(_table(tables.pop()), 2)
            flow.gap = 2
            if blocks:
                blocks[-1] = True
        elif name in ("td", "th") and tables:
            flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            lines = [x for x in flow.done() if x.strip()]
            if not blocks.pop():
                lines = [" ".join(map(str.strip, lines))]
            tables[-1][-1].append((lines, whole_number(node.attrs.get("colspan"), 1), min(65_534, whole_number(node.attrs.get("rowspan"), 1))))
        elif name == "li":
            flows.pop()
            ordered, number = lists[-1] if lists else (False, 1)
            number = whole_number(node.attrs.get("value"), number)
            if lists:
                lists[-1][1] = number + 1
            mark = f"{number}. " if ordered else "- "
            lines = flow.done()
            flows[-1].add([(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(lines)])
            flows[-1].end_line()
        elif name == "pre":
            flows.pop()
            flows[-1].add(flow.done(), 2)
            flows[-1].gap = 2
        elif name in BLOCK:
            flow.end_line(2 if name in SPACED else 1)
    return title, "\n".join(flows[0].done())


def _svg_text(svg: Node) -> Iterator[Node]:
    """The outermost text elements of an SVG that are not left out, in order, with the visibility they inherit."""
    todo = [(svg, svg.visible)]
    while todo:
        node, visible = todo.pop()
        for x in reversed(node.children) if node.name != SVG_TEXT else ():
            if isinstance(x, Node) and not x.hidden and x.name not in ("defs", "title", "desc", "symbol", "metadata", "foreignobject"):
                todo.append((x, visible if x.visible is None else x.visible))
        if node.name == SVG_TEXT:
            node.visible = visible
            yield node


def html_to_text(page: str | None) -> tuple[str | None, str]:
    return render(build_tree(page)) if page else (None, "")


def extract_pages(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: key, title, text. Narrow: every task renders the pages of its own split."""
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, title string, text string"

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [html_to_text(x) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
                names=[key, "title", "text"])

    return pages.select(key, html_col).mapInArrow(rendered, schema)
