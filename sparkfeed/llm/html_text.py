"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a renderer that
keeps block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
from collections import deque
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, slices, strings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
#: Elements that show nothing; those of drawings and formulas that only define or annotate among them.
UNSEEN = frozenset(
    "head script style template noscript title iframe noembed noframes object canvas audio video datalist area map rp dialog "
    "defs symbol metadata desc clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split()
)
#: Elements of other languages, in which a tag may end itself.
FOREIGN = ("svg", "math")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table text ul caption xmp".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir pre figure table xmp".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag of the key implies the end of the nearest open element among the first set, unless an
#: element of the second lies between.
_SCOPE = frozenset("table td th caption button html body".split())
IMPLIES_END = {
    "li": (frozenset(["li"]), LISTS | _SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset(["head"]), frozenset()),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "select": (frozenset(["select"]), _SCOPE),
}
_CLOSES_P = BLOCK - {"html", "body", "caption", "legend", "summary"}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What an end tag may not close beyond.
_END_SCOPE = {"li": LISTS | _SCOPE, "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}

_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)")
_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: Widest cell that others of its column are aligned to.
WIDEST = 40
#: Deepest indent of a line, and place in it up to which cells are aligned, so that a page's text
#: stays in proportion to the page.
INDENT, ALIGNED = 80, 400


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Open:
    """The open elements, and for each tag the places of those that have it."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def _last(self, tags: frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Ends the innermost element of ``tags`` and all in it, unless one of ``stop`` is further in."""
        at = self._last(tags)
        if at and at >= self._last(stop):
            while len(self.nodes) > at:
                self.pop()


class _Tags:
    """Markup of a page, from its start on; looking at all of it takes time in proportion to its length.

    A start tag ends at the first ``>`` outside quotes. One whose quotes or tag don't end before the
    page does is taken to end at its first ``>``, as are those after it up to the quote that has no
    partner; so the page is read to its end for that no more than once a kind of quote.
    """

    def __init__(self, html: str):
        self.html, self.last, self.plain_to = html, html.rfind(">"), 0

    def at(self, place: int) -> tuple[str, str, str, int] | None:
        """``(kind, name, attributes, end)`` of the markup at a ``<``, or None if it is text."""
        html = self.html
        kind = html[place + 1 : place + 2]
        if kind in ("!", "?"):
            return "", "", "", _COMMENT.match(html, place).end()
        if kind == "/":
            m = _END_TAG.match(html, place)
            return ("/", m[1], "", m.end()) if m else None
        if place > self.last or not (m := _NAME.match(html, place)):
            return None
        start = m.end()
        if start >= self.plain_to:
            end = _QUOTED.match(html, start).end()
            if html[end : end + 1] == ">":
                return "<", m[1], html[start:end], end + 1
            self.plain_to = end
        end = html.find(">", start)
        return ("<", m[1], html[start:end], end + 1) if end >= 0 else None


def parse(html: str) -> Node:
    """The tree of a page; every input gives one, as browsers do."""
    root = Node("html", {})
    open_, tags = _Open(root), _Tags(html)
    at, n = 0, len(html)

    def text(s: str) -> None:
        if s:
            open_.top.kids.append(unescape(s) if "&" in s else s)

    while at < n:
        place, found = at, None
        while (place := html.find("<", place)) >= 0 and (found := tags.at(place)) is None:
            place += 1
        if found is None:
            text(html[at:])
            break
        text(html[at:place])
        kind, tag, attributes, at = found
        if not kind:
            continue  # a comment or declaration
        tag = tag.lower()
        if kind == "/":
            if tag == "br":
                open_.top.kids.append(Node("br", {}))
            elif tag in _HEADINGS:
                open_.close(_HEADINGS, _SCOPE)
            elif tag not in ("html", "body"):
                open_.close(frozenset([tag]), _END_SCOPE.get(tag, _SCOPE - {tag}) if tag not in ("table", "tbody", "thead", "tfoot") else frozenset())
            continue
        attrs: dict[str, str] = {}
        if attributes and not attributes.isspace():
            for a in _ATTRIBUTE.finditer(attributes):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag in IMPLIES_END:
            open_.close(*IMPLIES_END[tag])
        elif tag not in UNSEEN and tag not in VOID and open_.top.tag == "head":
            open_.pop()  # visible content ends the head
        if tag in _CLOSES_P:
            open_.close(frozenset(["p"]), _SCOPE)
        if tag in ("td", "th") and open_.top.tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            open_.top.kids.append(row)
            open_.push(row)
        node = Node(tag, attrs)
        open_.top.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : end.start()] if end else html[at:]
            at = end.end() if end else n
            if tag in ("textarea", "title"):
                body = unescape(body)
            if body:
                node.kids.append(body)
        elif tag not in VOID and not (attributes.endswith("/") and any(open_.places.get(t) for t in FOREIGN)):
            open_.push(node)
    return root


def _styles(node: Node) -> dict[str, str]:
    """What a node's own style says of being shown; the last word counts."""
    style = node.attrs.get("style") if node.attrs else None
    return {m[1].lower(): m[2].lower() for m in _STYLE.finditer(style)} if style else {}


def visible(node: Node, styles: dict[str, str]) -> bool:
    """Whether a node has a place on the page; ``visibility``, which a child may have anew, is another matter."""
    attrs = node.attrs
    if node.tag in UNSEEN and not (node.tag == "dialog" and "open" in attrs):
        return False
    if not attrs:
        return True
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found":
        return False
    return styles.get("display") != "none"


def _choose(select: Node) -> None:
    """Leaves of a closed list its chosen option, or the first; an open one shows all, each in a line."""
    size = select.attrs.get("size", "")
    opened = "multiple" in select.attrs or (size.isdigit() and size[:4].lstrip("0") not in ("", "1"))
    options, steps = [], [select]
    while steps:
        node = steps.pop()
        for kid in node.kids:
            if isinstance(kid, Node):
                steps.append(kid)
        if node.tag == "option":
            options.append(node)
            if node.attrs.get("label"):
                node.kids = [node.attrs["label"]]
    options.reverse()  # children were taken from the last on
    chosen = [o for o in options if "selected" in o.attrs][-1:] or [o for o in options if "disabled" not in o.attrs][:1] or options[:1]
    for o in options:
        if opened:
            o.tag = "li\0"
        elif o is not chosen[0]:
            o.kids = []


class _Block:
    """Lines under each other: items ``(margin, text, block or cursor)``, how many lines, and how wide."""

    __slots__ = ("count", "items", "width")

    def __init__(self, items: list[tuple[int, object]]):
        self.items = items
        self.count = sum(1 if isinstance(x, str) else x.count for _, x in items)
        self.width = max((m + (len(x) if isinstance(x, str) else x.width) for m, x in items), default=0)


class _Cursor:
    """What is left of a block, whose lines are taken from the front, each once.

    It is a stack of ``[items, place, margin within the one below]``. A cursor within a cursor is not
    gone through: the shorter stack goes onto, or below, the longer one. So a line that lies in many
    tables, each in a cell of the next, is touched where it is laid out and where it is printed.
    """

    __slots__ = ("count", "frames", "margin", "width")

    def __init__(self, block: _Block):
        self.frames, self.margin, self.count, self.width = deque([[block.items, 0, 0]]), 0, block.count, block.width

    def pull(self) -> tuple[int, str] | None:
        while self.frames:
            top = self.frames[-1]
            if top[1] >= len(top[0]):
                self.margin -= self.frames.pop()[2]
                continue
            margin, x = top[0][top[1]]
            top[1] += 1
            if isinstance(x, str):
                self.count -= 1
                return self.margin + margin, x
            if isinstance(x, _Block):
                self.frames.append([x.items, 0, margin])
                self.margin += margin
            elif x.frames:
                x.frames[0][2] += margin
                if len(x.frames) < len(self.frames):
                    self.frames.extend(x.frames)
                else:
                    x.frames.extendleft(reversed(self.frames))
                    self.frames = x.frames
                self.margin += margin + x.margin
        return None


def _line(margin: int, text: str) -> str:
    return " " * min(margin, ALIGNED) + text if text else ""


class _Lines:
    """Text as it flows: runs of space are one, blocks begin lines, margins of blocks collapse."""

    def __init__(self):
        self.lines: list[tuple[int, object]] = []  # items of a block
        self.line: list[str] = []
        self.space = False  # a space is due before the next word
        self.gap = 0  # empty lines due before the next line
        self.indent = 0
        self.mark: str | None = None  # a list item's mark, for its first line

    def words(self, s: str) -> None:
        if s[:1] in " \t\n\r\f":
            self.space = True
        flat = _SPACES.sub(" ", s).strip(" ")
        if flat:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(flat)
            self.space = s[-1] in " \t\n\r\f"

    def end_line(self, always: bool = False) -> None:
        text, self.line, self.space = "".join(self.line), [], False
        if not text and self.mark is None:
            if always and self.lines:
                self.lines.append((0, ""))
            return
        pad = self._begin()
        self.lines.append((0, pad + text if text else pad.rstrip()))

    def _begin(self) -> str:
        """Empty lines that are due; then what stands before the next line's text."""
        if self.gap and self.lines:
            self.lines.extend([(0, "")] * self.gap)
        self.gap = 0
        indent = min(self.indent, INDENT)
        if self.mark is None:
            return " " * indent
        pad, self.mark = " " * max(0, indent - len(self.mark)) + self.mark, None
        return pad

    def table(self, block: _Block) -> None:
        """Lines that are laid out already; a list item's mark stands before the first of them."""
        if not block.count:
            return
        rest, marked = _Cursor(block), self.mark is not None
        pad = self._begin()
        if marked:
            self.lines.append((0, pad + _line(*rest.pull())))
        self.lines.append((min(self.indent, INDENT), rest))

    def block(self, spaced: bool) -> None:
        if self.line:
            self.end_line()
        if spaced and self.mark is None:
            self.gap = 1

    def verbatim(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, part in enumerate(parts):
            if part:
                self.line.append(part)
            if k < len(parts) - 1:
                if not self.line and self.mark is None:
                    self.gap += bool(self.lines)
                else:
                    self.end_line()

    def done(self) -> _Block:
        """All lines, without empty ones at either end."""
        self.mark = None
        self.end_line()
        first, last = 0, len(self.lines)
        while first < last and self.lines[first][1] == "":
            first += 1
        while last > first and self.lines[last - 1][1] == "":
            last -= 1
        return _Block(self.lines[first:last])

    def text(self) -> str:
        rest, out = _Cursor(self.done()), []
        while (line := rest.pull()) is not None:
            out.append(_line(*line))
        return "\n".join(out).strip("\n")


class _Cell:
    __slots__ = ("block", "down", "span")

    def __init__(self, block: _Block, span: int, down: int):
        self.block, self.span, self.down = block, span, down


def _columns(rows: list[list[_Cell]]) -> list[list[tuple[int, _Cell]]]:
    """The first column of each cell, beside those that reach down from rows above."""
    busy: dict[int, tuple[int, int]] = {}  # first column -> column behind, last row
    out = []
    for r, row in enumerate(rows):
        at, cells = 0, []
        for cell in row:
            start, until = at, len(rows)
            while (taken := busy.get(at)) and taken[1] >= r:
                at, until = taken[0], min(until, taken[1])
            if at > start and busy[start][0] < at:
                busy[start] = (at, until)  # a longer step, for as long as all of it holds
            cells.append((at, cell))
            if cell.down > 1:
                busy[at] = (at + cell.span, r + cell.down - 1)
            at += cell.span
        out.append(cells)
    return out


def _laid_out(rows: list[list[_Cell]]) -> _Block:
    """Rows of cells as lines, columns aligned; cells of several lines go below each other.

    A column is a place where some cell starts; cells are aligned up to the place ``ALIGNED`` of a
    line. Where only one cell of a row still has lines, these are not touched but get a margin.
    """
    placed = _columns(rows)
    widths: dict[int, int] = {}
    for cells in placed:
        for at, cell in cells:
            widths[at] = max(widths.get(at, 0), min(WIDEST, cell.block.width) if cell.span == 1 else 0)
    starts = dict(zip(sorted(widths), accumulate((widths[c] + 2 for c in sorted(widths)), initial=0)))
    items: list[tuple[int, object]] = []
    for cells in placed:
        open_ = [(min(starts[at], ALIGNED), cell.block, _Cursor(cell.block)) for at, cell in cells if cell.block.count]
        while len(open_) > 1:
            line, length = [], 0
            for start, _, rest in open_:
                text = _line(*rest.pull())
                if text:
                    pad = max(2 if line else 0, start - length)
                    line.append(" " * pad + text)
                    length += pad + len(text)
            if line:
                items.append((0, "".join(line).rstrip()))
            open_ = [x for x in open_ if x[2].count]
        for start, block, rest in open_:
            own = rest.frames[0]
            if own[0] is block.items:  # tables in a cell have no empty lines, only the cell itself
                left = [x for x in own[0][own[1] :] if x[1] != ""]
                rest.count -= len(own[0]) - own[1] - len(left)
                rest.frames[0] = [left, 0, own[2]]
            if rest.count:
                items.append((start, rest))
    return _Block(items)


def _whole(value: str, most: int) -> int:
    return min(int(value[:9]), most) if value.isdigit() else 1


class _Table:
    def __init__(self):
        self.rows: list[list[_Cell]] = []


def render(root: Node) -> str:
    """All visible text of a tree, walked without recursion."""
    out, held = _Lines(), []  # held: the outputs around the cell at hand, and its tables
    tables: list[_Table] = []
    lists: list[list] = []  # [tag, next number, indent outside]
    pre, dim = 0, False  # dim: text has a place but is not shown
    steps: list[tuple[object, bool]] = [(root, False)]
    while steps:
        node, leaving = steps.pop()
        if isinstance(node, str):
            if not dim:
                out.verbatim(node) if pre else out.words(node)
            continue
        if isinstance(node, bool):
            dim = node
            continue
        tag = node.tag
        if not leaving:
            if tag == "br":
                out.end_line(always=True)
                continue
            styles = _styles(node)
            if not visible(node, styles):
                continue
            if "visibility" in styles and (now := styles["visibility"] in ("hidden", "collapse")) != dim:
                steps.append((dim, False))
                dim = now
            if tag in VOID:
                if tag == "hr":
                    out.block(True)
                continue
            if tag in ("td", "th") and tables:
                held.append((out, lists, pre))
                out, lists, pre = _Lines(), [], 0
            elif tag == "tr" and tables:
                out.block(False)
                tables[-1].rows.append([])
            elif tag == "table":
                out.block(True)
                tables.append(_Table())
            elif tag == "li":
                out.block(False)
                if not lists:
                    lists.append(["ul", 1, out.indent])
                    node.attrs["\0alone"] = ""
                mark = "" if dim else "- "
                if lists[-1][0] == "ol" and not dim:
                    value = node.attrs.get("value", "")
                    lists[-1][1] = int(value) if value.isdigit() and len(value) < 10 else lists[-1][1]
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                if out.mark is not None:
                    out.end_line()
                out.indent, out.mark = lists[-1][2] + len(mark), mark or None
            elif tag in LISTS:
                out.block(not lists)
                start = node.attrs.get("start", "")
                lists.append([tag, int(start) if start.isdigit() and len(start) < 10 else 1, out.indent])
            elif tag in BLOCK:
                out.block(tag in SPACED)
                if tag in ("dd", "blockquote"):
                    out.indent += 4
            elif tag == "select":
                _choose(node)
            elif tag == "optgroup" and node.kids and any(isinstance(k, Node) and k.tag == "li\0" for k in node.kids) and not dim:
                out.block(False)
                out.words(node.attrs.get("label", ""))
            elif tag == "li\0":
                out.block(False)
            if tag in ("pre", "xmp"):
                pre += 1
            steps.append((node, True))
            steps.extend((kid, False) for kid in reversed(node.kids))
            continue
        if tag in ("pre", "xmp"):
            pre -= 1
        if tag in ("td", "th") and tables:
            block = out.done()
            out, lists, pre = held.pop()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            down = node.attrs.get("rowspan", "")
            tables[-1].rows[-1].append(_Cell(block, _whole(node.attrs.get("colspan", ""), 1000) or 1, (_whole(down, 65534) or 65534) if down else 1))
        elif tag == "table" and tables:
            out.table(_laid_out(tables.pop().rows))
            out.block(True)
        elif tag == "li\0":
            out.block(False)
        elif tag == "select":
            if any(isinstance(k, Node) for k in node.kids):
                out.space = True
        elif tag == "li":
            out.block(False)
            if out.mark is not None:
                out.end_line()
            out.indent = lists[-1][2] if lists else 0
            if "\0alone" in node.attrs:
                lists.pop()
        elif tag in LISTS:
            out.block(len(lists) < 2)
            if lists:
                out.indent = lists.pop()[2]
        elif tag in BLOCK:
            out.block(tag in SPACED)
            if tag in ("dd", "blockquote"):
                out.indent = max(0, out.indent - 4)
    return out.text()


def page_text(html: str) -> str:
    return render(parse(html))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)``: the visible text of each page.

    Null and empty pages give an empty text; null or repeated ids give a row each; other columns are
    ignored, so their names can't clash; an empty table gives no rows. Any input gives a text: unclosed
    tags, comments and quotes end with the page. Elements that define, annotate or stand in for others
    show nothing, nor does what style or attributes hide, but for children made visible again. A page
    takes time and memory in proportion to its length, however deep its elements are. No shuffle.
    """
    schema = T.StructType([T.StructField("id", field_type(pages, id_col)), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x) for x in strings(batch.column(1))], pa.string())], names=["id", "text"])

    return bounded(pages.select(col(id_col).alias("id"), col(html_col).alias("html"))).mapInArrow(run, schema).select(F.col("id").alias(id_col), "text")
