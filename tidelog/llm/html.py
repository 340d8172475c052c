"""HTML to text as laid out: all visible text, with block spacing, lists and aligned table cells.

A tokenizer feeds a tree builder that supplies implied tags (paragraphs, list items, table sections, rows and cells that end where
the next begins; head and body; rows that were never opened). The tree is then walked once. What is never shown is left out: scripts,
styles, templates, heads, comments, `hidden` and `display:none` with all inside, closed details and dialogs. `visibility` is inherited: text
under `hidden` or `collapse` is left out, but shown again under `visible`. White space
collapses but for pre and textarea. Paragraph-like blocks stand apart by an empty line, other blocks by a line end. List items carry
a mark or number and nest by indentation. Table cells stand in columns, padded to the widest cell of the column.

No text is ever cut. Two parameters bound the blanks that layout adds: indentation deeper than max_indent columns is drawn at max_indent, and a table whose padding would
be more than max_fill characters is padded to columns of at most max_pad.

Neither builder nor walk recurses, so depth has no limit but memory, and texts of any length are taken whole. Defined results: null or empty input gives the
empty text; broken markup gives some tree, never an error; a tag that never ends takes the rest with it; numbers of lists beyond 32 bits count as not given; column spans are 1 to 1000, row
spans 0 (to the end of the section) to 65534, as HTML has it. Repeated rows get
equal texts; an empty table gives no rows; other columns stay, and a column named as the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.common import ship

#: Fixed sets of HTML: elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
UNSEEN = frozenset("area audio canvas col colgroup datalist desc embed head iframe link map meta metadata noembed noframes noscript object param picture rp script source style template title track video".split())
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing plaintext fieldset".split())
BLOCK = APART | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav noscript optgroup option search section summary tbody td textarea tfoot th thead tr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul xmp listing plaintext".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
SCOPE = frozenset("html table td th caption template button object marquee applet".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
#: Which open elements a start tag ends, and at which ones the search for them stops.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | SCOPE),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split()) | SCOPE),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split()) | SCOPE),
    "td": (CELLS | {"caption"}, frozenset("tr table template html".split())),
    "th": (CELLS | {"caption"}, frozenset("tr table template html".split())),
    "tr": (frozenset(["tr", "caption"]), SECTIONS | frozenset("table template html".split())),
    "tbody": (SECTIONS | frozenset(["tr", "caption"]), frozenset("table template html".split())),
    "caption": (SECTIONS | frozenset(["tr", "caption"]), frozenset("table template html".split())),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]

ATTRIBUTES = r"""(?:[^>"'=]++|=[ \t\n\f\r]*+"[^"]*+(?:"|\Z)|=[ \t\n\f\r]*+'[^']*+(?:'|\Z)|[="'])*+"""
TOKEN = re.compile(rf"[^<]+|<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(>|\Z)|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:[ \t\n\f\r]*=[ \t\n\f\r]*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>]*))?""")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
BLANKS = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "raw", "children")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw = tag, raw
        self.children: list[Node | str] = []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.raw):
            value = m[2] or ""
            if value[:1] in ("'", '"'):
                value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            out.setdefault(m[1].lower(), unescape(value))
        return out


def tree(html: str) -> Node:
    """The document's root."""
    root = Node("html")
    stack, at, end = [root], 0, len(html)

    def close(ends: frozenset, stops: frozenset) -> None:
        """Ends the nearest open element of `ends`, with all inside it, unless one of `stops` lies between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    def leave_head() -> None:
        if len(stack) > 1 and stack[1].tag == "head":
            del stack[1:]

    one_p, no_p_beyond = frozenset(["p"]), SCOPE
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                if text.startswith("<![CDATA["):
                    text = text[9:].removesuffix("]]>")
                    stack[-1].children.append(text)
                continue
            if stack[-1].tag == "head" and not text.isspace():
                leave_head()
            stack[-1].children.append(unescape(text) if "&" in text else text)
            continue
        if not m[4]:
            break
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag in ("body", "html"):
                leave_head()  # what follows still belongs to the body
            else:
                close_end(stack, tag)
            continue
        if tag not in IN_HEAD:
            leave_head()
        if tag in ("html", "body"):
            if tag == "body" and len(stack) == 1 and m[3]:
                stack.append(Node("body", m[3]))
                root.children.append(stack[-1])
            continue
        if tag == "head":
            if len(stack) == 1 and not root.children:
                stack.append(Node("head"))
                root.children.append(stack[-1])
            continue
        if tag in ENDS_P:
            close(one_p, no_p_beyond)
        if tag in ENDS:
            close(*ENDS[tag])
            if tag in CELLS and stack[-1].tag in SECTIONS | {"table"}:
                stack[-1].children.append(row := Node("tr"))
                stack.append(row)
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            del stack[-1]
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in ESCAPABLE_RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            text = html[at : found.start() if found else end]
            node.children.append(unescape(text) if tag in ESCAPABLE_RAW else text)
            at = html.find(">", found.end()) + 1 if found else end
            at = at or end
            continue
        if tag == "plaintext":
            node.children.append(html[at:])
            break
        stack.append(node)
    return root


def styled(style: str) -> dict[str, str]:
    """The display and visibility that a style attribute sets: of each the last, important ones before others."""
    out: dict[str, tuple[bool, str]] = {}
    for m in DECLARATION.finditer(CSS_COMMENT.sub("", style)):
        name, important = m[1].lower(), bool(m[3])
        if name not in out or important >= out[name][0]:
            out[name] = important, m[2].lower()
    return {k: v for k, (_, v) in out.items()}


def close_end(stack: list[Node], tag: str) -> None:
    """An end tag: ends the nearest open element of that name, if nothing that must stay open lies between."""
    block = tag in BLOCK or tag in SCOPE or tag in ("select", "datalist")
    for i in range(len(stack) - 1, 0, -1):
        own = stack[i].tag
        if own == tag:
            del stack[i:]
            return
        if own in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or own == "table" or not block and own in BLOCK and own != "p":
            return


class Page:
    """Lines as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] | None = None
        self.gap, self.blank = 0, False
        self.indent, self.mark = "", None

    def _open(self) -> None:
        if self.line is None:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap, self.blank = 0, False
            self.line = [self.indent if self.mark is None else self.mark]
            self.mark = None

    def text(self, s: str) -> None:
        words = BLANKS.sub(" ", s)
        if words[:1] == " ":
            self.blank = True
            words = words[1:]
        if not words:
            return
        ends = words[-1] == " "
        if self.line is None:
            self._open()
        elif self.blank:
            self.line.append(" ")
        self.line.append(words[:-1] if ends else words)
        self.blank = ends

    def exact(self, s: str) -> None:
        """Text whose white space counts."""
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.end(keep=True)
            if part:
                self._open()
                if self.blank:
                    self.line.append(" ")
                    self.blank = False
                self.line.append(part)

    def end(self, keep: bool = False) -> None:
        """Ends the line; with keep, also one without text."""
        if self.line is None and keep:
            self._open()
        if self.line is not None:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = None
        self.blank = False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str]) -> None:
        """Lines laid out elsewhere."""
        for x in lines:
            self._open()
            self.line.append(x)
            self.end()

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1].strip(" "):
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column, number of columns, lines
        self.caption: list[list[str]] = []
        self.held: dict[int, int] = {}  # column -> rows that a cell above still takes

    def section(self) -> None:
        """No cell reaches over the ends of a section."""
        self.held = {}

    def row(self) -> None:
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1}
        self.rows.append([])
        self.at = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.held.get(self.at, 0):
            self.at += 1
        self.rows[-1].append((self.at, columns, lines))
        if rows != 1:  # 0: to the end of the section
            self.held.update({c: rows or 1 << 30 for c in range(self.at, self.at + columns)})
        self.at += columns

    def _widths(self, most: float) -> dict[int, int]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, n, lines in row:
                width[c] = max(width.get(c, 0), min(most, max(map(len, lines), default=0)) if n == 1 else 0)
        for row in self.rows:
            for c, n, lines in row:
                if n > 1:  # what a cell needs beyond its columns widens the last of them that there is
                    own = [x for x in range(c, c + n) if x in width]
                    need = min(most, max(map(len, lines), default=0)) - sum(width[x] + 2 * bool(width[x]) for x in own[:-1])
                    width[own[-1]] = max(width[own[-1]], need)
        return width

    def lines(self, max_pad: int, max_fill: int) -> list[str]:
        width = self._widths(float("inf"))
        fill = sum(sum(width[c] for c, _, _ in row[:-1]) * max(len(lines) for *_, lines in row) for row in self.rows if row)
        if fill > max_fill:
            width = self._widths(max_pad)
        start, at = {}, 0
        for c in sorted(width):
            start[c], at = at, at + width[c] + 2 * bool(width[c])
        out = [x for lines in self.caption for x in lines]
        for row in self.rows:
            for i in range(max((len(lines) for *_, lines in row), default=0)):
                line = ""
                for c, _, lines in row:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(start[c]) if len(line) < start[c] else line + "  " * bool(line)
                        line += lines[i]
                out.append(line.rstrip(" "))
        return out


def _number(value: str | None, start: int, least: int = -(1 << 31), most: int = (1 << 31) - 1) -> int:
    """The integer that an attribute begins with; `start` if there is none or it is beyond 32 bits; else within least and most."""
    m = re.match(r"[ \t\n\f\r]*([+-]?)0*([0-9]+)", value or "")
    if not m or len(m[2]) > 10 or not -(1 << 31) <= (n := int(m[1] + m[2])) < 1 << 31:
        return start
    return min(most, max(least, n))


def rendered(html: str | None, max_pad: int = 80, max_fill: int = 1 << 22, max_indent: int = 1000) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    page = Page()
    pages, tables, lists, pre, unseen = [page], [], [], 0, False
    # what is left to do: nodes and texts to enter, and functions for leaving
    left: list = [tree(html)]
    while left:
        x = left.pop()
        if isinstance(x, str):
            if not unseen:
                page.exact(x) if pre else page.text(x)
            continue
        if not isinstance(x, Node):
            kind, value = x
            if kind == "block":
                page.block(value)
            elif kind == "seen":
                unseen = value
            elif kind == "section":
                tables[-1].section()
            elif kind == "pre":
                pre -= 1
                page.block(2)
            elif kind == "list":
                lists.pop()
                page.block(1 if lists else 2)
            elif kind == "item":
                page.block(1)
                page.indent, page.mark = value, None
            elif kind == "quote":
                page.block(2)
                page.indent = value
            elif kind == "cell":
                own = pages.pop().done()
                page = pages[-1]
                (columns, rows), lists, pre = value
                tables[-1].cell(own, columns, rows)
            elif kind == "caption":
                own = pages.pop().done()
                page = pages[-1]
                lists, pre = value
                tables[-1].caption.append(own)
            elif kind == "table":
                page.block(2)
                page.whole(tables.pop().lines(max_pad, max_fill))
                page.block(2)
            continue
        tag = x.tag
        if tag in UNSEEN:
            continue
        own = x.attributes() if x.raw else {}
        if own and ("hidden" in own or "style" in own):
            style = styled(own.get("style", ""))
            if style.get("display", "none" if "hidden" in own else "") == "none":
                continue
            if (way := style.get("visibility")) in ("hidden", "collapse", "visible", "initial"):
                left.append(("seen", unseen))
                unseen = way in ("hidden", "collapse")
        children = x.children
        if tag == "br":
            page.end(keep=True)
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "input":
            if own.get("type", "").lower() in ("submit", "button", "reset") and own.get("value") and not unseen:
                page.text(own["value"])
            continue
        if tag == "hr":
            page.block(2)
            continue
        if tag == "dialog" and "open" not in own:
            continue
        if tag == "details" and "open" not in own:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "table":
            page.block(2)
            tables.append(Table())
            left.append(("table", None))
        elif tag in SECTIONS and tables:
            tables[-1].section()
            left.append(("section", None))
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in CELLS and tables:
            left.append(("cell", ((_number(own.get("colspan"), 1, 1, 1000), _number(own.get("rowspan"), 1, 0, 65534) if own.get("rowspan", "").lstrip()[:1] != "-" else 1), lists, pre)))
            pages.append(page := Page())
            lists, pre = [], 0
        elif tag == "caption" and tables:
            left.append(("caption", (lists, pre)))
            pages.append(page := Page())
            lists, pre = [], 0
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if lists else 2)
            lists.append([_number(own.get("start"), 1) if tag == "ol" else None])
            left.append(("list", None))
        elif tag == "li":
            page.block(1)
            number = lists[-1][0] if lists else None
            if number is not None:
                number = _number(own.get("value"), number)
                lists[-1][0] = number + 1
            mark = "- " if number is None else f"{number}. "
            left.append(("item", page.indent))
            page.mark, page.indent = None if unseen else page.indent + mark, (page.indent + " " * len(mark))[:max_indent]
        elif tag in ("dd", "blockquote"):
            left.append(("quote" if tag == "blockquote" else "item", page.indent))
            page.block(2 if tag == "blockquote" else 1)
            page.indent = (page.indent + "  ")[:max_indent]
        elif tag in ("pre", "textarea", "listing", "xmp", "plaintext"):
            page.block(2)
            pre += 1
            left.append(("pre", None))
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
        elif tag in BLOCK:
            gap = 2 if tag in APART else 1
            page.block(gap)
            left.append(("block", gap))
        if tag == "table" and tables and tag != "tr":
            children = [c for c in children if isinstance(c, Node) or not c.isspace()]
        left.extend(reversed(children))
    return "\n".join(page.done())


def extract(pages: DataFrame, *, html: str = "html", name: str = "text", max_pad: int = 80, max_fill: int = 1 << 22, max_indent: int = 1000) -> DataFrame:
    """pages with the visible text of the whole html column."""
    ship(pages.sparkSession)
    keep = [i for i, c in enumerate(pages.columns) if c != name]
    at = pages.columns.index(html)
    schema = T.StructType([pages.schema.fields[i] for i in keep] + [T.StructField(name, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array([rendered(x, max_pad, max_fill, max_indent) for x in part.column(at).to_pylist()], pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
