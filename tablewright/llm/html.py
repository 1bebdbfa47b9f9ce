"""Layout-aware text of HTML pages: a tree with implied tags, rendered as a reader sees it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript noframes noembed iframe title meta link base object "
    "audio video canvas svg math map datalist param source track".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main "
    "menu nav ol optgroup option p pre search section summary table ul textarea xmp caption".split()
)
SPACED = frozenset(
    "blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset xmp".split()
)
ENDS_P = BLOCK - frozenset("body html li dd dt option optgroup caption textarea".split()) | {"hr"}
#: a start tag closes the nearest of the first, unless one of the second is in between
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
WALL = frozenset("table td th caption html template button".split())  # an end tag does not reach past
IN_TABLE = frozenset("table thead tbody tfoot tr".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
TAIL = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+>""")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SIMPLE = re.compile(r"[.#]?[\w-]+")
WORDS = re.compile(r"[^ \t\n\r\f]+")
BLANK = " \t\n\r\f"


class Node:
    __slots__ = ("tag", "raw", "children", "_attrs")

    def __init__(self, tag: str, raw: str = "") -> None:
        self.tag, self.raw, self._attrs = tag, raw, None
        self.children: list[Node | str] = []

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for m in ATTRIBUTE.finditer(self.raw):
                value = m[2] or m[3] or m[4] or ""
                self._attrs.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        return self._attrs


class Tree:
    """Builds the tree; `hidden` are the simple selectors that style sheets hide."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.counts: dict[str, int] = {"html": 1}
        self.hidden: set[str] = set()

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def pop_to(self, tags: set[str] | frozenset[str], wall: set[str] | frozenset[str]) -> None:
        """Closes the nearest of `tags`, and what is open in it, unless a wall comes first."""
        if not any(self.counts.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                for node in self.open[at:]:
                    self.counts[node.tag] -= 1
                del self.open[at:]
                return
            if tag in wall:
                return

    def start(self, tag: str, raw: str, closed: bool) -> None:
        if tag in ("html", "body") and (tag == "html" or self.counts.get("body")):
            return
        if tag in ENDS_P and self.counts.get("p"):
            self.pop_to({"p"}, WALL)
        rule = IMPLIED.get(tag)
        if rule:
            if tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                if not self.counts.get("table"):
                    return  # cells and rows outside a table are ignored, their content stays
                if tag in ("tr", "tbody", "thead", "tfoot"):
                    self.pop_to({"td", "th"}, {"table"})
                if tag not in ("td", "th"):
                    self.pop_to({"tr"}, {"table"})
            self.pop_to(*rule)
            if tag in ("td", "th") and self.open[-1].tag != "tr":
                self.pop_to({"caption"}, {"table"})
                self.push(Node("tr"))
        elif tag not in ("head", "body") and self.counts.get("head") and tag not in UNSEEN:
            self.pop_to({"head"}, set())
        node = Node(tag, raw)
        if tag in VOID or (closed and tag in ("svg", "math", "path")):
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.counts.get("p"):
            self.open[-1].children.append(Node("p"))
        elif tag == "br":
            self.open[-1].children.append(Node("br"))
        else:
            wall = set() if tag in IN_TABLE or tag in ("td", "th", "caption") else WALL
            self.pop_to({tag}, wall - {tag})

    def text(self, text: str) -> None:
        if text:
            if self.counts.get("head") and self.open[-1].tag == "head" and text.strip():
                self.pop_to({"head"}, set())
            self.open[-1].children.append(text)

    def style(self, css: str) -> None:
        for selectors, body in RULE.findall(re.sub(r"(?s)/\*.*?\*/", "", css)):
            if HIDES.search(body):
                self.hidden.update(
                    s.lower() if s[:1] not in ".#" else s
                    for s in map(str.strip, selectors.split(",")) if SIMPLE.fullmatch(s)
                )


def parse(html: str) -> Tree:
    """The tree of a page.  What an unclosed comment, quote or raw element holds up to the end of
    the page belongs to it, as in a browser."""
    tree, at, size = Tree(), 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            tree.text(html[at:])
            break
        if lt > at:
            tree.text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        close = nxt == "/"
        name = NAME.match(html, lt + 1 + close)
        if not name:
            if close and html[lt + 2 : lt + 3]:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                tree.text("<")
                at = lt + 1
            continue
        tail = TAIL.match(html, name.end())
        if not tail:
            break
        at, tag = tail.end(), name[0].lower()
        raw = html[name.end() : at - 1]
        if close:
            tree.end(tag)
            continue
        tree.start(tag, raw, raw.endswith("/"))
        if tag in ("pre", "textarea") and html.startswith("\n", at):
            at += 1
        if tag in RAW:
            gone = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            inner = html[at : gone.start()] if gone else html[at:]
            if tag == "style":
                tree.style(inner)
            elif tag in ("textarea", "xmp"):
                tree.open[-1].children.append(inner)
            tree.end(tag)
            end = html.find(">", gone.start()) if gone else -1
            at = size if end < 0 else end + 1
        elif tag == "plaintext":
            tree.open[-1].children.append(html[at:])
            break
    return tree


class Flow:
    """Lines of a box."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker: str | None = None

    def add(self, text: str) -> None:
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap, self.space = 0, False
            front = "".join(self.indent)
            if self.marker is not None:
                front = front[: len(front) - len(self.marker)] + self.marker
                self.marker = None
            self.line.append(front)
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def words(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        parts = WORDS.findall(text)
        if not parts:
            self.space = self.space or bool(text)
            return
        if text[0] in BLANK:
            self.space = True
        self.add(" ".join(parts).replace("\xa0", " "))
        self.space = text[-1] in BLANK

    def kept(self, text: str) -> None:
        """Text whose white space counts."""
        text = unescape(text) if "&" in text else text
        rows = text.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for n, row in enumerate(rows):
            if n:
                self.end_line(True)
            if row:
                self.space = False
                self.add(row.replace("\xa0", " "))

    def end_line(self, even_empty: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif even_empty:
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)


def span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip() if name in node.raw.lower() else "1"
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, column span, row span) as aligned text."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    busy: dict[int, int] = {}
    for row in rows:
        at, cells, new = 0, [], {}
        for lines, across, down in row:
            while busy.get(at, 0):
                at += 1
            cells.append((at, across, lines))
            if down > 1:
                new.update(dict.fromkeys(range(at, at + across), down))
            at += across
        busy = {c: n - 1 for c, n in (busy | new).items() if n > 1}
        placed.append(cells)
    width: dict[int, int] = {}
    for cells in placed:
        for at, across, lines in cells:
            if across == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
    for cells in placed:
        for at, across, lines in cells:
            if across > 1:
                have = sum(width.get(c, 0) + 2 for c in range(at, at + across)) - 2
                need = max(map(len, lines), default=0) - have
                if need > 0:
                    width[at + across - 1] = width.get(at + across - 1, 0) + need
    left: dict[int, int] = {}
    total = 0
    for c in range(max(width, default=-1) + 1):
        left[c] = total
        total += width.get(c, 0) + (2 if width.get(c, 0) else 0)
    out = []
    for cells in placed:
        for n in range(max((len(lines) for *_, lines in cells), default=0)):
            text = ""
            for at, _, lines in cells:
                if n < len(lines) and lines[n]:
                    text = text.ljust(left.get(at, total)) + lines[n]
            out.append(text.rstrip())
    return out


class Renderer:
    """Walks the tree without recursion, so depth is not bounded by Python's stack."""

    def __init__(self, tree: Tree) -> None:
        self.hidden = tree.hidden
        self.flow = Flow()
        self.flows: list[Flow] = []
        self.tables: list[dict] = []
        self.lists: list[list] = []
        self.pre = 0

    def seen(self, node: Node) -> bool:
        if node.tag in UNSEEN:
            return False
        raw = node.raw
        if not raw and not self.hidden:
            return True
        low = raw.lower()
        if "hidden" in low:
            a = node.attrs
            if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
                return False
        if "style" in low and HIDES.search(node.attrs.get("style", "")):
            return False
        if self.hidden:
            if node.tag in self.hidden:
                return False
            if "class" in low and any(f".{c}" in self.hidden for c in node.attrs.get("class", "").split()):
                return False
            if "id" in low and f"#{node.attrs.get('id', '')}" in self.hidden:
                return False
        return True

    def render(self, root: Node) -> str:
        work: list[tuple[Node | str, bool]] = [(root, False)]
        while work:
            node, leaving = work.pop()
            if isinstance(node, str):
                if self.tables and self.tables[-1]["flow"] is self.flow and not node.strip():
                    continue
                (self.flow.kept if self.pre else self.flow.words)(node)
            elif leaving:
                self.leave(node)
            elif self.seen(node):
                self.enter(node)
                work.append((node, True))
                children = node.children
                if node.tag == "details" and "open" not in node.attrs:
                    children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
                work.extend((c, False) for c in reversed(children))
        self.flow.end_line()
        return "\n".join(self.flow.lines).strip("\n")

    def enter(self, node: Node) -> None:
        tag, flow = node.tag, self.flow
        if tag in BLOCK:
            inner = tag in ("ul", "ol", "menu", "dir") and self.lists
            flow.block(2 if tag in SPACED and not inner else 1)
        if tag == "br":
            flow.end_line(True)
        elif tag == "hr":
            flow.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "1") if "start" in node.raw else "1"
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) and start.isascii() else 1
            self.lists.append([tag, number])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            flow.indent.append(" " * len(mark))
            flow.marker = mark
        elif tag in ("blockquote", "dd"):
            flow.indent.append("    ")
        elif tag in ("pre", "textarea", "xmp"):
            self.pre += 1
        elif tag == "q":
            flow.words('"')
            flow.space = False
        elif tag == "table":
            self.tables.append({"rows": [], "flow": flow})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            self.flows.append(flow)
            self.flow = Flow()
            self.flow.indent = []
        elif tag == "option" and flow.line:
            flow.space = True

    def leave(self, node: Node) -> None:
        tag, flow = node.tag, self.flow
        if tag in ("td", "th") and self.tables and self.flows:
            flow.end_line()
            rows = self.tables[-1]["rows"]
            if not rows:
                rows.append([])
            rows[-1].append((flow.lines, span(node, "colspan"), span(node, "rowspan")))
            self.flow = self.flows.pop()
            return
        if tag == "table" and self.tables:
            lines = grid(self.tables.pop()["rows"])
            flow.end_line()
            for n, line in enumerate(lines):
                if line:
                    flow.add(line)
                flow.end_line(n > 0)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.lists.pop()
        elif tag == "li":
            flow.end_line()
            flow.indent.pop()
            flow.marker = None
        elif tag in ("blockquote", "dd"):
            flow.end_line()
            flow.indent.pop()
        elif tag in ("pre", "textarea", "xmp"):
            self.pre -= 1
        elif tag == "q":
            flow.space = False
            flow.words('"')
        if tag in BLOCK:
            inner = tag in ("ul", "ol", "menu", "dir") and self.lists
            self.flow.block(2 if tag in SPACED and not inner else 1)


def visible_text(html: str | None) -> str:
    """The text a reader of the page sees, laid out."""
    if not html:
        return ""
    tree = parse(html.replace("\x00", ""))
    return Renderer(tree).render(tree.root)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows with `text`, the visible text of the page.

    Blocks start on a line of their own, paragraphs, headings, lists and tables are set off by a
    blank line, items carry `-` or their number and are indented by level, cells of a table are
    aligned in columns, preformatted text keeps its white space.  Not shown: heads, scripts, styles,
    templates, comments, what `hidden`, a style or a simple style-sheet rule hides, and closed
    details.  Missing and implied end tags are completed as a browser does.

    NULL and empty pages give the empty text; a text without tags is its own words.  Pages are
    handled one by one, so nothing is shuffled; other columns and repeated rows stay, a column named
    `text` is replaced.
    """
    rest = [c for c in pages.columns if c not in ("text", html_col)]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [visible_text(x.as_py()) for x in b.column("_html")]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in rest), pa.array(texts, pa.string())],
                    names=[*rest, "text"],
                )

    rows = pages.select(*rest, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(render, f"{schema}{', ' if schema else ''}text string")
