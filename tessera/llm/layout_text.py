"""Layout-aware text of HTML pages.

A tree builder reads the tags, supplies the ones that authors leave out (a new
``li`` ends the open one, a block ends an open ``p``, a ``tr`` ends open cells, and
so on) and ignores end tags that match nothing. A renderer walks the tree and
emits all visible text: blocks start new lines, paragraphs, headings, lists and
tables stand between blank lines, list items get a bullet or number and are
indented by depth and numbered as ``start``, ``value`` and ``reversed`` say, ``pre``
keeps its spacing. Table cells are padded so that columns line up; a cell's blocks,
lists and lines stand below each other in its column, and a cell that spans rows or
columns keeps its place in them. Head, scripts, styles, templates, comments, ``hidden``
elements, those styled ``display:none``, closed dialogs, the body of a closed
``details`` and ``noscript`` (as where scripts run) stay out. ``visibility:hidden`` hides the
text of an element but for parts that are made visible again; a hidden cell keeps its
column. Of ``svg`` its text elements are read, of ``math`` all but annotations, of inputs
that are buttons the label.

Both steps use stacks of their own, and tables are rendered from the innermost outward, so
nesting of any depth is fine.

Defined cases: a null page gives null, an empty one the empty text. Text that
isn't markup is returned with its white space collapsed. A tag that never ends
(``<a href=``) is dropped with the rest of the page, as browsers do. Repeated
rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

#: Quotes delimit a value only right after its "="; elsewhere they are characters like others.
_VALUE = r"(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))"
_ATTRIBUTE = rf"([^\s/>][^\s/>=]*)(?:\s*+=\s*+{_VALUE}?)?"
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[\s/]++|"
    + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+)(?P<close>>|\Z)|</[^>]*(?:>|\Z)",
    re.S)
ATTRIBUTE = re.compile(_ATTRIBUTE)
SPACE = re.compile(r"[ \t\n\r\f]+")
NOT_DISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head script style template iframe noembed noframes noscript title datalist object "
                   "audio video canvas annotation annotation-xml area base col colgroup "
                   "link meta param source track".split())
#: Parts of an svg that aren't drawn where they stand, and those that show text.
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
SVG_TEXT = frozenset({"text", "foreignobject"})
BUTTONS = frozenset({"submit", "reset", "button"})
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
                  "option p pre search section summary table ul caption tr td th thead tbody tfoot".split())
#: Blocks that stand between blank lines.
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag ends the nearest open one of these, unless one of the second set is nearer.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), LISTS),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "datalist"})),
    "body": (frozenset({"head"}), frozenset()),
}
ENDS_P = (BLOCK - {"body", "html", "option", "optgroup", "caption", "tr", "td", "th", "thead", "tbody", "tfoot",
                   "table", "legend"}) | {"table"}
#: An end tag doesn't reach beyond these.
WALLS = frozenset({"table", "td", "th", "caption", "button", "html", "template"})
TABLE_WALLS = frozenset({"table", "template"})
TABLE_PARTS = frozenset({"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"})


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out


def parse(html: str) -> Node:
    """The page's tree. Elements that belong to no open one hang from the root."""
    root = Node("html", {})
    stack, open_tags, at, n = [root], {"html": 1}, 0, len(html)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def nearest(tags, walls) -> int | None:
        if not any(open_tags.get(t) for t in tags):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in walls:
                return None
        return None

    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            stack[-1].children.append(unescape(html[at:m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        if not m["close"]:  # the tag never ends
            return root
        tag = name.lower()
        if m["end"]:
            if tag == "p" and nearest({"p"}, WALLS) is None:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif (i := nearest({tag}, (TABLE_WALLS if tag in TABLE_PARTS else WALLS) - {tag})) is not None:
                pop_to(i)
            continue
        if tag == "html":
            continue
        if tag == "body" and open_tags.get("body"):
            continue
        if tag in ENDS_P and (i := nearest({"p"}, WALLS)) is not None:
            pop_to(i)
        if tag in ENDS and (i := nearest(*ENDS[tag])) is not None:
            pop_to(i)
        if tag in BLOCK and open_tags.get("head"):
            if (i := nearest({"head"}, frozenset())) is not None:
                pop_to(i)
        node = Node(tag, _attributes(m["rest"]) if m["rest"].strip(" /\n\t") else {})
        stack[-1].children.append(node)
        ended = m["rest"].endswith("/") and (
            tag in ("svg", "math") or bool(open_tags.get("svg") or open_tags.get("math")))
        if tag in RAW and not ended:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            body = html[at:end.start()]
            node.children.append(unescape(body) if tag in ("title", "textarea") else body)
            at = end.end()
        elif tag not in VOID and not ended:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < n:
        stack[-1].children.append(unescape(html[at:]))
    return root


def hidden(node: Node) -> bool:
    """Neither the element nor anything in it is shown."""
    a = node.attrs
    return (node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
            or (node.tag == "dialog" and "open" not in a)
            or bool(a) and "style" in a and NOT_DISPLAYED.search(a["style"]) is not None)


def veiled(node: Node, inherited: bool) -> bool:
    """Whether the element's own text is invisible."""
    found = VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else None
    return found[-1].lower() != "visible" if found else inherited


def _number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.lstrip("-").isdecimal() and text.isascii() and len(text) < 10 else None


class _Page:
    """Lines being written. Breaks asked for are kept back until text comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.breaks = 0       # line ends owed before the next text
        self.blank = False    # a collapsed space is owed
        self.indent: list[str] = []
        self.mark: str | None = None

    def need(self, n: int) -> None:
        self.blank = False
        self.breaks = max(self.breaks, n)

    def _start(self) -> None:
        if self.breaks and (self.lines or self.line):
            self.lines.append("".join(self.line).rstrip())
            self.lines += [""] * (self.breaks - 1)
            self.line = []
        self.breaks = 0
        if not self.line:
            self.line.append("".join(self.indent[:-1] if self.mark else self.indent))
            if self.mark:
                self.line.append(self.mark)
                self.mark = None

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words in ("", " "):
            self.blank = self.blank or words == " "
            return
        fresh = bool(self.breaks) or not self.line
        if self.breaks or not self.line:
            self._start()
        if not fresh and (self.blank or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.blank = words[-1] == " "

    def verbatim(self, s: str) -> None:
        for i, row in enumerate(s.split("\n")):
            if i:
                self.breaks += 1
            if row:
                if self.breaks or not self.line:
                    self._start()
                self.line.append(row)

    def done(self) -> str:
        return "\n".join([*self.lines, "".join(self.line).rstrip()]).strip("\n")


def _rows(table: Node, veil: bool) -> tuple[list, list[list]]:
    """Captions and rows of cells, each with whether it is veiled; loose content makes
    a row of its own. A row hidden by its tag or an enclosing section is left out."""
    captions, rows = [], []
    queue = [(x, veil) for x in reversed(table.children)]
    while queue:
        x, veil = queue.pop()
        if isinstance(x, str):
            if x.strip():
                captions.append((_wrapped([x]), veil))
        elif hidden(x):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            queue += [(c, veiled(x, veil)) for c in reversed(x.children)]
        elif x.tag == "tr":
            rows.append([(c if isinstance(c, Node) and c.tag in ("td", "th") else _wrapped([c]), veiled(x, veil))
                         for c in x.children if not (isinstance(c, str) and not c.strip())
                         and not (isinstance(c, Node) and hidden(c))])
        elif x.tag in ("td", "th"):
            rows.append([(x, veil)])
        else:
            captions.append((x, veil))
    return captions, rows


def _wrapped(children: list) -> Node:
    node = Node("td", {})
    node.children = children
    return node


def _span(cell: Node, name: str, most: int) -> int:
    n = _number(cell.attrs.get(name))
    return most if n == 0 and name == "rowspan" else min(max(n or 1, 1), most)


def _table(node: Node, veil: bool, tables: dict[int, str]) -> str:
    captions, rows = _rows(node, veil)
    lines = [t for c, v in captions if (t := render(_wrapped([c]), tables, v))]
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # columns that a cell from above still holds, and for how many rows
    width: dict[int, int] = {}
    for row in rows:
        cells: dict[int, list[str]] = {}
        held, column = dict(taken), 0
        for c, v in row:
            while held.get(column):
                column += 1
            if text := render(c, tables, v):
                cells[column] = text.split("\n")
                width[column] = max(width.get(column, 0), *map(len, cells[column]))
            below = _span(c, "rowspan", 65_534)
            for _ in range(_span(c, "colspan", 1_000)):
                if below > 1:
                    taken[column] = below
                column += 1
        taken = {i: n - 1 for i, n in taken.items() if n > 1}
        if cells:
            grid.append(cells)
    columns = sorted(width)
    for cells in grid:
        for k in range(max(map(len, cells.values()))):
            lines.append("  ".join((cells[i][k] if k < len(cells.get(i, ())) else "").ljust(width[i])
                                   for i in columns).rstrip())
    return "\n".join(lines)


def _tables(root: Node) -> dict[int, str]:
    """The text of every table that isn't hidden, by the node's identity; inner tables
    come first."""
    found, todo = [], [(root, False)]
    while todo:
        x, veil = todo.pop()
        if hidden(x):
            continue
        veil = veiled(x, veil)
        if x.tag == "table":
            found.append((x, veil))
        todo += [(c, veil) for c in x.children if isinstance(c, Node)]
    tables: dict[int, str] = {}
    for x, veil in reversed(found):
        tables[id(x)] = _table(x, veil, tables)
    return tables


def _drawn(svg: Node) -> list:
    """The elements of an svg that show text, a blank between them."""
    out, queue = [], list(reversed(svg.children))
    while queue:
        x = queue.pop()
        if isinstance(x, str) or hidden(x) or x.tag in SVG_UNSEEN:
            continue
        if x.tag in SVG_TEXT:
            out += [" ", x]
        else:
            queue += reversed(x.children)
    return [*out, " "] if out else out


def _first_number(x: Node) -> list[int] | None:
    """An ordered list's next number and the step between its numbers."""
    if x.tag != "ol":
        return None
    step = -1 if "reversed" in x.attrs else 1
    first = _number(x.attrs.get("start"))
    if first is None:
        first = 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" and not hidden(c) for c in x.children)
    return [first, step]


def render(root: Node, tables: dict[int, str], veil: bool = False) -> str:
    """Visible text of a tree. ``tables``: the text of the tables in it; ``veil``:
    text is invisible where nothing makes it visible again."""
    page, pre = _Page(), 0
    todo: list = [root]
    counters: list[list[int] | None] = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not veil:
                page.verbatim(x) if pre else page.text(x)
        elif isinstance(x, tuple):  # leaving an element
            tag, sort, veil = x
            if not tag:
                continue
            pre -= sort == "pre"
            if sort == "list":
                counters.pop()
            if sort == "item":
                page.indent.pop()
                page.mark = None
            page.need(2 if tag in APART and not (sort == "list" and counters) else 1)
        elif x.tag == "br":
            if not veil:
                page.blank = False
                page.breaks += 1
        elif not hidden(x):
            tag, outside, veil = x.tag, veil, veiled(x, veil)
            if id(x) in tables:
                page.need(2)
                if text := tables[id(x)]:
                    page.verbatim(text)
                page.need(2)
                veil = outside
                continue
            children = _drawn(x) if tag == "svg" else x.children
            if tag in BLOCK:
                inner = tag in LISTS and bool(counters)
                page.need(2 if tag in APART and not inner else 1)
                sort = "list" if tag in LISTS else "item" if tag in ("li", "dd") else "pre" if tag == "pre" else ""
                if sort == "list":
                    counters.append(_first_number(x))
                elif tag == "li":
                    mark = "- "
                    if counters and counters[-1] is not None:
                        own = _number(x.attrs.get("value"))
                        number = counters[-1][0] if own is None else own
                        mark = f"{number}. "
                        counters[-1][0] = number + counters[-1][1]
                    page.mark = mark
                    page.indent.append(" " * len(mark))
                elif tag == "dd":
                    page.indent.append("  ")
                elif sort == "pre" and children and isinstance(children[0], str) and children[0][:1] == "\n":
                    children = [children[0][1:], *children[1:]]  # the line break after the tag isn't text
                pre += sort == "pre"
                todo.append((tag, sort, outside))
            else:
                if tag in ("td", "th"):
                    page.text(" ")
                elif tag == "input" and not veil and x.attrs.get("type", "").strip().lower() in BUTTONS:
                    page.text(x.attrs.get("value", ""))
                if veil != outside:
                    todo.append(("", "", outside))
            if tag == "details" and "open" not in x.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            todo += reversed(children)
    return page.done()


def text_of(html: str | None) -> str | None:
    if html is None:
        return None
    root = parse(html.replace("\r\n", "\n").replace("\r", "\n"))
    return render(root, _tables(root))


def rendered(html: Column) -> Column:
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([text_of(p) for p in pages], dtype=object)

    return texts(html)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, text`` for every page."""
    modest_batches(pages.sparkSession)
    return pages.select("page_id", rendered(F.col("html")).alias("text"))
