"""Visible text of HTML pages as a browser lays it out: blocks, lists and tables with aligned cells.

A tree is built from tags with the omissions HTML allows (an unclosed paragraph, list item or cell ends where the next one
begins), hidden elements and comments are left out, and the tree is rendered: white space collapses except in <pre>, blocks stand on
lines of their own, paragraphs and headings have an empty line around them, list items a mark and an indent, table cells columns.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, elements whose content is no markup, elements that are never shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = set("head script style template noscript iframe object audio video canvas datalist title noembed noframes".split())
# Elements within svg or math that are never shown themselves.
UNDRAWN = set("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
# Elements that may stand in <head>; any other one, or text, ends it.
HEAD = set("base basefont bgsound link meta title style script template noscript noframes head".split())
# Elements that stand on lines of their own, and those of them with an empty line around them.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
# An opening tag (left) ends an open element (right), up to the nearest of the elements after the bar.
_ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"), "thead": ("tbody thead tfoot tr td th caption colgroup", "table"), "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"),
}
ENDS = {k: (set(v[0].split()), set(v[1].split())) for k, v in _ENDS.items()}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "optgroup", "legend"}

_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_NUMBER = re.compile(r"[ \t\n\r\f]*(-?[0-9]{1,9})(?![0-9])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: its name, its children (elements or texts), whether it is shown, the number its list begins with, a cell's spans."""

    __slots__ = ("name", "children", "shown", "start", "columns", "rows")

    def __init__(self, name: str, shown: bool = True, start: int = 1, columns: int = 1, rows: int = 1):
        self.name, self.children, self.shown, self.start, self.columns, self.rows = name, [], shown, start, columns, rows


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def _number(text: str, default: int, low: int = -(10**9), high: int = 10**9) -> int:
    """The whole number of up to nine digits that text begins with, between low and high; else the default."""
    m = _NUMBER.match(text)
    return min(max(int(m[1]), low), high) if m else default


#: Tags whose quotes never close are looked at so often; after that quotes in tags count as other characters.
UNCLOSED = 20


class _Scanner:
    """Finds tags from left to right. Each search either moves on or is remembered to be in vain, so any page takes linear time."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, 0
        self.last = page.rfind(">")  # behind it no tag ends

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at `at`, or -1: quoted ones don't count."""
        page, first = self.page, at
        if at > self.last:
            return -1
        while self.unclosed < UNCLOSED:
            at = _UNQUOTED.match(page, at).end()
            if at == len(page):
                break
            if page[at] == ">":
                return at
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.unclosed += 1
        return page.find(">", first)


def parse(page: str) -> Node:
    """The page's tree. Any text gives a tree: what closes nothing is passed over, what is open at the end is closed."""
    root = Node("html")
    open_, at, n = [root], 0, len(page)
    where: dict[str, list[int]] = {}  # places of open elements by name
    scan = _Scanner(page)

    def cut(i: int) -> None:
        while len(open_) > i:
            where[open_.pop().name].pop()

    def last(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def close(names: set[str], bounds: set[str]) -> None:
        i = last(names)
        if i > last(bounds):
            while i > 1 and open_[i - 1].name in names:
                i -= 1
            cut(i)

    def put(text: str) -> None:
        if open_[-1].name == "head" and _SPACE.sub("", text):
            cut(len(open_) - 1)
        open_[-1].children.append(text)

    begin = 0  # where text not yet put begins
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            if at > begin:
                put(unescape(page[begin:at]))
            m = _COMMENT_END.search(page, at + 4)
            begin = at = m.end() if m else n
            continue
        m = _TAG.match(page, at)
        stop = scan.end(m.end()) if m else page.find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") and at < scan.last else -1
        if stop < 0:
            at += 1
            continue
        if at > begin:
            put(unescape(page[begin:at]))
        begin = at = stop + 1
        if not m:
            continue
        name, attributes = m[2].lower(), page[m.end() : stop]
        if m[1]:
            own = last((name,))
            if own and (name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or own >= last(("table", "td", "th"))):
                cut(own)
            elif name == "p":
                open_[-1].children.append(Node("p"))
            continue
        if name in ENDS_P and where.get("p"):
            close({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if name in ENDS:
            close(*ENDS[name])
        if name == "html":
            continue
        if open_[-1].name == "head" and name not in HEAD:
            cut(len(open_) - 1)
        drawn = bool(where.get("svg") or where.get("math"))
        own = _attributes(attributes) if attributes and not attributes.isspace() else {}
        hidden = name in HIDDEN or "hidden" in own or (drawn and name in UNDRAWN) or ("style" in own and _NONE.search(own["style"]) is not None) or (name == "input" and own.get("type", "").lower() == "hidden")
        node = Node(name, not hidden)
        if name == "ol":
            node.start = _number(own.get("start", ""), 1)
        elif name in ("td", "th"):
            node.columns, node.rows = _number(own.get("colspan", ""), 1, 1, 1000), _number(own.get("rowspan", ""), 1, 0, 65534)
        open_[-1].children.append(node)
        if name == "img" and own.get("alt"):
            node.children.append(own["alt"])
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", m.end()) if m else -1
            node.children.append(page[at : m.start() if m else n])
            begin = at = stop + 1 if stop >= 0 else n
        elif name not in VOID and not (attributes.endswith("/") and (drawn or name in ("svg", "math"))):
            where.setdefault(name, []).append(len(open_))
            open_.append(node)
    if begin < n:
        put(unescape(page[begin:]))
    return root


class Layout:
    """Lines of text; a line's words come together with single spaces."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # empty lines that are due before the next one
        self.space = False
        self.mark = ""

    def text(self, text: str) -> None:
        words = _SPACE.split(text)
        lead, trail = words[0] == "", words[-1] == ""
        words = [w for w in words if w]
        if not words:
            self.space |= bool(self.now)
            return
        if self.now and (self.space or lead):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = trail

    def end(self, gap: int = 0) -> None:
        if line := "".join(self.now).strip(" "):
            self.put([line])
        self.now, self.space = [], False
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines += lines


#: A table whose columns together are wider than so many characters, or more than so many, is not aligned: cells follow each other.
WIDEST, COLUMNS = 1000, 1000
_GROUPS = ("tbody", "thead", "tfoot", "colgroup", "col")


def _placed(rows: list[list[tuple[Node, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Cells of each row as (column, columns, lines): each takes the first columns that no cell from above reaches into."""
    out, reach = [], {}  # column: rows that a cell above still covers
    for k, row in enumerate(rows):
        now, column, new = [], 0, {}
        for cell, lines in row:
            while reach.get(column, 0) > 0:
                column += 1
            span = min(cell.columns, max(1, COLUMNS - column))
            if down := (cell.rows or len(rows) - k) - 1:
                new.update((c, down) for c in range(column, column + span))
            now.append((column, span, lines))
            column += span
        reach = {c: d - 1 for c, d in reach.items() if d > 1} | new
        out.append(now)
    return out


def _table(node: Node, depth: int) -> list[str]:
    """Rows of cells, each column as wide as its widest line; a cell's further lines stand below its first.

    A cell stands in the first of its columns; its lines may reach over the others. Text in the table, a row or a group of rows,
    but in no cell, stands before the table.
    """
    rows, captions, loose = [], [], []
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            loose += [x] if x.strip() else []
        elif not x.shown:
            continue
        elif x.name in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append((x, _lines(x.children, depth + 1, depth + 1)))
        elif x.name == "tr" or x.name in _GROUPS:
            if x.name == "tr":
                rows.append([])
            todo += reversed(x.children)
        else:
            captions += _lines(x.children if x.name == "caption" else [x], depth + 1, depth + 1)
    grid = _placed(rows)
    need: dict[int, int] = {}
    for row in grid:
        for column, span, lines in row:
            if span == 1:
                need[column] = max(need.get(column, 0), max(map(len, lines), default=0))
    widest = max((c + s for row in grid for c, s, _ in row), default=0)
    widths = [need.get(c, 0) for c in range(min(widest, COLUMNS))]
    for row in grid:  # a cell over several columns widens the last of them where it needs to
        for column, span, lines in row:
            if span > 1 and column + span <= len(widths):
                lack = max(map(len, lines), default=0) - sum(widths[column : column + span]) - 2 * (span - 1)
                widths[column + span - 1] += max(0, lack)
    aligned = widest <= COLUMNS and sum(widths) <= WIDEST
    begin = [0]
    for w in widths:
        begin.append(begin[-1] + w + 2)
    out = []
    for row in grid:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line = ""
            for column, _, lines in row:
                if aligned:
                    line = line.ljust(begin[column])
                elif line:
                    line += "  "
                line += lines[k] if k < len(lines) else ""
            out.append(line.rstrip(" "))
    return [*(_lines(loose) if loose else []), *captions, *out]


#: Elements nested deeper are laid out as if they stood in the last one.
DEEPEST = 100


def _lines(children: list, depth: int = 0, base: int = 0) -> list[str]:
    """base: the depth of the page, or of the table cell that holds the children."""
    layout = Layout()
    _render(children, layout, depth, base)
    layout.end()
    return layout.lines


#: Stands in _flat()'s result where a block begins or ends.
BREAK = Node("")


def _flat(children: list) -> list:
    """All texts below, line breaks and borders of blocks, without recursion."""
    out, todo = [], list(reversed(children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x is BREAK or (x.shown and x.name in ("br", "hr")):
            out.append(x)
        elif x.shown:
            border = [BREAK] if x.name in BLOCK and x.name not in ("td", "th") else [" "] if x.name in ("td", "th") else []
            todo += [*border, *reversed(x.children), *border]
    return out


def _verbatim(children: list) -> str:
    """The text of <pre>: a <br> is a line break, and a block stands on lines of its own."""
    parts: list[str] = []
    for x in _flat(children):
        out = x if isinstance(x, str) else "\n" if x.name == "br" or (parts and not parts[-1].endswith("\n")) else ""
        if not isinstance(x, str) and x.name == "hr":
            out += "---\n"
        if out:
            parts.append(out)
    return "".join(parts)


def _render(children: list, layout: Layout, depth: int, base: int = 0) -> None:
    if depth > DEEPEST:
        children = _flat(children)
    number = None
    for x in children:
        if isinstance(x, str):
            layout.text(x)
            continue
        if not x.shown:
            continue
        name = x.name
        if x is BREAK:
            layout.end()
            continue
        if name == "br":
            blank = not layout.now
            layout.end()
            if blank:
                layout.gap = max(layout.gap, 1)
            continue
        if name == "hr":
            layout.end()
            layout.put(["---"])
            continue
        if name == "wbr":
            continue
        gap = 1 if name in SPACED and not (depth > base and name in ("ul", "ol", "dl")) else 0
        if name in BLOCK:
            layout.end(gap)
        if name in ("ul", "ol", "menu", "dir"):
            count = x.start
            for item in x.children:
                if isinstance(item, str):
                    layout.text(item)
                elif item.name == "li" and item.shown:
                    layout.end()
                    mark = f"{count}. " if name == "ol" else "- "
                    count += 1
                    if lines := _lines(item.children, depth + 1, base):
                        layout.put([mark + lines[0], *(" " * len(mark) + line if line else "" for line in lines[1:])])
                else:
                    _render([item], layout, depth + 1, base)
            layout.end(gap)
            continue
        if name == "table":
            if lines := _table(x, depth):
                layout.put(lines)
            layout.end(gap)
            continue
        if name == "pre":
            text = _verbatim(x.children).strip("\n").expandtabs(8)
            if text:
                layout.put([line.rstrip() for line in text.split("\n")])
            layout.end(gap)
            continue
        if name == "blockquote" or name == "dd":
            if lines := _lines(x.children, depth + 1, base):
                layout.put(["  " + line if line else "" for line in lines])
            layout.end(gap)
            continue
        if name in ("td", "th", "text"):  # svg places each <text> by itself
            layout.space = True
        _render(x.children, layout, depth + 1, base)
        if name in BLOCK:
            layout.end(gap)
        elif name == "option":
            layout.end()


def visible_text(page: str | None) -> str:
    """The page's visible text; an empty or null page has none."""
    return "\n".join(_lines(parse(page).children)) if page else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text` (visible text) and `n_lines` (long, its lines; 0 if empty) in place of columns so named and of html.

    A null or empty page, and one without visible text, gives an empty text. Any string gives a result, in time that grows with its
    length. A number that is none, or has more than nine digits, counts as not given; quotes that never close are taken as other characters. One pass, no shuffle;
    repeated rows stay; an empty table gives an empty table.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([visible_text(t) for t in texts], dtype=object)

    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_lines", html)]
    out = pages.select(*keep, run(F.col(html)).alias("text"))
    return out.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
