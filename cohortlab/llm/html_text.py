"""Text of web pages by layout: a tree with implied tags, visibility rules, and a renderer for blocks, lists and tables.

Every step takes time in proportion to the page: tags are found by one scan that never goes back, open elements are
looked up by name, and the renderer keeps its own stack, so that nesting has no limit. Columns are aligned at any width and
cells reach down over any number of rows, as long as a table's padding and empty cells stay in proportion to it: at most
ROOM blanks a character and row, and DOWN empty cells a cell. Beyond that, and for indents of over INDENT blanks and tables more than TABLES
deep in each other's cells, text is set without them; none is lost.

Elements are hidden by tag, attribute and style, and by rules of the page's style sheets that name one tag, class or id (or
several of them together) and set display or visibility; of rules that apply, the more specific one counts, then the later.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: elements by layout
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title svg math iframe object canvas audio video datalist select".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: blocks with an empty line around them
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
#: fixed values: where the lookup of an open element ends
LISTS, CELLS, SECTIONS = ("ul", "ol", "menu", "dir"), ("td", "th", "caption"), ("tbody", "thead", "tfoot")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: fixed values: an opening tag closes these open elements, up to the given bounds
CLOSES = {
    "li": (("li",), (*LISTS, "table", *CELLS)),
    "dt": (("dt", "dd"), ("dl", "table", *CELLS)),
    "dd": (("dt", "dd"), ("dl", "table", *CELLS)),
    "option": (("option",), ("select", "datalist")),
}
#: a block start closes an open paragraph
ENDS_P = BLOCK - {*CELLS, *SECTIONS, "tr", "body", "html", "option", "optgroup"}
STRUCTURE = frozenset(("tr", "colgroup", "col", *CELLS, *SECTIONS))
#: widest indent of a line; tables laid out inside each other's cells; blanks of a table for each of its characters and rows, and empty cells that reach down for each of its cells
INDENT, TABLES, ROOM, DOWN = 40, 8, 64, 8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# one attribute after any white space and slashes; quoted values may hold anything but their quote
_ATTR = re.compile(r"[\s/]*+(=?[^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>]*+)))?+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BLANKS = re.compile(" {2,}")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
_HUGE = re.compile("&#0*+[0-9]{8,}+;?")
_ENDS: dict[str, re.Pattern] = {}
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
#: a selector of one element: a tag or none, then ids and classes
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")


class Node:
    __slots__ = ("tag", "kids", "gone", "shown", "attrs")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.kids, self.attrs = tag, [], attrs or {}
        self.gone, self.shown = tag in HIDDEN, None

    def number(self, name: str, other: int) -> int:
        m = _NUMBER.match(self.attrs.get(name, ""))
        return int(m[1]) if m else other


def _unescaped(text: str) -> str:
    if "&" not in text:
        return text
    return html.unescape(_HUGE.sub("\ufffd", text))


def _attributes(source: str, at: int) -> tuple[dict[str, str] | None, int, bool]:
    """(attributes, where the tag ends, whether it closes itself) of a tag from after its name; None if the page ends in it."""
    found: dict[str, str] = {}
    while True:
        m = _ATTR.match(source, at)
        if m.end() == len(source) or m[2] is not None and not m[3] or m[4] is not None and not m[5]:
            return None, len(source), False
        if m[1]:
            value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6]
            found.setdefault(m[1].lower(), _unescaped(value or ""))
        at = m.end()
        if source[at] == ">":
            return found, at + 1, source[at - 1] == "/" and m[6] is None


def _declared(source: str) -> dict[str, tuple[str, bool]]:
    """display and visibility of a list of declarations, and whether they are important."""
    found: dict[str, tuple[str, bool]] = {}
    for rule in source.lower().split(";"):
        name, _, value = rule.partition(":")
        value, _, force = value.partition("!")
        if (name := name.strip()) in ("display", "visibility"):
            important = force.strip() == "important"
            if important or not found.get(name, ("", False))[1]:
                found[name] = (value.strip(), important)
    return found


def style_rules(source: str, order: int) -> list[tuple[str, frozenset[str], tuple, dict[str, tuple[str, bool]]]]:
    """(tag or '', ids and classes, rank, declarations) of a style sheet's rules for one element that set display or visibility.

    Blocks inside other blocks, as of @media, depend on the reader and are passed over."""
    out = []
    source, at, depth, head = _COMMENT.sub(" ", source), 0, 0, ""
    for m in re.finditer(r"[{}]", source):
        part = source[at : m.start()]
        if m[0] == "{":
            head = part.rpartition(";")[2].strip() if depth == 0 else head
            depth += 1
        else:
            if depth == 1 and not head.startswith("@") and (found := _declared(part)):
                for selector in head.split(","):
                    one = _SIMPLE.fullmatch(selector.strip())
                    if one and selector.strip():
                        names = re.findall(r"[.#][\w-]+", one[2])
                        tag = (one[1] or "").lower().replace("*", "")
                        out.append((tag, frozenset(names), (sum(n[0] == "#" for n in names), sum(n[0] == "." for n in names), bool(tag), order, len(out)), found))
            depth = max(depth - 1, 0)
        at = m.end()
    return out


class Sheets:
    """The page's style rules under the id, class or tag that an element must have for them."""

    def __init__(self):
        self.under: dict[str, list] = {}
        self.count = 0

    def add(self, source: str) -> None:
        for rule in style_rules(source, self.count):
            key = next(iter(sorted(rule[1])), rule[0] or "*")
            self.under.setdefault(key, []).append(rule)
        self.count += 1

    def apply(self, node: Node) -> None:
        names = {f".{c}" for c in node.attrs.get("class", "").split()} | ({f"#{node.attrs['id']}"} if "id" in node.attrs else set())
        rules = [r for key in (*names, node.tag, "*") for r in self.under.get(key, ()) if r[1] <= names and r[0] in ("", node.tag)]
        said: dict[str, tuple[bool, tuple, str]] = {}
        for _, _, rank, found in rules:
            for name, (value, important) in found.items():
                said[name] = max(said.get(name, (False, (), "")), (important, rank, value))
        for name, (value, important) in _declared(node.attrs.get("style", "")).items():
            said[name] = max(said.get(name, (False, (), "")), (important, (9,) * 5 if important else (8, 9e9), value))
        if "display" in said and node.tag not in HIDDEN:
            node.gone = said["display"][2] == "none"
        if "visibility" in said:
            node.shown = said["visibility"][2] not in ("hidden", "collapse")


def _visibility(node: Node) -> None:
    """gone: not laid out at all; shown: True or False where the element says so, None where it is as its parent."""
    attrs = node.attrs
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or node.tag == "dialog" and "open" not in attrs or node.tag == "input" and attrs.get("type", "").lower() == "hidden":
        node.gone = True


class Builder:
    """The tree. Open elements are on a stack, and their places in it under their names, so that no lookup walks it."""

    def __init__(self):
        self.root, self.sheets = Node("html"), Sheets()
        #: elements in page order, which the sheets are applied to when all are known
        self.made: list[Node] = []
        self.stack, self.where = [self.root], {"html": [0]}
        #: places of open blocks, which the end tag of inline text doesn't reach beyond
        self.blocks = [0]

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Closes the open elements from this place on."""
        while len(self.stack) > max(at, 1):
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, wanted: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Closes the outermost of the wanted elements above the nearest of the bounds, and all inside it."""
        low = self.last(*bounds)
        found = [w[i] for w in (self.where.get(t, []) for t in wanted) if (i := bisect.bisect_right(w, low)) < len(w)]
        if found:
            self.cut(min(found))

    def add(self, kid: Node | str) -> None:
        """Puts kid where the page is. In a table but in no cell, that is in the table's own list of strays (its first kid)."""
        top = self.stack[-1]
        if top.tag == "table" or top.tag in SECTIONS or top.tag in ("tr", "colgroup"):
            table = self.last("table")
            if table >= 0 and not (isinstance(kid, Node) and kid.tag in STRUCTURE):
                if not isinstance(kid, str) or kid.strip():
                    self.stack[table].kids[0].kids.append(kid)
                return
        top.kids.append(kid)

    def structure(self, tag: str) -> None:
        """Goes back to where a part of a table belongs, and implies the row of a cell."""
        table = self.last("table")
        if tag in CELLS and tag != "caption":
            row = self.last("tr")
            if row > table:
                self.cut(row + 1)
                return
            self.cut(max(table, self.last(*SECTIONS)) + 1)
            row = Node("tr")
            self.add(row)
            self.push(row)
        elif tag == "tr":
            self.cut(max(table, self.last(*SECTIONS)) + 1)
        elif tag == "col":
            self.cut(max(table, self.last("colgroup")) + 1)
        else:
            self.cut(table + 1)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag in ("html", "body") and self.last(tag) >= (0 if tag == "html" else 1):
            return None
        if tag in BLOCK and (head := self.last("head")) > 0:
            self.cut(head)
        node = Node(tag, attrs)
        if attrs or tag == "dialog":
            _visibility(node)
        self.made.append(node)
        in_table = self.last("table") >= 0
        if tag in STRUCTURE and in_table:
            self.structure(tag)
        else:
            if tag in ENDS_P:
                self.close(("p",), ("table", *CELLS, "button", "object"))
            if tag in CLOSES:
                self.close(*CLOSES[tag])
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.cut(len(self.stack) - 1)
        self.add(node)
        if tag == "table":
            node.kids.append(Node("strays"))
        if tag == "img" and attrs.get("alt") and not node.gone:
            node.tag = "span"
            node.kids.append(attrs["alt"])
        elif tag == "form" and self.stack[-1].tag in ("table", "tr", *SECTIONS):
            pass  # such a form holds nothing
        elif tag not in VOID and not (closed and tag not in BLOCK):
            self.push(node)
        return node

    def styled(self) -> Node:
        """The finished tree: style rules are applied, and closed details keep their summary alone."""
        for node in self.made:
            if self.sheets.under or "style" in node.attrs:
                self.sheets.apply(node)
            if node.tag == "details" and "open" not in node.attrs:
                first = next((k for k in node.kids if isinstance(k, Node) and k.tag == "summary"), None)
                node.kids = [] if first is None else [first]
        return self.root

    def end(self, tag: str) -> None:
        if tag == "br":
            self.add(Node("br"))
            return
        at = self.last(*HEADINGS) if tag in HEADINGS else self.last(tag)
        if at < 1 or tag in ("html", "body"):
            return
        if tag == "table":
            self.cut(at)
        elif tag in STRUCTURE:
            if at > self.last("table") or self.last("table") < 0:
                self.cut(at)
        elif at > self.last("table", *CELLS) and (tag in BLOCK or at > self.blocks[-1] or tag in HIDDEN):
            self.cut(at)


def build(source: str) -> Node:
    """The tree of a page: end tags that nothing opened are ignored, elements are opened and closed where the rules or the end imply it."""
    made = Builder()
    at, size = 0, len(source)
    held = 0
    while at < size:
        at = source.find("<", at)
        if at < 0 or at + 1 == size:
            break
        mark = source[at + 1]
        slash = mark == "/"
        m = _NAME.match(source, at + 1 + slash)
        if m is None and not (slash or mark in "!?"):
            at += 1  # a bare sign
            continue
        if at > held:
            made.add(_unescaped(source[held:at]))
        if m is None:
            if source.startswith("<!--", at):
                # the signs of the opening may be those of the end, as in <!-->
                stop = source.find("-->", at + 2)
                at = stop + 3 if stop >= 0 else size
            else:
                stop = source.find(">", at + 2)
                at = stop + 1 if stop >= 0 else size
            held = at
            continue
        attrs, at, closed = _attributes(source, m.end())
        held = at
        if attrs is None:
            break
        tag = m[0].lower()
        if slash:
            made.end(tag)
            continue
        node = made.start(tag, attrs, closed)
        if tag == "plaintext":
            made.add(source[at:])
            return made.styled()
        if tag in RAW and node is not None:
            end = _ENDS.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)).search(source, at)
            stop = end.start() if end else size
            if tag in ("textarea", "title"):
                node.kids.append(_unescaped(source[at:stop]))
            elif tag == "style" and node.attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
                made.sheets.add(source[at:stop])
            made.cut(len(made.stack) - 1)
            at = _attributes(source, end.end())[1] if end else size
            held = at
    if held < size:
        made.add(_unescaped(source[held:]))
    return made.styled()


class Layout:
    """Lines of text, with pending line breaks; inline text is joined with single blanks.

    marks: of the open list items, those that no line has used yet are the last `fresh` ones; indent: width of the others."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.raw = self.broken = False
        self.marks: list[str] = []
        self.fresh = self.indent = 0

    def text(self, value: str, pre: bool) -> None:
        if pre or value.strip():
            self.broken = False
        if pre:
            self.raw = True
            head, *rest = value.split("\n")
            self.now.append(head)
            for x in rest:
                self.end(keep=True)
                self.raw = True
                self.now.append(x)
        else:
            self.now.append(_SPACE.sub(" ", value))

    def line(self, value: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if not value:
            self.lines.append("")
            return
        first = len(self.marks) - self.fresh
        self.lines.append(" " * min(self.indent, INDENT) + "".join(self.marks[first:]) + value if self.marks else value)
        self.indent += sum(map(len, self.marks[first:]))
        self.fresh = 0

    def end(self, keep: bool = False) -> None:
        if not self.now and not keep:
            return
        joined = "".join(self.now)
        value = joined.rstrip() if keep or self.raw else _BLANKS.sub(" ", joined).strip()
        self.now, self.raw = [], False
        if value or keep:
            self.line(value)

    def break_(self) -> None:
        """The end of a line; right after another one, an empty line."""
        self.gap = self.gap or self.broken
        self.end(keep=any(x.strip() for x in self.now))
        self.broken = True

    def space(self) -> None:
        self.end()
        self.broken = False
        # nothing stands between a list item's mark and its first line
        self.gap = self.gap or not self.fresh

    def block(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            if x:
                self.line(x)
            else:
                self.gap = True

    def open_item(self, mark: str) -> None:
        self.end()
        self.marks.append(mark)
        self.fresh += 1

    def close_item(self) -> None:
        self.end()
        mark = self.marks.pop()
        if self.fresh:
            self.fresh -= 1
        else:
            self.indent -= len(mark)
            self.gap = False


def _grid(rows: list[list[tuple[int, int, int, list[str]]]]) -> list[str]:
    """Lines of a table's rows of (column, columns, rows spanned, lines); columns are padded to their widest cell and parted by ' | '.

    All columns are aligned if that takes no more than ROOM blanks for each character and row; else the widest cells are
    left out of it, one width after another, until it does."""
    # columns where no cell begins have no width of their own
    columns = sorted({col for row in rows for col, *_ in row})
    rank = {c: i for i, c in enumerate(columns)}
    ends = lambda col, span: bisect.bisect_left(columns, col + span)
    needs = sorted({max(map(len, lines), default=0) for row in rows for *_, lines in row})
    tall = [max((len(lines) for *_, lines in row), default=0) for row in rows]
    room = ROOM * (sum(len(x) for row in rows for *_, lines in row for x in lines) + sum(tall) + len(rows))

    def reached(most: int) -> list[int]:
        width = [0] * len(columns)
        for wide in (False, True):
            reach = list(itertools.accumulate((w + 3 for w in width), initial=0))
            for row in rows:
                for col, span, _, lines in row:
                    need, end = max(map(len, lines), default=0), ends(col, span)
                    if need <= most and (end > rank[col] + 1) == wide:
                        held = reach[end - 1] - reach[rank[col]] if wide else 0
                        width[end - 1] = max(width[end - 1], need - held)
        return list(itertools.accumulate((w + 3 for w in width), initial=0))

    reach = reached(needs[-1] if needs else 0)
    if sum(n * (reach[ends(row[-1][0], 1) - 1] if row else 0) for n, row in zip(tall, rows, strict=True)) > room:
        lo, hi = 0, len(needs) - 1  # the widest cells that can be aligned, by halving
        while lo < hi:
            mid = (lo + hi + 1) // 2
            reach = reached(needs[mid])
            fits = sum(n * (reach[ends(row[-1][0], 1) - 1] if row else 0) for n, row in zip(tall, rows, strict=True)) <= room
            lo, hi = (mid, hi) if fits else (lo, mid - 1)
        reach = reached(needs[lo])
    out = []
    for n, row in zip(tall, rows, strict=True):
        for i in range(n):
            parts = []
            for k, (col, span, _, lines) in enumerate(row):
                x = lines[i] if i < len(lines) else ""
                parts.append(x if k + 1 == len(row) else x.ljust(reach[ends(col, span)] - reach[rank[col]] - 3))
            out.append(" | ".join(parts).rstrip())
    return out


def _placed(rows: list[list[tuple[Node, bool]]]) -> list[list[tuple[int, int, int, Node | None, bool]]]:
    """Cells with their columns: one that spans rows keeps its columns there, as an empty cell, up to DOWN of them for each cell."""
    out, down = [], {}
    room = DOWN * (sum(map(len, rows)) + len(rows) + 1000)
    for row in rows:
        cells, col, taken = [], 0, down
        room -= len(taken)
        if room < 0:
            taken = {}
        down = {}

        def carry(col, taken=taken):
            span, left = taken[col]
            if left > 1:
                down[col] = (span, left - 1)
            cells.append((col, span, 1, None, False))
            return col + span

        for node, shown in row:
            while col in taken:
                col = carry(col)
            span, deep = min(max(node.number("colspan", 1), 1), 1000), node.number("rowspan", 1)
            # as wide as the room before the next cell from above
            span = next((n for n in range(1, span) if col + n in taken), span) if taken else span
            deep = len(rows) if deep == 0 else max(deep, 1)
            cells.append((col, span, deep, node, shown))
            if deep > 1:
                down[col] = (span, deep - 1)
            col += span
        for c in sorted(c for c in taken if c >= col):
            carry(c)
        out.append(cells)
    return out


def _render(root: Node) -> list[str]:
    """Lines of the tree. Work to do is a stack of (what, node or other, layout, shown, preformatted, list, tables around)."""
    top = Layout()
    work: list[tuple] = [("kids", root, top, True, False, None, 0)]
    while work:
        what, node, out, shown, pre, items, deep = work.pop()
        if what == "kids":
            # numbers of the list that these are the items of
            counter = [node.tag, node.number("start", 1)]
            work += [("kid", k, out, shown, pre, counter, deep) for k in reversed(node.kids)]
        elif what == "do":
            node(out)
        elif isinstance(node, str):
            if shown:
                out.text(node, pre)
        elif not node.gone:
            shown = shown if node.shown is None else node.shown
            tag, inside = node.tag, ("kids", node, out, shown, pre or node.tag == "pre", None, deep)
            if tag == "br":
                out.break_()
            elif tag == "hr":
                out.space()
            elif tag == "table":
                out.space()
                work.append(("do", Layout.space, out, shown, pre, None, deep))
                if deep < TABLES:
                    _lay_table(node, out, shown, deep, work)
                else:
                    work.append(inside)
            elif tag == "li":
                mark = "- "
                if items[0] == "ol":
                    number = node.number("value", items[1])
                    items[1] = number + 1
                    mark = f"{number}. "
                out.open_item(mark)
                work += [("do", Layout.close_item, out, shown, pre, None, deep), inside]
            elif tag in BLOCK or tag == "strays":
                # lists inside a list item stay close to it
                loose = tag in SPACED and not (tag in ("ul", "ol") and items[0] == "li")
                after = Layout.space if loose else Layout.end
                after(out)
                work += [("do", after, out, shown, pre, None, deep), inside]
            else:
                work.append(inside)
    top.end()
    return top.lines


def _lay_table(table: Node, out: Layout, shown: bool, deep: int, work: list[tuple]) -> None:
    """Puts the parts of a table on the work stack: caption, strays and cells have layouts of their own, which make a block at last."""
    before: list[Layout] = []
    todo: list[tuple] = []

    def own(node: Node, seen: bool, pre: bool = False) -> Layout:
        lay = Layout()
        todo.append(("kids", node, lay, seen, pre, None, deep + 1))
        return lay

    seen = lambda node, outer: outer if node.shown is None else node.shown
    rows: list[list[tuple[Node, bool]]] = []
    for part in table.kids[1:]:
        if isinstance(part, str) or part.gone:
            continue
        if part.tag == "caption":
            before.append(own(part, seen(part, shown)))
        for row in [part] if part.tag == "tr" else part.kids if part.tag in SECTIONS else []:
            if not isinstance(row, str) and row.tag == "tr" and not row.gone:
                vis = seen(row, seen(part, shown))
                rows.append([(c, seen(c, vis)) for c in row.kids if not isinstance(c, str) and not c.gone and c.tag in CELLS])
    for kid in table.kids[0].kids:
        holder = Node("div")
        holder.kids = [kid]
        before.append(own(holder, shown))
    laid = [[(col, span, down, None if cell is None else own(cell, vis)) for col, span, down, cell, vis in row] for row in _placed(rows)]

    def finish(to: Layout) -> None:
        lines = []
        for lay in before:
            lay.end()
            lines += [x for x in lay.lines if x]
        grid = []
        for row in laid:
            for cell in row:
                if cell[3] is not None:
                    cell[3].end()
            grid.append([(col, span, down, [] if lay is None else [x for x in lay.lines if x]) for col, span, down, lay in row])
        to.block(lines + _grid([r for r in grid if any(c[3] for c in r)]))

    work.append(("do", finish, out, shown, False, None, deep))
    work += reversed(todo)


def page_text(source: str | None) -> str:
    """All visible text of a page; empty for null or empty source."""
    return "\n".join(_render(build(source))) if source else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, html, ...) -> page_id, text, n_lines, n_chars.

    Null or empty html: empty text, no lines. Broken markup is repaired as browsers do, and text in a table but in no
    cell stands before its rows. Hidden elements are left out: by tag, attribute or style; visibility is inherited and
    can be turned on again inside. Rows that repeat are rendered each; a null page_id stays null; an empty table gives
    an empty result; other columns are ignored, whatever their names."""

    def run(batches):
        for b in batches:
            texts = [page_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")
