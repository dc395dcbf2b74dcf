"""HTML extraction by layout: a tree with implied tags, visibility rules, and text with blocks, lists and aligned table cells."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object canvas audio video datalist rp defs symbol clippath mask marker pattern metadata desc".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody thead tfoot tr ul center caption".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: A start tag ends these open elements, up to the nearest of the scopes.
IMPLIED_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
ENDS_P = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption"}
#: What may stand in a head; any other tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template head".split())
#: Elements of other languages, in which a self-closed tag has no content, and those in them that hold HTML again.
FOREIGN = frozenset({"svg", "math"})
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Parents that a start tag implies inside a table.
IMPLIED_PARENTS = {"td": "tr", "th": "tr"}
#: What keeps a start tag from ending a paragraph outside of it, an end tag from ending what is outside of its cell, and the end tags that do so all the same.
_ENDS_P_SCOPE = frozenset({"table", "td", "th", "button", "body"} | (BLOCK - {"p"}))
_CELL_SCOPE = ("table", "td", "th")
_ENDS_CELLS = frozenset("table tr tbody thead tfoot body html".split())
_NOUGHT = re.compile(r"[-+]?0*\.?0+%?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: The most columns that a cell spans, by the HTML standard, and how far cells are padded to align their column: wider ones stand out, whole.
MOST_COLUMNS = 1000
ALIGN = 60
MOST_ROWS = 65534
#: Kinds of input whose value, or else placeholder, is painted.
TEXT_INPUTS = frozenset("text search tel url email number date time month week datetime-local".split())
#: Elements that have their own place in a table.
TABLE_PARTS = frozenset("caption tbody thead tfoot tr td th".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "mute", "cells")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: whether it is a part of an svg whose own text isn't painted; whether it holds visible rows or cells of the table that it stands in
        self.mute = self.cells = False

    def style(self) -> dict[str, str]:
        """The last value of each property."""
        parts = (d.partition(":") for d in (self.attrs.get("style") or "").split(";"))
        return {name.strip().lower(): value.lower().replace("!important", "").strip() for name, _, value in parts}

    def visible(self) -> bool:
        """Whether the element is laid out and painted with all it holds."""
        a = self.attrs
        if self.tag in HIDDEN or "hidden" in a or (self.tag == "dialog" and "open" not in a) or (self.tag == "input" and (a.get("type") or "").lower() == "hidden"):
            return False
        style = self.style() if a.get("style") else {}
        return style.get("display") != "none" and not _NOUGHT.fullmatch(style.get("opacity", ""))

    def shown(self, outer: bool) -> bool:
        """Whether its own text is painted, which elements take over from what they stand in unless they say otherwise."""
        value = self.style().get("visibility") if self.attrs.get("style") else None
        return outer if value in {None, "inherit", ""} else value not in {"hidden", "collapse"}


    def laid_out(self) -> list:
        """Its children; of a closed details element, the first summary alone."""
        if self.tag != "details" or "open" in self.attrs:
            return self.children
        return [c for c in self.children if isinstance(c, Node) and c.tag == "summary"][:1]


class Tree(HTMLParser):
    """Builds nodes; closes what a tag implies, ignores end tags without a start, and takes an element left open as ending with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open: list[Node] = [self.root]
        #: where the open elements of each tag stand among all open ones, so that no tag makes the parser look through them
        self.at: dict[str, list[int]] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in IN_HEAD:
            self._end_head()
        if tag == "select" and self.at.get(tag):
            self._end({tag}, (), inner=True)
            return
        if tag in ENDS_P:
            self._end({"p"}, _ENDS_P_SCOPE, inner=True)
        if tag in IMPLIED_ENDS:
            self._end(*IMPLIED_ENDS[tag])
        if tag in IMPLIED_PARENTS and self.open[-1].tag in {"table", "tbody", "thead", "tfoot"}:
            self._add(Node(IMPLIED_PARENTS[tag], {}))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._add(node)
        if tag in {"textarea", "plaintext"}:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag, attrs):
        parent = self.open[-1]
        self.handle_starttag(tag, attrs)
        if self.open[-1] is not parent and self.open[-1].tag == tag and (tag in FOREIGN or self._foreign()):
            self._close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self._end_head()
            self.open[-1].children.append(Node("br", {}))
        if tag == "plaintext":
            self.open[-1].children.append("</plaintext>")
            self.set_cdata_mode(tag)
            return
        k = self._last({tag})
        if k and (tag in _ENDS_CELLS or self._last(_CELL_SCOPE) <= k):
            self._close_from(k)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def close(self):
        if self.rawdata.startswith("<!--") and not self.cdata_elem:
            self.rawdata = ""  # a comment without an end holds all that follows
        super().close()
        if self.cdata_elem in {"textarea", "plaintext"} and self.rawdata:
            self.handle_data(self.rawdata)

    def handle_data(self, data):
        if self.cdata_elem == "textarea":
            data = entities.unescape(re.sub(r"\A\r?\n", "", data))
        if data.strip(" \t\n\r\f"):
            self._end_head()
        self.open[-1].children.append(data)

    def _add(self, node):
        parent = self.open[-1]
        parent.children.append(node)
        node.mute = node.tag == "svg" or (parent.mute and node.tag not in {"text", "foreignobject"})
        if node.tag in TABLE_PARTS and node.visible():
            for n in reversed(self.open):
                if n.cells or n.tag == "table" or not n.visible():
                    break
                n.cells = True
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _close_from(self, k: int):
        for n in self.open[k:]:
            self.at[n.tag].pop()
        del self.open[k:]

    def _last(self, tags, before: int = 1 << 60) -> int:
        """The place of the innermost open element with one of these tags, 0 if there is none; of those before a place, at most the last of each tag is skipped."""
        found = 0
        for tag in tags:
            places = self.at.get(tag)
            if places:
                k = places[-1] if places[-1] < before else places[-2] if len(places) > 1 else 0
                found = max(found, k)
        return found

    def _end_head(self):
        if self.open[-1].tag == "head":
            self._close_from(len(self.open) - 1)

    def _foreign(self) -> bool:
        """Whether the innermost open element stands in svg or math, and in no element of them that holds HTML."""
        return self._last(FOREIGN, len(self.open) - 1) > self._last(HTML_AGAIN, len(self.open) - 1)

    def _end(self, tags, scope, inner=False):
        k = self._last(tags)
        if not k or self._last(scope) > k:
            return
        while not inner and k > 1 and self.open[k - 1].tag in tags:
            k -= 1
        self._close_from(k)


class _Lines:
    """Text in lines: inline text is joined by single blanks, blocks start new lines, and at most one empty line stays between them."""

    def __init__(self):
        self.lines, self.now, self.gap, self.indent, self.mark = [], "", False, "", ""

    def text(self, data: str, pre: bool):
        if pre:
            for k, line in enumerate(data.split("\n")):
                if k:
                    self.break_(keep=True)
                self.now += line
            return
        data = _SPACE.sub(" ", data)
        if not self.now or self.now.endswith(" "):
            data = data.lstrip(" ")
        self.now += data

    def break_(self, keep: bool = False):
        if self.now.strip() or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.mark or self.indent) + self.now.rstrip(" "))
            self.mark = ""
        self.now = ""

    def space(self):
        self.break_()
        self.gap = True

    def raw(self, lines: list[str]):
        for line in lines:
            self.now = line
            self.break_(keep=True)


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _run(steps):
    """Runs a generator that yields generators to be run before it goes on: recursion of any depth."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _span(value: str | None, most: int) -> int:
    number = re.match(r"\s*\+?0*([0-9]+)", value or "", re.A)
    return min(int(number[1][:9]), most) if number else 1


class _Row:
    """Cells with their columns; the columns from `next` on are free, but for those that cells of earlier rows reach down into."""

    def __init__(self):
        self.cells, self.next = [], 0


def _table(node: Node, seen: bool) -> list[str]:
    """Rows of cells, padded so that columns are aligned; an inner table's text goes into its cell, joined by blanks.

    A cell that spans columns or rows keeps them free; spans of rows end with their section. What stands in no cell has a cell of its own if it is in a row, else a row;
    wrappers are looked into for their rows and cells.
    """
    rows: list[_Row] = []
    taken: dict[int, int] = {}  # columns, and the row up to which a cell above has them
    stray = Node("div", {})

    def cell(n: Node, seen: bool) -> str:
        return " ".join(render(n, True, seen).split())

    def put(row: _Row, text: str, columns: int = 1, down: int = 1):
        while taken.get(row.next, 0) >= len(rows):
            row.next += 1
        row.cells.append((row.next, text))
        if down > 1:
            taken.update((k, len(rows) + down - 1) for k in range(row.next, row.next + columns))
        row.next += columns

    def new_row() -> _Row:
        rows.append(_Row())
        return rows[-1]

    def end_stray(row: _Row | None, seen: bool):
        text = cell(stray, seen)
        stray.children.clear()
        if text:
            put(new_row() if row is None else row, text)

    def collect(n: Node, row: _Row | None, seen: bool):
        for c in n.laid_out():
            if not isinstance(c, Node):
                stray.children.append(c)
                continue
            if not c.visible():
                continue
            inside = c.tag in TABLE_PARTS
            if not inside and (c.tag == "table" or not c.cells):
                stray.children.append(c)
                continue
            end_stray(row, seen)
            own = c.shown(seen)
            if c.tag in {"td", "th"}:
                row = row or new_row()
                down = _span(c.attrs.get("rowspan"), MOST_ROWS)
                put(row, cell(c, own), max(1, _span(c.attrs.get("colspan"), MOST_COLUMNS)), down or MOST_ROWS)
            elif c.tag == "caption":
                put(new_row(), cell(c, own))
            elif c.tag == "tr":
                yield collect(c, new_row(), own)
            else:
                if inside:
                    taken.clear()
                yield collect(c, None if inside else row, own)
                if inside:
                    taken.clear()
        end_stray(row, seen)

    _run(collect(node, None, seen))
    widths: dict[int, int] = {}
    for row in rows:
        for k, text in row.cells if len(row.cells) > 1 or row.next > 1 else ():
            widths[k] = max(widths.get(k, 0), min(_width(text), ALIGN))
    starts, wide = {}, 0
    for k in sorted(widths):
        starts[k] = wide + 2 * k  # a column without text takes two blanks
        wide += widths[k]
    lines = []
    for row in rows:
        line, wide = "", 0
        for k, text in row.cells:
            if text:
                blanks = max(starts.get(k, 0) - wide, 2 if line else 0)
                line, wide = line + " " * blanks + text, wide + blanks + _width(text)
        if row.cells:
            lines.append(line)
    return lines


def _shown_options(select: Node) -> list[str]:
    """A list box shows all its groups and options that are not hidden; a closed list the option last selected, or else its first enabled one."""
    a = select.attrs
    size = (a.get("size") or "").strip()
    box = "multiple" in a or (size.isascii() and size.isdigit() and int(size[:9]) > 1)
    chosen = first = None
    shown: list[str] = []
    left = [(c, False) for c in reversed(select.children)]
    while left:
        c, off = left.pop()
        if not isinstance(c, Node) or (box and not c.visible()):
            continue
        off = off or (c.tag in {"option", "optgroup"} and "disabled" in c.attrs)
        label = (c.attrs.get("label") or "").strip()
        if c.tag != "option":
            if c.tag == "optgroup" and label:
                shown.append(label)
            left += [(x, off) for x in reversed(c.children)]
            continue
        shown.append(label or " ".join(render(c).split()))
        if "selected" in c.attrs:
            chosen = shown[-1]
        if first is None and not off:
            first = shown[-1]
    return shown if box else [x for x in (first if chosen is None else chosen,) if x]


def _number(value: str | None, otherwise: int) -> int:
    found = re.match(r"[ \t\n\r\f]*([-+]?[0-9]{1,9})(?![0-9])", value or "")
    return int(found[1]) if found else otherwise


def _walk(node: Node, out: _Lines, pre: bool, in_table: bool, seen: bool):
    if not node.visible():
        return
    tag, seen = node.tag, node.shown(seen)
    if tag == "br":
        if seen:
            out.break_(keep=True)
        return
    if tag == "img":
        return
    if tag == "select":
        options = _shown_options(node) if seen else []
        for option in options:
            if len(options) > 1:
                out.break_()
            out.text(option, False)
        if len(options) > 1:
            out.break_()
        return
    if tag in SPACED and not (tag in {"ul", "ol"} and out.indent):
        out.space()
    elif tag in BLOCK:
        out.break_()
    if tag == "hr":
        out.space()
        return
    if tag == "input":
        kind, value = (node.attrs.get("type") or "text").lower(), node.attrs.get("value") or ""
        if seen and kind in {"submit", "button", "reset"}:
            out.text(value, False)
        elif seen and kind in TEXT_INPUTS:
            out.text(f" {value or node.attrs.get('placeholder') or ''} ", False)
        return
    if tag == "table" and not in_table:
        out.raw(_table(node, seen))
        out.space()
        return
    if tag in {"td", "th", "text"}:
        out.text(" ", False)
    pre = pre or tag in {"pre", "textarea", "plaintext"}
    outer, step = out.indent, 1
    if tag == "ol":
        step = -1 if "reversed" in node.attrs else 1
        number = _number(node.attrs.get("start"), 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" and c.visible() for c in node.children)) - step
    if tag in {"ul", "ol", "blockquote", "dd"}:
        out.indent += "  "
    for child in node.laid_out():
        if isinstance(child, str):
            if seen and not node.mute:
                out.text(child, pre)
            continue
        if child.tag == "li" and child.visible():
            out.break_()
            if tag == "ol":
                number = _number(child.attrs.get("value"), number + step)
            out.mark = out.indent + (f"{number}. " if tag == "ol" else "- ")
        yield _walk(child, out, pre, in_table, seen)
        if child.tag == "li":
            out.break_()
            out.mark = ""
    if tag in {"td", "th", "text"}:
        out.text(" ", False)
    out.indent = outer
    if tag in SPACED and not (tag in {"ul", "ol"} and outer):
        out.space()
    elif tag in BLOCK:
        out.break_()


def render(node: Node, in_table: bool = False, seen: bool = True) -> str:
    out = _Lines()
    for child in node.laid_out():
        if isinstance(child, Node):
            _run(_walk(child, out, False, in_table, seen))
        elif seen:
            out.text(child, node.tag == "pre")
    out.break_()
    return "\n".join(out.lines)


def html_text(html: str | None) -> str | None:
    """All visible text of a page, as it would be laid out; None for None."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    return render(tree.root)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of pages.

    Pages become trees in which omitted end tags and table rows are implied; elements that are hidden by their kind, `hidden` or
    their own style, closed dialogs and what closed details hold but their summary go with all they hold; in one of no visibility, a part that is visible again stays. aria-hidden elements are painted and stay. Of an svg, its text elements stay. Of form controls, the text of a textarea, the value or placeholder of a text field, the captions of input buttons and the options that a closed list or list box shows stay. Blocks start on new lines, headings, paragraphs, lists and tables stand between empty lines, list
    items have marks, numbered as `start`, `reversed` and `value` say, cells are padded to their columns, which spans of columns and rows keep free (up to ALIGN places; longer cells stay whole), what stands in a table but in no cell has a cell or row of its own, `pre` keeps its blanks.

    Result, a row per input row: `id_col`, text (null for null, empty for pages without visible text). Malformed pages never fail: what can't be a tag is text. Repeated rows stay. Other
    columns are not looked at. An empty table gives no rows.
    """

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(html_text, na_action="ignore").astype(object)

    return pages.select(F.col(id_col), text(F.col(html_col)).alias("text"))
