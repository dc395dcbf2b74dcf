"""Web pages as rows of nodes: what a page's markup holds, with the place of each element in the tree."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
SILENT = ("script", "style", "title")
#: A start tag ends open elements of the first tags, unless one of the second stands between; other blocks end a paragraph.
IMPLIED_ENDS = {
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    "tr": (("tr", "td", "th"), ("table",)),
    "li": (("li",), ("ul", "ol", "menu")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_P_SCOPE = ("table", "td", "th", "button", "body")

_NODE = [("node", "int"), ("parent", "int"), ("last", "int"), ("tag", "string"), ("attrs", "map<string, string>"), ("form", "int"), ("label", "int"), ("choice", "int"), ("prev", "int"), ("place", "int"), ("siblings", "int"), ("begins", "int"), ("ends", "int"), ("bare_begins", "int"), ("bare_ends", "int")]
_ARROW = {"int": pa.int32(), "string": pa.string(), "map<string, string>": pa.map_(pa.string(), pa.string())}


class _Walker(HTMLParser):
    """Notes each element once, in document order. Open elements are found by tag, so no tag makes it look through them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.at: dict[str, list[int]] = {}
        self.last: dict[int, dict] = {}
        self.text, self.bare, self.n_text, self.n_bare = [], [], 0, 0

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _inner(self, *tags: str) -> int:
        """One more than the place of the innermost open element of these tags, 0 without any."""
        return max((self.at[t][-1] + 1 for t in tags if self.at.get(t)), default=0)

    def _nearest(self, tag: str) -> int | None:
        k = self._inner(tag)
        return self.open[k - 1]["node"] if k else None

    def _close_from(self, k: int) -> None:
        for n in self.open[k:]:
            self.at[n["tag"]].pop()
            n["last"], n["ends"], n["bare_ends"] = len(self.nodes) - 1, self.n_text, self.n_bare
            self.last.pop(n["node"], None)
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        ends, scope = IMPLIED_ENDS.get(tag, (("p",), _P_SCOPE) if tag in BLOCKS else ((), ()))
        k = self._inner(*ends)
        if k and self._inner(*scope) < k:
            while k > 1 and tag not in BLOCKS and self.open[k - 2]["tag"] in ends:
                k -= 1
            self._close_from(k - 1)
        up = self.open[-1]["node"] if self.open else None
        before = self.last.get(up)
        node = {"node": len(self.nodes), "parent": up, "last": len(self.nodes), "tag": tag, "attrs": [(k, v or "") for k, v in dict(reversed(attrs)).items()], "form": self._nearest("form"), "label": self._nearest("label"), "choice": self._nearest("select"), "prev": before and before["node"], "place": before["place"] + 1 if before else 1, "begins": self.n_text, "ends": self.n_text, "bare_begins": self.n_bare, "bare_ends": self.n_bare}
        self.nodes.append(node)
        self.last[up] = node
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag):
        k = self._inner(tag)
        if k:
            self._close_from(k - 1)

    def handle_data(self, data):
        if self._inner(*SILENT):
            return
        self.text.append(data)
        self.n_text += len(data)
        if not self._inner("select", "textarea"):
            self.bare.append(data)
            self.n_bare += len(data)

    def finish(self) -> tuple[str, str, list[dict]]:
        self.close()
        self._close_from(0)
        size: dict[int | None, int] = {}
        for n in self.nodes:
            size[n["parent"]] = n["place"]
        for n in self.nodes:
            n["siblings"] = size[n["parent"]]
        return "".join(self.text), "".join(self.bare), self.nodes


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(name, _ARROW[t]) for name, t in _NODE]))
    for batch in batches:
        for k in range(batch.num_rows):
            walker = _Walker()
            walker.feed(batch.column(1)[k].as_py() or "")
            text, bare, nodes = walker.finish()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text]), pa.array([bare]), pa.array([nodes], kind)], ["page_id", "page_text", "bare_text", "nodes"])


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, page_text (without scripts, styles and titles), bare_text (without the text of fields too) and its nodes in document order.

    A node has its number, its parent's and that of the last node within it; tag; attributes (the first of each name); the numbers of the form, label and select that enclose it, and of the element
    before it; its place among its siblings, and their number; and the places in page_text and bare_text where its text begins and ends. End tags that may be
    left out are implied, those without a start are ignored. Null pages have no nodes; repeated rows stay; markup of any kind is read to its end.
    """
    kind = dict(pages.dtypes)[id_col]
    schema = f"page_id {kind}, page_text string, bare_text string, nodes array<struct<{', '.join(f'{n}: {t}' for n, t in _NODE)}>>"
    return pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").alias("html")).mapInArrow(_parse, schema)


def attribute(name: str) -> Column:
    """A node's attribute; null if it has none of that name."""
    return F.element_at("attrs", name)


def own_text(begins: Column, ends: Column) -> Column:
    return F.regexp_replace(F.substring("page_text", begins + 1, ends - begins), r"^\s+|\s+\z", "")


def style_of(name: str) -> Column:
    """The last value of a property in the style attribute, in lower case; empty if it isn't there."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(attribute("style"), F.lit("")), rf"(?is)^(?:.*;)?\s*{name}\s*:\s*([^;!]*)", 1)))


def number_of(text: Column) -> Column:
    """The number at the beginning of a text; null if there is none."""
    return F.regexp_extract(text, r"^\s*([-+]?[0-9]{0,15}\.?[0-9]{0,15})", 1).try_cast("double")


def unseen() -> Column:
    """Whether a node's own markup hides it, with all it holds."""
    hidden_field = (F.col("tag") == "input") & (F.lower(F.coalesce(attribute("type"), F.lit(""))) == "hidden")
    return attribute("hidden").isNotNull() | hidden_field | (attribute("style").isNotNull() & ((style_of("display") == "none") | (style_of("visibility") == "hidden") | F.coalesce(number_of(style_of("opacity")) < 0.1, F.lit(False))))


#: What makes an element interactive.
TAGS = ("button", "input", "select", "textarea")
ROLES = ("button", "link", "tab", "checkbox", "radio", "switch", "combobox")


def interactive() -> Column:
    role, editable = F.coalesce(attribute("role"), F.lit("")), F.coalesce(attribute("contenteditable"), F.lit(""))
    return ((F.col("tag") == "a") & attribute("href").isNotNull()) | F.col("tag").isin(*TAGS) | role.isin(*ROLES) | (editable == "true") | attribute("tabindex").isNotNull()


def clickable() -> Column:
    """Whether a node is a button, link, tab or menu item."""
    return F.col("tag").isin("button", "a") | F.coalesce(attribute("role").isin("button", "link", "tab", "menuitem"), F.lit(False))


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per node of parse_pages(), with the text, trimmed, of those that are clickable(), the `for` of the label that encloses it (label_for), and whether markup leaves it visible.

    An element is hidden if one that encloses it is: the last nodes within hidden elements, as a running maximum over the page, tell. Also ord, the number of an interactive element that is visible
    among those of its page, from 0 on. One shuffle, by page.
    """
    rows = parse_pages(pages, id_col, html_col)
    rows = rows.select("page_id", "page_text", "nodes", F.inline("nodes"))
    enclosing = F.try_element_at("nodes", F.col("label") + 1)
    rows = rows.select("page_id", *(n for n, _ in _NODE if "begins" not in n and "ends" not in n), F.when(clickable(), own_text(F.col("begins"), F.col("ends"))).alias("text"), F.element_at(enclosing["attrs"], "for").alias("label_for"), unseen().alias("_unseen"), interactive().alias("_interactive"))
    return visible_nodes(rows)


def visible_nodes(rows: DataFrame) -> DataFrame:
    """Adds visible and ord to rows (page_id, node, last, _unseen, _interactive)."""
    page = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("visible", F.coalesce(F.max(F.when(F.col("_unseen"), F.col("last"))).over(page) < F.col("node"), F.lit(True)))
    shown = F.col("_interactive") & F.col("visible")
    return rows.withColumn("ord", F.when(shown, F.count_if(shown).over(page) - 1).cast("int")).drop("_unseen", "_interactive")
