"""Interactive elements, form fields and page states from the nodes of web pages: labels, roles, values and traps are columns over the nodes of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privlake.sources.nodes import attribute, interactive, number_of, parse_pages, style_of, unseen

#: Elements before a field whose text is taken for its label, and names of fields that are traps.
LABELLING = ("label", "span", "div", "p")
TRAP = r"(?i)captcha|trap|bot|honeypot|cf-|wp-"
#: Signs of challenges in markup and of payment in text, and how much of the text a page state holds.
CHALLENGE = r"(?i)recaptcha|hcaptcha|turnstile|cf-challenge"
PAYMENT = r"(?i)payment|card number|cvv|expiry|billing"
STATE_TEXT = 5000


def _text(n: Column, page: str = "page_text", begins: str = "begins", ends: str = "ends") -> Column:
    return F.regexp_replace(F.substring(page, n[begins] + 1, n[ends] - n[begins]), r"^\s+|\s+\z", "")


def _given(name: str) -> Column:
    """A node's attribute; null if it is empty."""
    return F.nullif(attribute(name), F.lit(""))


def _pages(pages: DataFrame) -> DataFrame:
    """parse_pages() with the labels of each page that name a field, and what they name."""
    named = F.filter("nodes", lambda n: (n["tag"] == "label") & (F.element_at(n["attrs"], "for") != ""))
    return parse_pages(pages).withColumn("labels", named).withColumn("named", F.transform("labels", lambda n: F.element_at(n["attrs"], "for")))


def _label() -> Column:
    """A node's label: the first label that names it, or the text of the one that encloses it but for fields' text, or of the element just before it, or its own attributes."""
    node = lambda k: F.try_element_at("nodes", F.col(k) + 1)
    at = F.coalesce(F.array_position("named", _given("id")), F.lit(0))
    around = F.nullif(_text(node("label"), "bare_text", "bare_begins", "bare_ends"), F.lit(""))
    before = F.when(F.col("prev").isNotNull() & node("prev")["tag"].isin(*LABELLING), _text(node("prev")))
    return F.when(at > 0, _text(F.try_element_at("labels", at.cast("int")))).otherwise(F.coalesce(around, before, _given("aria-label"), _given("placeholder"), F.lit("")))


def _role() -> Column:
    kind, tag = F.lower(F.coalesce(attribute("type"), F.lit(""))), F.col("tag")
    of_input = F.when(kind == "submit", "button").when(kind.isin("checkbox", "radio"), kind).otherwise("textbox")
    return F.when(tag == "a", "link").when(tag == "button", "button").when(tag == "input", of_input).when(tag == "select", "combobox").when(tag == "textarea", "textbox").otherwise("generic")


def page_elements(pages: DataFrame) -> DataFrame:
    """Interactive elements of each page in order: page_id, ord, id, tag, role, text of at most 150 characters, label, type, disabled, and whether markup leaves them visible.

    Null pages have none. One shuffle, by page, in which nodes that aren't interactive are their numbers alone.
    """
    rows = _pages(pages).select("page_id", "page_text", "bare_text", "nodes", "labels", "named", F.inline("nodes"))
    own = F.struct(F.col("begins"), F.col("ends"))
    text = F.coalesce(_given("aria-label"), _given("title"), _given("placeholder"), F.left(_text(own), F.lit(150)))
    found = F.struct(_given("id").alias("id"), "tag", F.coalesce(_given("role"), _role()).alias("role"), text.alias("text"), _label().alias("label"), F.coalesce(attribute("type"), F.lit("")).alias("type"), attribute("disabled").isNotNull().alias("disabled"))
    rows = rows.select("page_id", "node", "last", unseen().alias("unseen"), F.when(interactive(), found).alias("e"))
    page = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("visible", F.coalesce(F.max(F.when(F.col("unseen"), F.col("last"))).over(page) < F.col("node"), F.lit(True))).withColumn("ord", (F.count("e").over(page) - 1).cast("int"))
    return rows.where("e is not null").select("page_id", "ord", F.coalesce("e.id", F.concat(F.lit("el-"), F.col("ord").cast("string"))).alias("id"), "e.tag", "e.role", "e.text", "e.label", "e.type", "e.disabled", "visible")


def page_fields(pages: DataFrame) -> DataFrame:
    """Inputs, selects and text areas of each page's forms, as operators.forms takes them; `trap` marks fields that people never see.

    A field belongs to the form that its `form` attribute names, or else to the one that encloses it; those of no form are left out. Null pages have none. Narrow: a page's nodes are one array.
    """
    rows = _pages(pages).withColumn("forms", F.filter("nodes", lambda n: n["tag"] == "form"))
    rows = rows.withColumn("form_ids", F.transform("forms", lambda n: F.coalesce(F.element_at(n["attrs"], "id"), F.lit("")))).withColumn("form_nodes", F.transform("forms", lambda n: n["node"]))

    def owner(n: Column) -> Column:
        """Which form a field belongs to, counted from 1; 0 for none."""
        named = F.element_at(n["attrs"], "form")
        return F.coalesce(F.when(named != "", F.array_position("form_ids", named)).otherwise(F.array_position("form_nodes", n["form"])), F.lit(0))

    fields = F.filter("nodes", lambda n: n["tag"].isin("input", "select", "textarea") & (owner(n) > 0))
    rows = rows.select("page_id", "page_text", "bare_text", "nodes", "labels", "named", "form_ids", "form_nodes", F.posexplode(fields).alias("ord", "f"))
    rows = rows.withColumn("at", owner(F.col("f")).cast("int")).select("*", "f.*")
    options = F.filter(F.slice("nodes", F.col("node") + 2, F.col("last") - F.col("node")), lambda n: n["tag"] == "option")
    options = F.transform(options, lambda n: F.struct(_text(n).alias("text"), F.element_at(n["attrs"], "value").alias("value"), F.element_at(n["attrs"], "selected").isNotNull().alias("on")))
    rows = rows.withColumn("opts", options)
    picked = F.coalesce(F.try_element_at(F.filter("opts", lambda o: o["on"]), F.lit(1)), F.try_element_at("opts", F.lit(1)))
    value = F.when(F.col("tag") == "textarea", _text(F.col("f"))).when(F.col("tag") == "select", F.coalesce(picked["value"], picked["text"])).otherwise(attribute("value"))
    kind = F.coalesce(_given("type"), F.col("tag"))
    checkable, checked = F.lower(kind).isin("checkbox", "radio"), attribute("checked").isNotNull()
    far = lambda side: F.coalesce(number_of(style_of(side)) < -9999, F.lit(False))
    away = (style_of("position") == "absolute") & (far("left") | far("top"))
    length = F.coalesce(number_of(attribute("maxlength")), F.lit(0.0))
    rows = rows.withColumn("value", F.coalesce(value, F.lit("")))
    return rows.select(
        "page_id", F.coalesce(F.nullif(F.element_at("form_ids", F.col("at")), F.lit("")), F.concat(F.lit("form-"), (F.col("at") - 1).cast("string"))).alias("form_id"), "ord", F.coalesce(attribute("name"), F.lit("")).alias("name"), F.coalesce(attribute("id"), F.lit("")).alias("id"),
        kind.alias("type"), _label().alias("label"), "value", attribute("required").isNotNull().alias("required"), F.greatest(F.lit(0.0), F.least(length, F.lit(2.0**31 - 1))).cast("int").alias("max_length"), F.coalesce(attribute("pattern"), F.lit("")).alias("pattern"),
        F.transform("opts", lambda o: o["text"]).alias("options"), F.when(checkable, checked).alias("checked"), F.when(checkable, checked).otherwise(F.col("value") != "").alias("filled"), (away | F.coalesce(_given("name"), _given("id"), F.lit("")).rlike(TRAP)).alias("trap"),
    )


def page_states(pages: DataFrame) -> DataFrame:
    """A row per page: url, text (its first 5,000 characters), numbers of forms, elements and interactive elements, and signs of challenges, traps, uploads and payments. Null pages have zeros. Narrow."""
    # the parse keeps an id and what it makes, so other columns of the page are a part of the id
    rows = parse_pages(pages.select(F.struct("page_id", "url", "html").alias("of"), "html"), id_col="of")
    a = lambda n, name: F.element_at(n["attrs"], name)
    usable = lambda n: ((n["tag"] == "a") & a(n, "href").isNotNull()) | n["tag"].isin("button", "input", "select", "textarea") | a(n, "tabindex").isNotNull() | F.coalesce(a(n, "role"), F.lit("")).isin("button", "link", "tab", "checkbox", "radio", "switch", "combobox") | (F.coalesce(a(n, "contenteditable"), F.lit("")) == "true")
    trap = lambda n: n["tag"].isin("input", "textarea") & F.coalesce(F.nullif(a(n, "name"), F.lit("")), a(n, "id"), F.lit("")).rlike(TRAP)
    return rows.select(
        "page_id.page_id", "page_id.url", F.left("page_text", F.lit(STATE_TEXT)).alias("text"), F.size(F.filter("nodes", lambda n: n["tag"] == "form")).alias("form_count"), F.size("nodes").alias("total_elements"), F.size(F.filter("nodes", usable)).alias("interactive_elements"),
        F.coalesce(F.col("page_id.html").rlike(CHALLENGE), F.lit(False)).alias("has_captcha"), F.exists("nodes", trap).alias("has_honeypot"), F.coalesce(F.startswith("page_id.url", F.lit("https:")), F.lit(False)).alias("is_secure"),
        F.exists("nodes", lambda n: (n["tag"] == "input") & (F.coalesce(a(n, "type"), F.lit("")) == "file")).alias("has_file_upload"), F.col("page_text").rlike(PAYMENT).alias("has_payment_form"),
    )
