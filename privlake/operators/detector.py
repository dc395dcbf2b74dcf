"""The page detector: personal data in form fields, element texts and page text, and what may leave a page after it.

Fields are those of operators.forms; element tables have page_id, ord, id, label, text, x, y, w, h; text tables have page_id, text. A page's
regions are told apart by their place (branch, i, k, m), in which they were found.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privlake.functions import validators as v
from privlake.functions.text import B, half_bounded, scrub_known
from privlake.operators.forms import field_categories, field_context, selector, shown_name
from privlake.operators.scan import masked, severity

#: The keyword of each category that makes a field's match certain.
FIRST_KEYWORD = {
    "password": "password", "aadhaar": "aadhaar", "pan": "pan card", "phone": "phone", "email": "email", "bank_account": "account number", "ifsc": "ifsc",
    "upi": "upi", "name": "name", "address": "address", "date_of_birth": "date of birth", "financial": "card number", "medical": "diagnosis", "ip_address": "ip address",
}
#: Patterns that texts are searched for, in order.
TEXT_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("upi", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9]+\b"),
    ("upi", r"\b[0-9]{10}@[A-Za-z]+\b"),
    ("date_of_birth", r"\b[0-9]{2}[\/\-][0-9]{2}[\/\-][0-9]{4}\b"),
    ("ip_address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
)
#: Categories that are found by check digits or formats in all texts of a page together, with their confidence; all but the last by their first match alone.
CHECKED = (("aadhaar", 0.98), ("pan", 0.97), ("financial", 0.99), ("ifsc", 0.95), ("phone", 0.9))
CHECKED_PATTERNS = {"aadhaar": r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "financial": r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "phone": r"\b[0-9]{10}\b"}
#: Categories that are blacked out; the others' text is masked.
BLACK_BOX = ("password", "aadhaar", "pan", "bank_account", "financial", "medical")
#: What every text with a match holds, for each of the patterns above: cheaper to look for, and absent from most texts.
_TEXT_SIGNS = ("@", "@", "@", "[0-9][/-][0-9]", r"[0-9]\.[0-9]")
_CHECKED_SIGNS = {"aadhaar": "[0-9]{4}", "pan": "[A-Z]{5}[0-9]{4}", "financial": "[0-9]{4}", "ifsc": "[A-Z]{4}0", "phone": "[0-9]{10}"}
_PLACE = ("branch", "i", "k", "m")


def sensitivity(category: Column) -> Column:
    """As severity, with the two categories that only fields and texts have."""
    return F.coalesce(severity(category), F.when(category == "medical", "critical").when(category == "ip_address", "medium"))


def _pattern(p: str) -> Column:
    return F.lit(half_bounded(p.replace(r"\b", B)))


def _gated(sign: str, found: Column) -> Column:
    """`found` where the text has the sign, else null."""
    text = F.col("text")
    return F.when(F.contains(text, F.lit(sign)) if len(sign) == 1 else text.rlike(sign), found)


def _passing(category: str, found: Column) -> Column:
    check = {"aadhaar": v.verhoeff_valid, "pan": v.pan_valid, "financial": v.luhn_valid, "ifsc": v.ifsc_valid, "phone": v.phone_valid}[category]
    return F.filter(found, lambda x: check(F.regexp_replace(x, r"\s", "")))


def first_rects(elements: DataFrame) -> DataFrame:
    """The place of the first element of each id on a page."""
    return elements.groupBy("page_id", F.col("id").alias("element_id")).agg(F.min_by(F.struct(*(F.col(c).cast("double").alias(c) for c in "xywh")), "ord").alias("rect"))


def _by_page(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Per page, a map of what its rows have: rows are joined by page alone then, so tables that lie by page needn't move. A page's keys, each of which is there once, are gathered, never more."""
    return rows.where(F.col(key).isNotNull()).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def field_regions(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """A region per field and category that its context names, at the place of the element of its id, or else name."""
    context = field_context()
    sure = reduce(lambda a, kv: a.when(F.col("category") == kv[0], F.contains("context", F.lit(kv[1]))), FIRST_KEYWORD.items(), F.when(F.lit(False), F.lit(False)))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("name"), F.lit(""))
    rows = fields.select("page_id", F.col("ord").alias("i"), F.posexplode(field_categories()).alias("k", "category"), F.nullif(F.col("value"), F.lit("")).alias("text_value"), selector().alias("field_selector"), context.alias("context"), label.alias("label"), F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("name"), F.lit("")).alias("element_id"))
    method = F.concat(F.lit('Form field "'), "label", F.lit('" matched '), "category", F.lit(" pattern"))
    rows = rows.join(_by_page(first_rects(elements), "element_id", "rect", "rects"), "page_id", "left").withColumn("rect", F.try_element_at("rects", F.col("element_id")))
    return rows.select("page_id", F.lit(1).alias("branch"), "i", "k", F.lit(0).alias("m"), "category", "text_value", "field_selector", F.when(sure, 0.95).otherwise(0.8).alias("confidence"), method.alias("method"), "rect")


def element_regions(elements: DataFrame) -> DataFrame:
    """A region per element and pattern: its first match."""
    tried = F.array(*(F.struct(F.lit(c).alias("category"), F.nullif(_gated(sign, F.regexp_extract("text", half_bounded(p.replace(r"\b", B)), 0)), F.lit("")).alias("found")) for (c, p), sign in zip(TEXT_PATTERNS, _TEXT_SIGNS, strict=True)))
    rows = elements.select("page_id", F.col("ord").alias("i"), "id", F.struct(*(F.col(c).cast("double").alias(c) for c in "xywh")).alias("rect"), F.posexplode(tried).alias("k", "r")).where("r.found is not null")
    method = F.concat(F.lit('Text "'), F.left(F.col("r.found"), F.lit(20)), F.lit('..." matched '), "r.category", F.lit(" regex"))
    return rows.select("page_id", F.lit(2).alias("branch"), "i", "k", F.lit(0).alias("m"), "r.category", F.col("r.found").alias("text_value"), F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).alias("field_selector"), F.lit(0.85).alias("confidence"), method.alias("method"), "rect")


_NO_RECT = "struct<x: double, y: double, w: double, h: double>"


def text_regions(texts: DataFrame) -> DataFrame:
    """All matches of each pattern in a page's text."""
    tried = F.array(*(F.struct(F.lit(c).alias("category"), _gated(sign, F.regexp_extract_all("text", _pattern(p), F.lit(0))).alias("found")) for (c, p), sign in zip(TEXT_PATTERNS, _TEXT_SIGNS, strict=True)))
    rows = texts.select("page_id", F.posexplode(tried).alias("k", "r")).select("page_id", "k", "r.category", F.posexplode("r.found").alias("m", "text_value"))
    method = F.concat(F.lit("Page text matched "), "category", F.lit(" regex"))
    return rows.select("page_id", F.lit(3).alias("branch"), F.lit(0).alias("i"), "k", "m", "category", "text_value", F.lit(None).cast("string").alias("field_selector"), F.lit(0.7).alias("confidence"), method.alias("method"), F.lit(None).cast(_NO_RECT).alias("rect"))


def page_corpus(fields: DataFrame, elements: DataFrame, texts: DataFrame) -> DataFrame:
    """All texts of a page in one: of its elements, of its fields, its own. One page's texts are gathered, never more."""
    field = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("label", "value", "name", "id")))
    parts = elements.select("page_id", F.lit(0).alias("b"), "ord", F.coalesce("text", F.lit("")).alias("t")).unionByName(fields.select("page_id", F.lit(1).alias("b"), "ord", field.alias("t"))).unionByName(texts.select("page_id", F.lit(2).alias("b"), F.lit(0).alias("ord"), F.coalesce("text", F.lit("")).alias("t")))
    return parts.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("b", "ord", "t"))).alias("p")).select("page_id", F.array_join("p.t", " ").alias("text"))


def checked_regions(corpus: DataFrame) -> DataFrame:
    """The first match of each checked pattern, if it passes; of phones, all that do."""
    first = lambda p: F.array(F.regexp_extract("text", half_bounded(p.replace(r"\b", B)), 0))  # noqa: E731  without a match it is empty, which passes no check
    found = lambda c, p: _gated(_CHECKED_SIGNS[c], F.regexp_extract_all("text", _pattern(p), F.lit(0)) if c == "phone" else first(p))
    tried = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(p).alias("confidence"), _passing(c, found(c, CHECKED_PATTERNS[c])).alias("found")) for c, p in CHECKED))
    rows = corpus.select("page_id", F.posexplode(tried).alias("k", "r")).select("page_id", "k", "r.category", "r.confidence", F.posexplode("r.found").alias("m", "text_value"))
    return rows.select("page_id", F.lit(4).alias("branch"), F.lit(0).alias("i"), "k", "m", "category", "text_value", F.lit(None).cast("string").alias("field_selector"), "confidence", F.concat("category", F.lit(" verified")).alias("method"), F.lit(None).cast(_NO_RECT).alias("rect"))


def detect_page(fields: DataFrame, elements: DataFrame, texts: DataFrame) -> DataFrame:
    """All regions of each page, with an id in order of place. What page text and the checks find is left out where the same value was found before."""
    all_ = [field_regions(fields, elements), element_regions(elements), text_regions(texts), checked_regions(page_corpus(fields, elements, texts))]
    rows = reduce(DataFrame.unionByName, all_)
    # whatever was found earlier was kept, or stood behind the same value that was: so the first of each value stays
    first = F.row_number().over(Window.partitionBy("page_id", "text_value").orderBy(*_PLACE)) == 1
    rows = rows.withColumn("_first", first).where("branch <= 2 or _first").drop("_first")
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(*_PLACE))
    strategy = F.when(F.col("category").isin(*BLACK_BOX), "black_box").otherwise("mask_text")
    return rows.select("page_id", F.concat(F.lit("pii-dom-"), number).alias("region_id"), *_PLACE, "category", sensitivity(F.col("category")).alias("sensitivity"), "text_value", "field_selector", "confidence", F.lit("dom").alias("source"), "method", strategy.alias("strategy"), "rect")


def all_regions(*sources: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Regions of all sources (page, vision, faces) with at least that confidence; counts over them include every source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources).where(F.col("confidence") >= threshold)


def summarise_regions(regions: DataFrame) -> DataFrame:
    """Per page: total, regions of each severity, maps of how many there are by category and by source, and the mean confidence. A page's names are gathered, never more."""
    counted = lambda c: F.map_from_entries(F.transform(F.array_distinct(F.collect_list(c)), lambda x: F.struct(x, F.size(F.filter(F.collect_list(c), lambda y: y == x)).cast("long"))))
    level = {f"{s}_count": F.count_if(F.col("sensitivity") == s) for s in ("critical", "high", "medium", "low")}
    return regions.groupBy("page_id").agg(F.count("*").alias("total"), *(c.alias(n) for n, c in level.items()), counted("category").alias("by_category"), counted("source").alias("by_source"), F.avg("confidence").alias("confidence"))


def region_lists(regions: DataFrame) -> DataFrame:
    """A row per page and category, numbered in the order in which a page's categories were found first: page_id, number, category, regions (ids in order of place)."""
    place = F.struct(*_PLACE)
    lists = regions.groupBy("page_id", "category").agg(F.min(place).alias("_first"), F.transform(F.sort_array(F.collect_list(F.struct(*_PLACE, "region_id"))), lambda x: x["region_id"]).alias("regions"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("_first")) - 1
    return lists.select("page_id", number.alias("number"), "category", "regions")


def _values() -> Column:
    """The values of a page's regions in the order in which they were found, each once."""
    found = F.collect_list(F.when(F.col("text_value") != "", F.struct(*_PLACE, "text_value")))
    return _in_order(found)


def _in_order(found: Column) -> Column:
    return F.array_distinct(F.transform(F.sort_array(found), lambda x: x["text_value"]))


def _of_page(regions: DataFrame, pick: Callable[[str, Column], Column]) -> DataFrame:
    """Per page: its values as _known() has them, and a map from selectors to the category that `pick` takes of theirs by place."""
    found = F.collect_list(F.when(F.col("text_value") != "", F.struct(*_PLACE, "text_value")))
    each = regions.groupBy("page_id", "field_selector").agg(pick("category", F.struct(*_PLACE)).alias("category"), found.alias("found"))
    named = F.when(F.col("field_selector").isNotNull(), F.struct("field_selector", "category"))
    return each.groupBy("page_id").agg(_in_order(F.flatten(F.collect_list("found"))).alias("values"), F.map_from_entries(F.collect_list(named)).alias("categories"))


def _known(regions: DataFrame) -> DataFrame:
    """Per page: the values that were found, in order, each once."""
    return regions.groupBy("page_id").agg(_values().alias("values"))


def _scrubbed(text: Column) -> Column:
    return masked(scrub_known(F.coalesce(text, F.lit("")), F.coalesce("values", F.array().cast("array<string>"))))


def sanitised_fields(fields: DataFrame, regions: DataFrame) -> DataFrame:
    """What may be told of fields: a scrubbed label, the type, whether there is a value, and the category found first for its selector."""
    rows = fields.join(_of_page(regions, F.min_by), "page_id", "left").withColumn("pii_category", F.try_element_at("categories", selector()))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("name"))
    return rows.select("page_id", "form_id", "ord", _scrubbed(label).alias("label"), "type", (F.coalesce("value", F.lit("")) != "").alias("has_value"), F.col("required").alias("is_required"), "pii_category")


def sanitised_elements(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Elements with their label, or else text, scrubbed."""
    rows = elements.join(_known(regions), "page_id", "left")
    return rows.select("page_id", "ord", _scrubbed(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("text"))).alias("label"), *"xywh")


def sanitised_pages(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """Page texts, scrubbed, with the number of regions and their categories: regions are aggregated once."""
    facts = regions.groupBy("page_id").agg(_values().alias("values"), F.count("*").alias("total"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("strategy")).alias("strategies"))
    return texts.join(facts, "page_id", "left").select("page_id", _scrubbed(F.col("text")).alias("text"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"), F.coalesce(F.array_join("strategies", ","), F.lit("")).alias("strategies"))


def review_fields(fields: DataFrame, regions: DataFrame) -> DataFrame:
    """Fields to be shown for review: flagged ones and those with a value; a password's value never. The category is the one found last for the selector."""
    kind, value = F.lower(F.coalesce("type", F.lit(""))), F.coalesce("value", F.lit(""))
    rows = fields.withColumn("selector", selector()).where(~kind.isin("checkbox", "radio", "submit", "button", "reset", "image") & F.col("selector").isNotNull()).join(_of_page(regions, F.max_by), "page_id", "left").withColumn("category", F.try_element_at("categories", F.col("selector"))).where(F.col("category").isNotNull() | (value != ""))
    return rows.select("page_id", "form_id", "ord", F.coalesce(shown_name(), F.lit("(unlabeled)")).alias("label"), "selector", "category", F.when(kind == "password", "").otherwise(value).alias("value"), "required", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("text")).alias("type"))
