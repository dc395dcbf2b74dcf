"""What a page's forms hold, with values masked where they are personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privlake.functions.text import mask_value
from privlake.operators.forms import _text, collapse_radios, field_categories, selector
from privlake.operators.scan import scan_spans


def extract_fields(fields: DataFrame) -> DataFrame:
    """Rows (page_id, form_id, ord, label, value, type, pii_category, masked): a radio group is one row; passwords are never shown.

    A value is masked if the scan finds something in it, or if its selector has a category and it is longer than four characters. Where several
    fields share a selector, the last category counts. Checkboxes show whether they are checked.
    """
    kind, value = F.lower(_text("type")), _text("value")
    # windowed, so that fields that lie by page needn't move
    last = F.max_by(F.try_element_at("_cats", F.lit(-1)), F.when(F.size("_cats") > 0, F.struct("ord", F.size("_cats")))).over(Window.partitionBy("page_id", "selector"))
    declared = F.when(F.col("page_id").isNotNull() & F.col("selector").isNotNull(), last)
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.lit("(unlabeled)"))
    rows = fields.withColumn("selector", selector()).withColumn("_cats", field_categories()).withColumn("declared", declared).where(kind != "radio").withColumn("hits", scan_spans(value))
    personal = F.size("hits") > 0
    mask = (value != "") & (personal | (F.col("declared").isNotNull() & (F.length(value) > 4)))
    category = F.coalesce("declared", F.get("hits", F.lit(0))["category"])
    plain = (kind != "password") & (kind != "checkbox")
    shown = F.when(kind == "password", F.when(value != "", "(password withheld)").otherwise("")).when(kind == "checkbox", F.when(F.coalesce("checked", F.lit(False)), "checked").otherwise("unchecked")).when(mask, mask_value(value)).otherwise(value)
    scalars = rows.select("page_id", "form_id", "ord", label.alias("label"), shown.alias("value"), F.col("type"), F.when(kind == "password", "password").when(plain & mask, category).alias("pii_category"), ((kind == "password") | (plain & mask)).alias("masked"))
    radios = collapse_radios(fields).select("page_id", "form_id", "ord", F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("(radio group)")).alias("label"), F.col("selected").alias("value"), F.lit("radio").alias("type"), F.lit(None).cast("string").alias("pii_category"), F.lit(False).alias("masked"))
    return scalars.unionByName(radios)


def summarise_extraction(extracted: DataFrame) -> DataFrame:
    """Per page: sections (forms with fields), fields, filled and masked fields."""
    return extracted.groupBy("page_id").agg(F.count_distinct("form_id").alias("sections"), F.count("*").alias("fields"), F.count_if(F.col("value") != "").alias("filled"), F.count_if("masked").alias("masked"))


def as_json(extracted: DataFrame) -> DataFrame:
    """Per page, its fields in order as JSON; masked values only."""
    row = F.struct("form_id", "ord", "label", "type", "value", "pii_category", "masked")
    return extracted.groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("json"))
