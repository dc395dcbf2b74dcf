"""Form fields as rows: categories, validation, what is still required, and joins with saved values.

Field tables have page_id, form_id, ord, name, id, type, label, value, required, max_length, pattern, options, checked.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlake.functions.patterns import to_jvm
from privlake.functions.text import B, bound, is_placeholder, normal_key

#: Input types that hold no data of their own, and those that are controls.
NON_DATA_TYPES = ("checkbox", "radio", "submit", "button", "reset", "image", "file", "range", "color")
CONTROL_TYPES = ("submit", "button", "reset", "image", "hidden", "checkbox", "radio")
#: Patterns that a field's context is tested against, in order of precedence; password is tested besides.
PASSWORD = r"password|passwd|\bsecret\b|\botp\b|\bcvv\b|\bmpin\b|atm\s*pin"
FIELD_RULES = (
    ("ifsc", r"ifsc"),
    ("upi", r"upi|vpa"),
    ("pan", r"pan\s*card|pan\s*number|pan\z"),
    ("aadhaar", r"aadhaar|aadhar|\buid\b|\bvid\b"),
    ("financial", r"card|cvv|expiry|credit|debit|billing"),
    ("bank_account", r"account\s*(no|number)|acc\s*no|bank\s*acc|a/c"),
    ("date_of_birth", r"dob|date\s*of\s*birth|birth|born"),
    ("email", r"email|e-mail|mail"),
    ("phone", r"phone|mobile|contact\s*(no|number)|telephone|\bcell\b"),
    ("medical", r"diagnos|medication|allerg|symptom|medical|health|prescription"),
    ("address", r"address|street|city|state|pin\s*code|pincode|district|village|post"),
    ("name", r"name|father|mother|husband|guardian"),
    ("ip_address", r"ip\s*address|ip\z"),
)
#: What a field is taken for in validation, in order, and what its value must look like.
VALUE_KINDS = (
    ("aadhaar", r"aadhaar|uid"),
    ("pan", r"pan\s*card|pan\s*number"),
    ("pincode", r"pin\s*code|pincode|postal"),
    ("phone", r"phone|mobile|contact|tele"),
    ("email", r"email|e-mail|mail"),
    ("ifsc", r"ifsc"),
    ("account", r"account|acc\s*no"),
    ("gst", r"gst"),
    ("date", r"date|dob|birth"),
)
VALUE_PATTERNS = {
    "aadhaar": r"^[0-9]{12}\z",
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]\z",
    "pin": r"^[0-9]{6}\z",
    "phone": r"^[+]?[6-9][0-9]{9}\z",
    "mobile": r"^[+]?[6-9][0-9]{9}\z",
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+\z",
    "ifsc": r"^[A-Z]{4}0[A-Z0-9]{6}\z",
    "account": r"^[0-9]{9,18}\z",
    "gst": r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]\z",
    "date": r"^[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}\z",
    "pincode": r"^[0-9]{6}\z",
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _bounded(pattern: str) -> str:
    """With ASCII word boundaries; beside a word sign half of one will do, which is far cheaper to search for."""
    return re.sub(r"(?<=\w)\\b", "(?![A-Za-z0-9_])", re.sub(r"\\b(?=\w)", "(?<![A-Za-z0-9_])", pattern)).replace(r"\b", B)


def _says(context: Column, pattern: str) -> Column:
    """Whether the pattern is found. Words are looked for as such; a pattern with more than words only where its longest word stands."""
    words = re.split(r"\|(?![^(]*\))", pattern)
    tests = []
    for p in words:
        sign = max(re.findall(r"[a-z/-]+", re.sub(r"\([^)]*\)|\\[a-zA-Z]\*?", " ", p)), key=len)
        tests.append(F.contains(context, F.lit(sign)) if sign == p else F.contains(context, F.lit(sign)) & context.rlike(_bounded(p)))
    return reduce(lambda a, b: a | b, tests)


def field_context() -> Column:
    """What rules are tested against; a label of more than 60 characters is prose and left out."""
    label = F.trim(_text("label"))
    return F.lower(F.concat_ws(" ", _text("name"), _text("id"), F.when(F.length(label) <= 60, label).otherwise(""), _text("type"), _text("pattern")))


def field_categories() -> Column:
    """The categories of a field: password by type alone, else password by its context and the first other rule that matches."""
    kind = F.lower(_text("type"))

    def told(context: Column) -> Column:
        first = F.coalesce(*(F.when(_says(context, p), c) for c, p in FIELD_RULES))
        return F.array_compact(F.array(F.when(_says(context, PASSWORD), "password"), first))

    both = bound(field_context(), told)
    return F.when(kind.isin(*NON_DATA_TYPES), F.array().cast("array<string>")).when(kind == "password", F.array(F.lit("password"))).otherwise(both)


def selector() -> Column:
    """#id, else [name="..."], else null."""
    return F.when(_text("id") != "", F.concat(F.lit("#"), F.col("id"))).when(_text("name") != "", F.concat(F.lit('[name="'), F.col("name"), F.lit('"]')))


def shown_name() -> Column:
    return F.coalesce(F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.col("id"))


#: A longer value is not searched for a page's pattern, so that no search takes long.
MOST_SEARCHED = 1000
#: What is said of a value that its kind's pattern refuses, and what is advised.
ADVICE = {
    "aadhaar": ("Aadhaar must be exactly 12 digits", "Remove spaces and dashes"),
    "pan": ("PAN must be ABCDE1234F format", "5 letters + 4 digits + 1 letter"),
    "pin": ("PIN code must be exactly 6 digits", "Check your area PIN code"),
    "phone": ("Invalid Indian phone number", "Start with 6-9, total 10 digits"),
    "mobile": ("Invalid mobile number", "Start with 6-9, total 10 digits"),
    "email": ("Invalid email format", "user@example.com"),
    "ifsc": ("IFSC must be 11 characters", "First 4 letters + 0 + 6 alphanumeric"),
    "account": ("Account number must be 9-18 digits", "Check your bank passbook"),
    "gst": ("Invalid GST format", "2 digits + 5 letters + 4 digits + 1 letter + Z + 1 char"),
    "date": ("Date must be DD/MM/YYYY", "Use format: 01/01/2000"),
    "pincode": ("PIN code must be 6 digits", "Check your area PIN code"),
}


def page_patterns(fields: DataFrame) -> DataFrame:
    """Rows (pattern, _jvm): the distinct patterns of pages that can be searched for, each judged once: put for the JVM by to_jvm(), and compiled by it."""

    @F.pandas_udf("string")
    def put(patterns: pd.Series) -> pd.Series:
        return patterns.map(to_jvm, na_action="ignore").astype(object)

    found = fields.where("pattern <> ''").select("pattern").distinct().withColumn("_jvm", put("pattern"))
    return found.where(F.expr("try_reflect('java.util.regex.Pattern', 'compile', _jvm)").isNotNull())


#: Distinct patterns are broadcast up to this size in bytes, which is counted.
FEW = 1 << 22


def _with_patterns(fields: DataFrame) -> DataFrame:
    """Adds _jvm. Most fields have no pattern, or one that all pages have, so no pattern's fields meet in one task: few patterns are broadcast; with many, fields without one are dealt out by their page and place."""
    patterns = page_patterns(fields).withColumnRenamed("pattern", "_of")
    size = fields.where("pattern <> ''").select("pattern").distinct().agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    if size <= FEW:
        return fields.join(F.broadcast(patterns), F.col("pattern") == F.col("_of"), "left").drop("_of")
    dealt = F.when(F.col("pattern") != "", F.lit(0).cast("long")).otherwise(F.xxhash64("page_id", "form_id", "ord"))
    return fields.withColumn("_at", dealt).join(patterns.withColumn("_zero", F.lit(0).cast("long")), (F.col("pattern") == F.col("_of")) & (F.col("_at") == F.col("_zero")), "left").drop("_of", "_at", "_zero")


def _validated(fields: DataFrame) -> DataFrame:
    kind = F.lower(F.concat_ws(" ", _text("name"), _text("label"), _text("placeholder") if "placeholder" in fields.columns else F.lit("")))
    category = F.coalesce(*(F.when(kind.rlike(p), c) for c, p in VALUE_KINDS), _text("type"))
    value, empty = _text("value"), F.trim(_text("value")) == ""
    matches = reduce(lambda a, kv: a.when(F.col("category") == kv[0], value.rlike(kv[1])), VALUE_PATTERNS.items(), F.when(F.lit(False), F.lit(None).cast("boolean")))
    fields = _with_patterns(fields)
    other = F.col("_jvm").isNotNull() & (F.length(value) <= MOST_SEARCHED) & ~F.when(F.length(value) <= MOST_SEARCHED, F.regexp_like(value, F.col("_jvm")))
    rule = F.when(F.col("required") & empty, "required").when(empty, "optional").when((F.col("max_length") > 0) & (F.length(value) > F.col("max_length")), "maxLength").when(other, "pattern").when(F.col("fits").isNull(), "none").otherwise(F.col("category"))
    out = fields.withColumn("category", category).withColumn("fits", matches).withColumn("rule", rule)
    valid = F.col("rule").isin("optional", "none") | (~F.col("rule").isin("required", "maxLength", "pattern") & F.coalesce("fits", F.lit(False)))
    return out.withColumn("valid", valid)


def validate_fields(fields: DataFrame) -> DataFrame:
    """A row per field with field_name, valid, rule and risk: required, optional, maxLength, pattern, then the rule of its kind.

    A page's own pattern is JavaScript's and is searched for anywhere in the value. One that is no regular expression, or whose search could take for ever, is left out (see functions.patterns), and so are
    values of over MOST_SEARCHED characters. Distinct patterns are judged once and joined back; the search itself runs in the JVM. A kind is told by name, label and, if there is such a column, placeholder.
    """
    return _validated(fields).select("page_id", "form_id", "ord", shown_name().alias("field_name"), "rule", "valid", F.when(F.col("valid"), "low").when(F.col("rule") == "pattern", "medium").otherwise("high").alias("risk"))


def explain_fields(fields: DataFrame) -> DataFrame:
    """validate_fields() with what is said of each value: message, suggestion (null without one) and issue (what keeps the form from being sent, null for valid fields)."""
    rows, length = _validated(fields), F.length(_text("value"))
    said = lambda k: reduce(lambda a, kv: a.when(F.col("rule") == kv[0], kv[1][k]), ADVICE.items(), F.when(F.lit(False), ""))
    over = F.concat(F.lit("Maximum "), F.col("max_length").cast("string"), F.lit(" characters (currently "), length.cast("string"), F.lit(")"))
    trim = F.concat(F.lit("Trim "), (length - F.col("max_length")).cast("string"), F.lit(" characters"))
    own = {"required": F.lit("This field is required"), "optional": F.lit("Optional field, empty is OK"), "maxLength": over, "pattern": F.lit("Value doesn't match required format"), "none": F.lit("No validation rules for this field")}
    message = reduce(lambda a, kv: a.when(F.col("rule") == kv[0], kv[1]), own.items(), F.when(F.lit(False), "")).when(F.col("valid"), F.concat(F.lit("Valid "), "rule", F.lit(" format"))).otherwise(said(0))
    advice = F.when(F.col("rule") == "maxLength", trim).when(F.col("rule") == "pattern", F.col("pattern")).when(~F.col("valid"), said(1))
    told = F.when(F.col("rule") == "required", "required but empty").when(F.col("rule") == "maxLength", "too long").when(F.col("rule") == "pattern", "format mismatch").otherwise(F.col("message"))
    rows = rows.withColumn("message", message).withColumn("suggestion", advice)
    return rows.select("page_id", "form_id", "ord", shown_name().alias("field_name"), "rule", "valid", "message", "suggestion", F.when(~F.col("valid"), F.concat(shown_name(), F.lit(": "), told)).alias("issue"))


def summarise_validation(validated: DataFrame) -> DataFrame:
    """Per form: whether all is valid, the highest risk and the number of issues."""
    rank = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    return validated.groupBy("page_id", "form_id").agg(F.bool_and("valid").alias("all_valid"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.max(rank) + 1).alias("risk"), F.count_if(~F.col("valid")).alias("issues"))


def requirements(fields: DataFrame, saved: DataFrame) -> DataFrame:
    """Required data fields that are still empty, or on a placeholder, with the reason: no value is saved under a like key, or one is and was not applied.

    `saved` has page_id, key, value. Keys match after everything but a-z and digits is dropped; candidates are name, id and label.
    """
    kind = F.lower(_text("type"))
    unset = (_text("value") == "") | ((kind == "select") & is_placeholder(_text("value")))
    open_ = fields.where(~kind.isin(*CONTROL_TYPES) & F.col("required") & unset & selector().isNotNull())
    keys = saved.where(F.coalesce("value", F.lit("")) != "").select("page_id", normal_key(F.col("key")).alias("key")).where("key <> ''").distinct()
    wanted = open_.select("page_id", "form_id", "ord", F.explode(F.array("name", "id", "label")).alias("candidate")).select("page_id", "form_id", "ord", normal_key(F.col("candidate")).alias("key"))
    known = wanted.join(keys, ["page_id", "key"], "left_semi").select("page_id", "form_id", "ord").distinct().withColumn("known", F.lit(True))
    options = F.when(F.size("options") > 0, F.filter("options", lambda o: ~is_placeholder(o)))
    return open_.join(known, ["page_id", "form_id", "ord"], "left").select("page_id", "form_id", "ord", F.coalesce(shown_name(), F.lit("(unlabeled)")).alias("label"), selector().alias("selector"), F.when(F.col("known"), "still_empty_after_run").otherwise("no_local_value").alias("reason"), F.coalesce(F.size(options), F.lit(0)).alias("choices"))


def first_and_last_category(fields: DataFrame) -> DataFrame:
    """Per page and selector, the category found first and the one found last: two ways in which a selector's category is looked up."""
    found = fields.withColumn("selector", selector()).select("page_id", "selector", "ord", F.posexplode(field_categories()).alias("k", "category")).where("selector is not null")
    order = F.struct("ord", "k")
    return found.groupBy("page_id", "selector").agg(F.min_by("category", order).alias("first_category"), F.max_by("category", order).alias("last_category"))


def collapse_radios(fields: DataFrame) -> DataFrame:
    """One row per radio group of a form: the checked option's label, else its value, or (none selected)."""
    radios = fields.where(F.lower(_text("type")) == "radio").withColumn("group", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.col("label")))
    picked = F.min_by(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("value")), F.when(F.coalesce("checked", F.lit(False)), F.col("ord")))
    return radios.groupBy("page_id", "form_id", "group").agg(F.coalesce(picked, F.lit("(none selected)")).alias("selected"), F.min("ord").alias("ord"))


def completion(fields: DataFrame) -> DataFrame:
    """Per page: fields, filled, required, empty required, and the filled share (null without fields)."""
    filled = F.trim(_text("value")) != ""
    return fields.groupBy("page_id").agg(F.count("*").alias("total"), F.count_if(filled).alias("filled"), F.count_if("required").alias("required"), F.count_if(F.col("required") & ~filled).alias("missing"), F.round(F.try_divide(F.count_if(filled), F.count("*")), 6).alias("ratio"))
