"""Questions about a page, answered from its fields and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privlake.functions.text import B, basename
from privlake.operators.spatial import position_words

#: Words that a question about files has, and words that name no element.
FILE_WORDS = B + "(photos?|photographs?|images?|pictures?|files?|documents?|scans?|uploads?|uploaded|uploading|attachments?|attached)" + B
NOISE = "check where is the a an on in this that page tell me find out locate show button field link at of my it please can you see which what".split()
_FIELD = ("ord", "name", "label", "type", "value", "required")
_ELEMENT = ("ord", "tag", "text", "label", "type", "x", "y", "w", "h")


def _word(text: Column, words: str) -> Column:
    return text.rlike(B + f"({words})" + B)


def answer(questions: DataFrame, fields: DataFrame, elements: DataFrame) -> DataFrame:
    """Questions (page_id, question) with text, confidence and needs_vision.

    The first that applies: where something is; files attached; what to fill; a field named by its label; completeness; sensitive data (fields with
    categories); else unanswered. A page's fields and elements come to its questions as arrays; questions of pages without any are answered as of empty pages. Elements may have an aria_label, which is searched for what a question names like their label and text.
    """
    per_field = fields.withColumn("sensitive", F.size(_categories()) > 0).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*_FIELD))).alias("f"), F.count_if("sensitive").alias("sensitive"))
    per_element = elements.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*_ELEMENT, (F.col("aria_label") if "aria_label" in elements.columns else F.lit("")).alias("aria")))).alias("e"))
    rows = questions.join(per_field, "page_id", "left").join(per_element, "page_id", "left").withColumn("q", F.lower(F.coalesce("question", F.lit(""))))
    none_f, none_e = F.expr("filter(f, x -> false)"), F.expr("filter(e, x -> false)")
    rows = rows.withColumn("f", F.coalesce("f", none_f, F.array().cast("array<struct<ord: int, name: string, label: string, type: string, value: string, required: boolean>>"))).withColumn("e", F.coalesce("e", none_e, F.array().cast("array<struct<ord: int, tag: string, text: string, label: string, type: string, x: double, y: double, w: double, h: double, aria: string>>")))
    q = F.col("q")
    say = lambda text, confidence, vision=False: F.struct(text.alias("text"), F.lit(confidence).alias("confidence"), F.lit(vision).alias("needs_vision"))
    of_type = lambda x: F.lower(F.coalesce(x["type"], F.lit("")))
    filled = lambda x: F.coalesce(x["value"], F.lit("")) != ""
    name = lambda x, other: F.coalesce(F.nullif(x["label"], F.lit("")), F.nullif(x["name"], F.lit("")), F.lit(other))
    bare = lambda x: F.trim(F.regexp_replace(x, r"\s*\*\z", ""))

    words = F.filter(F.split(F.regexp_replace(q, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*NOISE))
    scored = F.transform("e", lambda x: F.struct((-F.size(F.filter(words, lambda w: F.contains(F.lower(F.concat_ws(" ", F.coalesce(x["label"], F.lit("")), F.coalesce(x["text"], F.lit("")), F.coalesce(x["aria"], F.lit("")), F.coalesce(x["type"], F.lit("")))), w)))).alias("s"), x["ord"].alias("ord"), x.alias("x")))
    best = F.get(F.sort_array(F.filter(scored, lambda t: t["s"] < 0)), F.lit(0))["x"]
    shown = F.left(F.trim(F.coalesce(F.nullif(best["label"], F.lit("")), F.nullif(best["text"], F.lit("")), best["tag"])), F.lit(60))
    where = F.when(_word(q, "where"), F.when(best.isNotNull(), say(F.concat(F.lit('"'), shown, F.lit('" is '), position_words(best["x"], best["y"], best["w"], best["h"]), F.lit(".")), 0.92)).otherwise(say(F.lit("I could not find anything on this page matching that."), 0.6, True)))

    files = F.filter("f", lambda x: of_type(x) == "file")
    done = F.filter(files, lambda x: F.trim(F.coalesce(x["value"], F.lit(""))) != "")
    todo = lambda rows_: F.array_join(F.transform(rows_, lambda x: name(x, "upload field")), ", ")
    missing = F.filter(files, lambda x: ~filled(x))
    upload = (
        F.when(F.size(files) == 0, say(F.lit("There is no file-upload field on this page."), 0.8, True))
        .when((F.size(done) == F.size(files)) & (F.size(done) == 1), say(F.concat(F.lit('Yes — a file is attached to "'), name(F.get(done, F.lit(0)), "the upload field"), F.lit('".')), 0.97))
        .when(F.size(done) == F.size(files), say(F.concat(F.lit("Yes — all "), F.size(done), F.lit(" upload fields have a file attached.")), 0.97))
        .when(F.size(done) == 0, say(F.concat(F.lit("No — nothing is attached yet. "), F.when(F.size(files) == 1, "This field is").otherwise("These fields are"), F.lit(" still empty: "), todo(files), F.lit(".")), 0.95))
        .otherwise(say(F.concat(F.lit("Partly — "), F.size(done), F.lit(" of "), F.size(files), F.lit(" uploads are done. Still missing: "), todo(missing), F.lit(".")), 0.95))
    )

    inputs = F.filter("f", lambda x: ~of_type(x).isin("submit", "button", "reset", "image", "hidden"))
    empty = F.filter(inputs, lambda x: ~filled(x))
    needed = F.filter(empty, lambda x: x["required"])
    target = F.when(F.size(needed) > 0, needed).otherwise(empty)
    names = F.filter(F.transform(target, lambda x: bare(name(x, "unlabelled field"))), lambda x: x != "")
    sort = F.when(F.size(needed) > 0, "required").otherwise("empty")
    fill = (
        F.when(F.size(inputs) == 0, say(F.lit("There are no input fields on this page."), 0.9))
        .when(F.size(target) == 0, say(F.lit("Nothing — every field on this page already has a value."), 0.9))
        .when(F.size(names) == 1, say(F.concat(F.lit("One "), sort, F.lit(' field: "'), F.get(names, F.lit(0)), F.lit('".')), 0.95))
        .otherwise(say(F.concat(F.size(names), F.lit(" "), sort, F.lit(" fields to fill: "), F.array_join(F.slice(names, 1, 8), ", "), F.when(F.size(names) > 8, ", …").otherwise(""), F.lit(".")), 0.95))
    )
    asks_fill = _word(q, "fill|enter|type|provide|input|complete") & (q.rlike("^(what|which|how)" + B) | q.rlike(B + "what (do|should|needs?|is)" + B))

    named = F.get(F.filter("f", lambda x: (F.length(x["label"]) > 2) & F.contains(F.col("q"), bare(F.lower(x["label"])))), F.lit(0))
    field = F.when(named.isNotNull(), say(F.concat(F.when(filled(named), 'Yes — "').otherwise('No — "'), named["label"], F.when(filled(named), '" has a value.').otherwise('" is empty.')), 0.9))

    required = F.filter("f", lambda x: x["required"] & ~of_type(x).isin("submit", "button", "reset", "image"))
    open_ = F.filter(required, lambda x: ~filled(x))
    complete = F.when(F.size(required) == 0, say(F.lit("This form has no required fields."), 0.9)).when(F.size(open_) == 0, say(F.concat(F.lit("Yes — all "), F.size(required), F.lit(" required fields have values.")), 0.95)).otherwise(say(F.concat(F.lit("Not yet — "), F.size(open_), F.lit(" of "), F.size(required), F.lit(" required fields are still empty.")), 0.95))

    count = F.coalesce("sensitive", F.lit(0))
    private = F.when(count == 0, say(F.lit("No sensitive fields were detected on this page."), 0.85)).otherwise(say(F.concat(F.lit("Yes — "), count, F.when(count == 1, " sensitive region").otherwise(" sensitive regions"), F.lit(" detected and redacted before anything left the device.")), 0.9))
    found = F.coalesce(where, F.when(q.rlike(FILE_WORDS), upload), F.when(asks_fill, fill), field, F.when(_word(q, "complete|finished|done|missing|empty|filled|left|remaining"), complete), F.when(_word(q, "pii|sensitive|private|personal|secure|safe|redact"), private), say(F.lit(""), 0.0, True))
    return rows.withColumn("a", found).select("page_id", "question", "a.text", "a.confidence", "a.needs_vision")


def _categories() -> Column:
    from privlake.operators.forms import field_categories

    return field_categories()


def attached_names(value: Column) -> Column:
    """A file's own name without the path that a browser shows."""
    return basename(value)


def find_elements(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """Targets (page_id, target) with the ord of the element meant, and the number of the rule that found it.

    Rules in order: [n] is the n-th; id; name; ARIA label; placeholder; a button's or link's exact text, text that contains the target, text with all its words, and
    the nearest text within max(2, 30 %) edits. Elements have page_id, ord, id, name, aria_label, placeholder, tag, role, text. A target that finds nothing has nulls.
    """
    t = F.lower("target")
    index = F.regexp_extract("target", r"^\[([0-9]+)\]\z", 1)
    text = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    clickable = F.col("tag").isin("button", "a") | F.coalesce(F.col("role").isin("button", "link", "tab", "menuitem"), F.lit(False))
    distance = F.levenshtein(t, F.left(text, F.length(t) + 5))
    most = F.greatest(F.lit(2), F.floor(F.length(t) * 3 / 10))
    rule = (
        F.when(index != "", F.when(F.col("ord") == index.try_cast("int"), 0))
        .when(F.col("id") == F.col("target"), 1)
        .when(F.col("name") == F.col("target"), 3)
        .when(F.col("aria_label") == F.col("target"), 4)
        .when(F.col("placeholder") == F.col("target"), 5)
        .when(clickable & (text == t), 7)
        .when(clickable & F.contains(text, t), 8)
        .when(clickable & F.forall(F.split(t, r"\s+"), lambda w: F.contains(text, w)), 9)
        .when(clickable & (text != "") & (distance <= most), 10)
    )
    pairs = targets.where(F.coalesce("target", F.lit("")) != "").join(elements, "page_id").withColumn("rule", rule).where("rule is not null")
    best = pairs.groupBy("page_id", "target").agg(F.min(F.struct("rule", F.when(F.col("rule") == 10, distance).otherwise(0).alias("far"), "ord")).alias("b"))
    return targets.join(best, ["page_id", "target"], "left").select("page_id", "target", F.col("b.ord").alias("ord"), F.col("b.rule").alias("rule"))
