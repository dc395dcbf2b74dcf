"""What runs, requests and pages report: lines of a trace, narrated actions, bodies as text, scores, roles, tiers and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privlake.functions.text import B

#: How many characters of a payload are kept, and how many payloads of each origin.
PAYLOAD_CHARS = 60_000
PAYLOADS = 5
#: Words of tasks that a form planner takes, and of those that it doesn't.
FORM_WORDS = ("fill", "complete", "submit", "apply", "form")
OTHER_WORDS = ("search", "find", "navigate", "open", "go to", "compare", "analyze")
#: Signs of a page that asks for proof of a person, and of one that takes payments.
CAPTCHA = r"(?i)recaptcha|hcaptcha|turnstile|cf-challenge"
PAYMENT = r"(?i)payment|card number|cvv|expiry|billing"


def trace_line(phase: Column, confidence: Column, risk: Column, summary: Column) -> Column:
    """Sign of the risk, the phase in 18 places, the summary and the confidence as a percentage in 4 places."""
    sign = F.when(risk == "high", "🔴").when(risk == "medium", "🟡").otherwise("🟢")
    name = F.concat(F.lit("["), phase, F.lit("]"))
    share = F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat(sign, F.lit(" "), F.rpad(name, F.greatest(F.lit(18), F.length(name)), F.lit(" ")), F.lit(" "), summary, F.lit(" ("), F.lpad(share, F.greatest(F.lit(4), F.length(share)), F.lit(" ")), F.lit(")"))


def narrated(kind: Column, target: Column, value: Column) -> Column:
    """An action in words; typed values are cut at 30 characters."""
    named = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    v = F.coalesce(value, F.lit(""))
    typed = F.concat(F.left(v, F.lit(30)), F.when(F.length(v) > 30, "...").otherwise(""))
    lines = {"click": F.concat(F.lit('Clicking "'), named(target, "element"), F.lit('"')), "type": F.concat(F.lit('Typing "'), typed, F.lit('" into "'), named(target, "field"), F.lit('"')), "scroll": F.concat(F.lit("Scrolling "), named(value, "down")), "navigate": F.concat(F.lit("Navigating to "), v), "select": F.concat(F.lit('Selecting "'), v, F.lit('" from "'), F.coalesce(target, F.lit("")), F.lit('"')), "wait": F.concat(F.lit("Waiting "), named(value, "for page"), F.lit("..."))}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, line in lines.items():
        out = out.when(kind == k, line)
    return out.otherwise(F.concat(F.lit("Executing "), kind))


def body_text(kind: Column, text: Column, parts: Column, data: Column) -> Column:
    """A request's body as text: text as it is, params and form parts as key=value joined by &, files as [file], bytes decoded; of a stream, nothing.

    `parts` are structs key, value, is_file; bytes that are no UTF-8 become replacement signs.
    """
    params = F.array_join(F.transform(parts, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    form = F.array_join(F.transform(parts, lambda p: F.concat(p["key"], F.lit("="), F.when(p["is_file"], "[file]").otherwise(p["value"]))), "&")
    return F.coalesce(F.when(kind == "text", text).when(kind == "params", params).when(kind == "form", form).when(kind.isin("blob", "buffer"), F.make_valid_utf8(data.cast("string"))), F.lit(""))


def elided(body: Column) -> Column:
    """The text with each long embedded image as a note of its size."""
    pattern = r'"data:image\/[a-z+]+;base64,[A-Za-z0-9+/=]{40,}"'
    notes = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit('"data:image/…;base64,<'), F.floor(F.length(m) / 1024 + 0.5).cast("string"), F.lit(' KB of redacted image>"')))
    return F.array_join(F.zip_with(F.split(body, pattern, -1), notes, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def payloads(requests: DataFrame) -> DataFrame:
    """The last payloads of each origin, cut in length, with their bytes before the cut."""
    body = F.coalesce("body", F.lit(""))
    place = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("ts"), F.desc("request_id")))
    rows = requests.withColumn("place", place).where(F.col("place") <= PAYLOADS)
    return rows.select("origin", "place", "request_id", F.left(body, F.lit(PAYLOAD_CHARS)).alias("body"), F.octet_length(body).cast("long").alias("bytes"), (F.length(body) > PAYLOAD_CHARS).alias("truncated"))


def penalty_score(n: Column) -> Column:
    """100 less 10 for each, 0 at least."""
    return F.greatest(F.lit(0), 100 - 10 * n)


def is_clean(outbound: Column, blocked: Column) -> Column:
    return (outbound == 0) & (blocked == 0)


def fill_status(filled: Column, required: Column) -> Column:
    return F.when(filled, "✓").when(required, "⚠️ required").otherwise("○ optional")


def form_task(task: Column, fields: Column) -> Column:
    """Whether a task is one of filling in the form at hand."""
    low = F.lower(F.coalesce(task, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return any_of(FORM_WORDS) & ~any_of(OTHER_WORDS) & (fields > 0)


def role(tag: Column, kind: Column) -> Column:
    """The role of an element that names none."""
    t, k = F.lower(tag), F.lower(F.coalesce(kind, F.lit("")))
    of_input = F.when(k == "submit", "button").when(k.isin("checkbox", "radio"), k).otherwise("textbox")
    return F.when(t == "a", "link").when(t == "button", "button").when(t == "input", of_input).when(t == "select", "combobox").when(t == "textarea", "textbox").otherwise("generic")


def page_confidence(elements: Column, labelled: Column, forms: Column, captcha: Column, honeypot: Column, secure: Column) -> Column:
    """How far a page's elements can be relied on, from 0 to 1, in hundredths and their parts: exact up to rounding to six digits."""
    yes = lambda c, x: F.when(c, x).otherwise(0.0)
    total = 0.5 + yes(elements > 5, 0.15) + yes(elements > 15, 0.1) + F.when(elements > 0, labelled / elements * 0.15).otherwise(0.0) + yes(forms > 0, 0.1) - yes(captcha, 0.3) - yes(honeypot, 0.1) + yes(secure, 0.05)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page: interactive elements, labelled ones, forms, signs of captcha and payment, confidence, and whether the elements suffice."""
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.regexp_count(html, F.lit(p))
    rows = pages.select("page_id", count(r"(?i)<(a|button|input|select|textarea)" + B).alias("elements"), count(r"(?i)<(a|button)" + B + r"[^>]*>[^<]*[^<\s][^<]*<").alias("labelled"), count(r"(?i)<form" + B).alias("forms"), html.rlike(CAPTCHA).alias("has_captcha"), html.rlike(PAYMENT).alias("has_payment"), F.coalesce(F.startswith("url", F.lit("https:")), F.lit(False)).alias("is_secure"))
    rows = rows.withColumn("confidence", page_confidence(F.col("elements"), F.col("labelled"), F.col("forms"), F.col("has_captcha"), F.lit(False), F.col("is_secure")))
    return rows.withColumn("sufficient", (F.col("confidence") >= 0.7) & (F.col("elements") >= 2) & ~F.col("has_captcha"))


def tier(gpu: Column, simd: Column, cores: Column, memory_gb: Column) -> Column:
    """A with a GPU, B with vector instructions and four cores, if memory is unknown (0) or 4 GB at least; else C."""
    enough = (memory_gb == 0) | (memory_gb >= 4)
    return F.when(gpu & enough, "A").when(simd & (cores >= 4) & enough, "B").otherwise("C")


def tier_rank(t: Column) -> Column:
    return F.when(t == "A", 2).when(t == "B", 1).otherwise(0)


def pixels_may_leave(frame: Column, verified: Column, faces_ran: Column) -> Column:
    """Only if all three are known to be so."""
    return F.coalesce(frame & verified & faces_ran, F.lit(False))


def overlaid(defaults: DataFrame, stored: DataFrame, env: DataFrame, *keys: str) -> DataFrame:
    """Settings (keys, name, value): what is stored, else the environment's, else the default, with the source. `env` and `defaults` hold for all keys."""
    names = stored.select(*keys).distinct().join(defaults.withColumnRenamed("value", "_default").join(env.withColumnRenamed("value", "_env"), "name", "left"))
    out = names.join(stored.withColumnRenamed("value", "_stored"), [*keys, "name"], "left")
    return out.select(*keys, "name", F.coalesce("_stored", "_env", "_default").alias("value"), F.when(F.col("_stored").isNotNull(), "stored").when(F.col("_env").isNotNull(), "env").otherwise("default").alias("source"))


def standalone_labels(elements: DataFrame, fields: DataFrame) -> DataFrame:
    """Labels, or else texts, of elements that are no field's label, in any case; the first of each on a page."""
    label = F.trim(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("text"), F.lit("")))
    rows = elements.select("page_id", "ord", label.alias("label"), F.lower(label).alias("low")).where("label <> ''")
    rows = rows.join(fields.select("page_id", F.lower("label").alias("low")), ["page_id", "low"], "left_anti")
    return rows.groupBy("page_id", "low").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord")).drop("low")


def written(review: DataFrame, targets: DataFrame) -> DataFrame:
    """Review rows that a target (page_id, target) names by selector, by selector without #, or by label in any case. A page's targets are gathered, never more; review rows are made once."""
    named = targets.groupBy("page_id").agg(F.collect_set("target").alias("_named"), F.collect_set(F.lower("target")).alias("_low"))
    keys = F.array_compact(F.array("selector", F.regexp_replace("selector", "^#", "")))
    hit = F.arrays_overlap("_named", keys) | F.coalesce(F.array_contains("_low", F.lower("label")), F.lit(False))
    return review.join(named, "page_id").where(hit).select(review.columns)


def bounding_box(points: Column) -> Column:
    """Struct x, y, w, h of the smallest upright box around an array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def probabilities(values: Column) -> Column:
    """The values if they all lie from -0.01 to 1.01, else each through the logistic function."""
    return F.when((F.array_min(values) >= -0.01) & (F.array_max(values) <= 1.01), values).otherwise(F.transform(values, lambda x: 1 / (1 + F.exp(-x))))


def recognised(primary: DataFrame, second: DataFrame, *keys: str, threshold: float = 0.55, least: float = 0.3) -> DataFrame:
    """Texts (keys, text, score) of one recogniser, or, where its score is below `threshold` or it has none, of another with a higher one; those under `least` and blank ones go."""
    a, b = (t.select(*keys, F.struct("text", "score").alias(n)) for t, n in ((primary, "_a"), (second, "_b")))
    other = F.col("_b").isNotNull() & (F.col("_a").isNull() | ((F.col("_a.score") < threshold) & (F.col("_b.score") > F.col("_a.score"))))
    rows = a.join(b, list(keys), "full").select(*keys, F.when(other, F.col("_b")).otherwise(F.col("_a")).alias("r"))
    return rows.select(*keys, F.trim("r.text").alias("text"), "r.score").where((F.col("text") != "") & (F.col("score") >= least))
