"""Queries over form fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.operators import answers, extraction, intents
from privlake.operators import forms as f
from privlake.plans.registry import query
from privlake.plans.text import _kept
from privlake.sources.tables import FORM_FIELDS, USER_DATA, derived, form_fields

_CONTEXT = "lower(concat_ws(' ', name, id, CASE WHEN length(trim(label)) <= 60 THEN trim(label) ELSE '' END, type, pattern))"
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(ctx, '{p}') THEN '{c}' END" for c, p in f.FIELD_RULES) + ")"
_SELECTOR = "CASE WHEN id <> '' THEN '#' || id WHEN name <> '' THEN '[name=\"' || name || '\"]' END"
_NON = ", ".join(f"'{x}'" for x in f.NON_DATA_TYPES)
_FOUND = f"""ff AS ({FORM_FIELDS}), c AS (SELECT *, {_CONTEXT} AS ctx FROM ff), d AS (SELECT *, CASE WHEN type IN ({_NON}) THEN [] WHEN type = 'password' THEN ['password']
 ELSE list_filter([CASE WHEN regexp_matches(ctx, '{f.PASSWORD}') THEN 'password' END, {_FIRST}], lambda x: x IS NOT NULL) END AS cats FROM c)"""


@query(f"WITH {_FOUND} SELECT page_id, ord, array_to_string(cats, ',') AS categories FROM d")
def field_rules(spark, sf_dir):
    return form_fields(spark, sf_dir).select("page_id", "ord", F.array_join(f.field_categories(), ",").alias("categories"))


_KIND = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(kind, '{p}') THEN '{c}' END" for c, p in f.VALUE_KINDS) + ", type)"
_FITS = "CASE cat " + " ".join(f"WHEN '{c}' THEN regexp_matches(value, '{p}')" for c, p in f.VALUE_PATTERNS.items()) + " END"
_VALIDATED = f"""WITH ff AS ({FORM_FIELDS}), a AS (SELECT *, lower(concat_ws(' ', name, label)) AS kind FROM ff), b AS (SELECT *, {_KIND} AS cat FROM a), e AS (SELECT *, {_FITS} AS fits FROM b),
r AS (SELECT *, CASE WHEN required AND trim(value) = '' THEN 'required' WHEN trim(value) = '' THEN 'optional' WHEN max_length > 0 AND length(value) > max_length THEN 'maxLength' WHEN pattern <> '' AND NOT regexp_matches(value, pattern) THEN 'pattern' WHEN fits IS NULL THEN 'none' ELSE cat END AS rule FROM e),
v AS (SELECT *, rule IN ('optional', 'none') OR (rule NOT IN ('required', 'maxLength', 'pattern') AND coalesce(fits, false)) AS valid FROM r),
w AS (SELECT page_id, form_id, ord, CASE WHEN label <> '' THEN label WHEN name <> '' THEN name ELSE id END AS field_name, rule, valid, CASE WHEN valid THEN 'low' WHEN rule = 'pattern' THEN 'medium' ELSE 'high' END AS risk FROM v)"""


@query(_VALIDATED + " SELECT * FROM w")
def validate_form(spark, sf_dir):
    return f.validate_fields(form_fields(spark, sf_dir))


@query(_VALIDATED + " SELECT page_id, form_id, bool_and(valid) AS all_valid, ['low', 'medium', 'high'][max(CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)] AS risk, count_if(NOT valid) AS issues FROM w GROUP BY ALL")
def validation_summary(spark, sf_dir):
    return f.summarise_validation(f.validate_fields(form_fields(spark, sf_dir)))


_PLACEHOLDER = r"(trim({0}) = '' OR regexp_matches(lower(trim({0})), '^(--.*--|-+|select\b.*|choose\b.*|please\s+select.*|none)$'))"
_CONTROL = ", ".join(f"'{x}'" for x in f.CONTROL_TYPES)


_SAID = "CASE rule " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, (m, _) in f.ADVICE.items()) + " END"
_ADVISED = "CASE rule " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, (_, a) in f.ADVICE.items()) + " END"


@query(_VALIDATED + f""", m AS (SELECT w.*, ff.max_length AS most, length(ff.value) AS n, ff.pattern, CASE WHEN rule = 'required' THEN 'This field is required' WHEN rule = 'optional' THEN 'Optional field, empty is OK' WHEN rule = 'maxLength' THEN concat('Maximum ', ff.max_length, ' characters (currently ', length(ff.value), ')') WHEN rule = 'pattern' THEN 'Value doesn''t match required format'
 WHEN rule = 'none' THEN 'No validation rules for this field' WHEN valid THEN concat('Valid ', rule, ' format') ELSE {_SAID} END AS message FROM w JOIN ff USING (page_id, form_id, ord))
SELECT page_id, form_id, ord, field_name, rule, valid, message, CASE WHEN rule = 'maxLength' THEN concat('Trim ', n - most, ' characters') WHEN rule = 'pattern' THEN pattern WHEN NOT valid THEN {_ADVISED} END AS suggestion,
 CASE WHEN NOT valid THEN concat(field_name, ': ', CASE rule WHEN 'required' THEN 'required but empty' WHEN 'maxLength' THEN 'too long' WHEN 'pattern' THEN 'format mismatch' ELSE message END) END AS issue FROM m""")
def validation_messages(spark, sf_dir):
    return f.explain_fields(form_fields(spark, sf_dir))


@query(f"""WITH ff AS ({FORM_FIELDS}), ud AS ({USER_DATA}), k AS (SELECT DISTINCT page_id, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS key FROM ud WHERE value <> ''),
o AS (SELECT *, {_SELECTOR} AS selector FROM ff WHERE required AND type NOT IN ({_CONTROL}) AND (value = '' OR (type = 'select' AND {_PLACEHOLDER.format('value')})))
SELECT page_id, form_id, ord, CASE WHEN label <> '' THEN label WHEN name <> '' THEN name ELSE id END AS label, selector,
 CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.page_id = o.page_id AND k.key IN (regexp_replace(lower(o.name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(o.id), '[^a-z0-9]', '', 'g'), regexp_replace(lower(o.label), '[^a-z0-9]', '', 'g'))) THEN 'still_empty_after_run' ELSE 'no_local_value' END AS reason,
 CAST(CASE WHEN opts = '' THEN 0 ELSE len(list_filter(string_split(opts, '|'), lambda x: NOT {_PLACEHOLDER.format('x')})) END AS INT) AS choices FROM o WHERE selector IS NOT NULL""")
def required_inputs(spark, sf_dir):
    return f.requirements(form_fields(spark, sf_dir), derived(spark, sf_dir, USER_DATA, "customer"))


@query(f"WITH {_FOUND}, x AS (SELECT page_id, {_SELECTOR} AS selector, ord, cats, unnest(range(1, len(cats) + 1)) AS k FROM d) SELECT page_id, selector, arg_min(cats[k], ord * 10 + k) AS first_category, arg_max(cats[k], ord * 10 + k) AS last_category FROM x WHERE selector IS NOT NULL GROUP BY ALL")
def first_vs_last_match(spark, sf_dir):
    return f.first_and_last_category(form_fields(spark, sf_dir))


@query(f"WITH ff AS ({FORM_FIELDS}), r AS (SELECT * FROM ff WHERE type = 'radio') SELECT page_id, form_id, name AS \"group\", coalesce(arg_min(label, ord) FILTER (checked), '(none selected)') AS selected, min(ord) AS ord FROM r GROUP BY ALL")
def radio_groups(spark, sf_dir):
    return f.collapse_radios(form_fields(spark, sf_dir))


@query(f"WITH ff AS ({FORM_FIELDS}) SELECT page_id, count(*) AS total, count_if(trim(value) <> '') AS filled, count_if(required) AS required, count_if(required AND trim(value) = '') AS missing, round(count_if(trim(value) <> '') / count(*), 6) AS ratio FROM ff GROUP BY page_id")
def completion_ratio(spark, sf_dir):
    return f.completion(form_fields(spark, sf_dir))


def _source_sql() -> str:
    sure, fair = [], []
    for source, patterns in intents.DATA_SOURCES:
        for p in patterns:
            p = p.replace(intents.B, r"\b")
            sure.append(f"CASE WHEN regexp_matches(ctx, '{p}') AND contains(lower(label), coalesce(list_filter(ws, lambda w: regexp_matches(w, '{p}'))[1], '')) THEN '{source}|0.95' END")
            fair.append(f"CASE WHEN regexp_matches(ctx, '{p}') THEN '{source}|0.85' END")
    return f"coalesce({', '.join(sure + fair)})"


@query(f"WITH ff AS ({FORM_FIELDS}), a AS (SELECT *, lower(concat_ws(' ', label, name, id, '')) AS ctx FROM ff), b AS (SELECT *, string_split(ctx, ' ') AS ws FROM a), c AS (SELECT page_id, ord, {_source_sql()} AS r FROM b) SELECT page_id, ord, split_part(r, '|', 1) AS source, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence FROM c WHERE r IS NOT NULL")
def planned_sources(spark, sf_dir):
    rows = form_fields(spark, sf_dir).withColumn("s", intents.data_source(F.col("label"), F.col("name"), F.col("id"))).where("s is not null")
    return rows.select("page_id", "ord", "s.source", "s.confidence")


_EXTRACTED = (
    _kept(f"SELECT page_id * 100 + ord AS id, value AS body FROM ({FORM_FIELDS}) WHERE value <> ''", False)
    + f""", {_FOUND}, dx AS (SELECT page_id, {_SELECTOR} AS selector, ord, cats, unnest(range(1, len(cats) + 1)) AS k FROM d), dc AS (SELECT page_id, selector, arg_max(cats[k], ord * 10 + k) AS declared FROM dx WHERE selector IS NOT NULL GROUP BY ALL),
hit AS (SELECT id AS hid, arg_min(category, s) AS category FROM kept GROUP BY id), ds AS (SELECT *, {_SELECTOR} AS selector FROM d WHERE type <> 'radio'),
j AS (SELECT ds.*, dc.declared, hit.category AS scanned FROM ds LEFT JOIN dc ON ds.page_id = dc.page_id AND ds.selector = dc.selector LEFT JOIN hit ON hid = ds.page_id * 100 + ds.ord),
m AS (SELECT *, type <> 'password' AND value <> '' AND (scanned IS NOT NULL OR (declared IS NOT NULL AND length(value) > 4)) AS hide FROM j),
x AS (SELECT page_id, form_id, ord, label, CASE WHEN type = 'password' THEN CASE WHEN value <> '' THEN '(password withheld)' ELSE '' END WHEN hide THEN CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || repeat('*', least(length(value) - 4, 12)) || right(value, 2) END ELSE value END AS value, type,
 CASE WHEN type = 'password' THEN 'password' WHEN hide THEN coalesce(declared, scanned) END AS pii_category, type = 'password' OR hide AS masked FROM m
 UNION ALL SELECT page_id, form_id, min(ord), name, coalesce(arg_min(label, ord) FILTER (checked), '(none selected)'), 'radio', NULL, false FROM ff WHERE type = 'radio' GROUP BY page_id, form_id, name)"""
)


@query(_EXTRACTED + " SELECT * FROM x")
def extract_fields(spark, sf_dir):
    return extraction.extract_fields(form_fields(spark, sf_dir))


@query(_EXTRACTED + " SELECT page_id, count(DISTINCT form_id) AS sections, count(*) AS fields, count_if(value <> '') AS filled, count_if(masked) AS masked FROM x GROUP BY page_id")
def extraction_summary(spark, sf_dir):
    return extraction.summarise_extraction(extraction.extract_fields(form_fields(spark, sf_dir)))


_QUESTIONS = """SELECT c_custkey AS page_id, CASE c_custkey % 7 WHEN 0 THEN 'Where is the submit button?' WHEN 1 THEN 'did I upload my photo' WHEN 2 THEN 'what do I have to fill here' WHEN 3 THEN 'is my Mobile Number there' WHEN 4 THEN 'is the form complete' WHEN 5 THEN 'is anything private here' ELSE 'hello' END AS question FROM customer"""
_ELEMENTS = """SELECT c_custkey AS page_id, t.ord AS ord, t.tag AS tag, t.role AS role, t.text AS text, t.label AS label, t.type AS type, t.id AS id, t.name AS name, t.aria AS aria_label, t.ph AS placeholder, CAST(c_custkey % 1400 AS DOUBLE) AS x, CAST(c_custkey * 3 % 1200 - 100 AS DOUBLE) AS y, CAST(80 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h
FROM customer CROSS JOIN (VALUES (0, 'a', '', 'Home page', '', '', 'home', '', '', ''), (1, 'input', '', '', 'Mobile Number', 'tel', 'mobile', 'mobile', 'phone box', 'ten digits'), (2, 'button', '', 'Submit Request', '', 'submit', 'go', '', '', ''), (3, 'div', 'tab', 'Details of account', '', '', '', '', '', '')) AS t(ord, tag, role, text, label, type, id, name, aria, ph)"""
_TARGETS = """SELECT c_custkey AS page_id, CASE c_custkey % 9 WHEN 0 THEN '[2]' WHEN 1 THEN 'mobile' WHEN 2 THEN 'phone box' WHEN 3 THEN 'ten digits' WHEN 4 THEN 'submit request' WHEN 5 THEN 'Submit' WHEN 6 THEN 'account details' WHEN 7 THEN 'sumbit requst' ELSE 'nothing like it' END AS target FROM customer"""
_THIRDS = "CASE WHEN cx < 480 THEN 'on the left' WHEN cx > 960 THEN 'on the right' ELSE 'in the centre' END"


@query(f"""WITH qs AS ({_QUESTIONS}), {_FOUND}, p AS (SELECT page_id, count_if(value = '' AND required AND type NOT IN ('submit', 'button', 'reset', 'image', 'hidden')) AS need, count_if(value = '' AND type NOT IN ('submit', 'button', 'reset', 'image', 'hidden')) AS emp,
 list(label ORDER BY ord) FILTER (value = '' AND required) AS rl, list(label ORDER BY ord) FILTER (value = '') AS el, count_if(required) AS req, count_if(required AND value = '') AS miss, count_if(len(cats) > 0) AS sens, arg_min(value, ord) FILTER (label = 'Mobile Number') AS mob FROM d GROUP BY page_id),
g AS (SELECT qs.page_id, question, p.*, CAST(qs.page_id % 1400 + 40 AS DOUBLE) AS cx, CAST(qs.page_id * 3 % 1200 - 90 AS DOUBLE) AS cy, CASE WHEN need > 0 THEN rl ELSE el END AS tl, CASE WHEN need > 0 THEN 'required' ELSE 'empty' END AS srt FROM qs JOIN p USING (page_id))
SELECT page_id, question, CASE page_id % 7
 WHEN 0 THEN '"Submit Request" is ' || CASE WHEN cy < 0 THEN 'above the current view — scroll up to reach it (' || {_THIRDS} || ')' WHEN cy > 900 THEN 'below the current view — scroll down to reach it (' || {_THIRDS} || ')' ELSE CASE WHEN cy < 300 THEN 'near the top' WHEN cy > 600 THEN 'near the bottom' ELSE 'in the middle' END || ' of the visible page, ' || {_THIRDS} END || '.'
 WHEN 1 THEN 'There is no file-upload field on this page.'
 WHEN 2 THEN CASE WHEN tl IS NULL THEN 'Nothing — every field on this page already has a value.' WHEN len(tl) = 1 THEN 'One ' || srt || ' field: "' || tl[1] || '".' ELSE len(tl) || ' ' || srt || ' fields to fill: ' || array_to_string(tl[1:8], ', ') || CASE WHEN len(tl) > 8 THEN ', …' ELSE '' END || '.' END
 WHEN 3 THEN CASE WHEN mob <> '' THEN 'Yes — "Mobile Number" has a value.' ELSE 'No — "Mobile Number" is empty.' END
 WHEN 4 THEN CASE WHEN miss = 0 THEN 'Yes — all ' || req || ' required fields have values.' ELSE 'Not yet — ' || miss || ' of ' || req || ' required fields are still empty.' END
 WHEN 5 THEN 'Yes — ' || sens || ' sensitive regions detected and redacted before anything left the device.' ELSE '' END AS text,
 CAST(CASE page_id % 7 WHEN 0 THEN 0.92 WHEN 1 THEN 0.8 WHEN 2 THEN CASE WHEN tl IS NULL THEN 0.9 ELSE 0.95 END WHEN 3 THEN 0.9 WHEN 4 THEN 0.95 WHEN 5 THEN 0.9 ELSE 0 END AS DOUBLE) AS confidence, page_id % 7 IN (1, 6) AS needs_vision FROM g""")
def answer_questions(spark, sf_dir):
    return answers.answer(derived(spark, sf_dir, _QUESTIONS, "customer"), form_fields(spark, sf_dir), derived(spark, sf_dir, _ELEMENTS, "customer"))


@query(f"WITH t AS ({_TARGETS}) SELECT page_id, target, CASE page_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 2 END AS ord, CASE page_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 8 WHEN 6 THEN 9 WHEN 7 THEN 10 END AS rule FROM t")
def find_elements(spark, sf_dir):
    return answers.find_elements(derived(spark, sf_dir, _TARGETS, "customer"), derived(spark, sf_dir, _ELEMENTS, "customer"))
