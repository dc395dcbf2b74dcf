"""Queries of the page detector and of what may leave a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.operators import detector as d
from privlake.plans.forms import _FOUND, _SELECTOR
from privlake.plans.registry import query
from privlake.plans.text import _LUHN_D, _VERHOEFF, _kept
from privlake.sources.tables import PAGE_ELEMENTS, PAGE_TEXTS, derived, form_fields


def _inputs(spark, sf_dir):
    return form_fields(spark, sf_dir), derived(spark, sf_dir, PAGE_ELEMENTS, "customer"), derived(spark, sf_dir, PAGE_TEXTS, "customer")


def _regions(spark, sf_dir):
    return d.detect_page(*_inputs(spark, sf_dir))


_SURE = "CASE cats[k] " + " ".join(f"WHEN '{c}' THEN contains(ctx, '{w}')" for c, w in d.FIRST_KEYWORD.items()) + " END"
_CHECK = {"aadhaar": _VERHOEFF, "pan": "regexp_full_match(d, '[A-Z]{3}[PCHFATBLJGKE][A-Z][0-9]{4}[A-Z]')", "financial": _LUHN_D, "ifsc": "true", "phone": "regexp_full_match(d, '[6-9][0-9]{9}')"}
_B2 = " UNION ALL ".join(f"SELECT page_id, ord AS i, {k} AS k, '{c}' AS category, id, x, y, w, h, regexp_extract(text, '{p}') AS f FROM el" for k, (c, p) in enumerate(d.TEXT_PATTERNS))
_B3 = " UNION ALL ".join(f"SELECT page_id, {k} AS k, '{c}' AS category, regexp_extract_all(text, '{p}') AS f FROM pt" for k, (c, p) in enumerate(d.TEXT_PATTERNS))
_B4 = " UNION ALL ".join(
    f"SELECT page_id, {k} AS k, '{c}' AS category, CAST({q} AS DOUBLE) AS confidence, v, m FROM (SELECT *, regexp_replace(v, '\\s', '', 'g') AS d FROM (SELECT page_id, unnest(f) AS v, unnest(range(len(f))) AS m FROM (SELECT page_id, regexp_extract_all(text, '{d.CHECKED_PATTERNS[c]}'){'' if c == 'phone' else '[1:1]'} AS f FROM corpus))) WHERE {_CHECK[c]}"
    for k, (c, q) in enumerate(d.CHECKED)
)
_BLACK = ", ".join(f"'{c}'" for c in d.BLACK_BOX)
_DETECTED = f"""{_FOUND}, el AS ({PAGE_ELEMENTS}), pt AS ({PAGE_TEXTS}),
rects AS (SELECT page_id, id AS element_id, arg_min({{'x': x, 'y': y, 'w': w, 'h': h}}, ord) AS r FROM el GROUP BY ALL),
b1 AS (SELECT q.page_id, 1 AS branch, ord AS i, k - 1 AS k, 0 AS m, cats[k] AS category, nullif(value, '') AS text_value, {_SELECTOR} AS field_selector, CASE WHEN {_SURE} THEN 0.95 ELSE 0.8 END AS confidence, r.x AS x, r.y AS y, r.w AS w, r.h AS h
 FROM (SELECT *, unnest(range(1, len(cats) + 1)) AS k FROM d) q LEFT JOIN rects ON rects.page_id = q.page_id AND element_id = CASE WHEN id <> '' THEN id ELSE name END),
b2 AS (SELECT page_id, 2, i, k, 0, category, f, CASE WHEN id <> '' THEN '#' || id END, 0.85, x, y, w, h FROM ({_B2}) WHERE f <> ''),
b3 AS (SELECT page_id, 3, 0, k, unnest(range(len(f))), category, unnest(f), CAST(NULL AS VARCHAR), 0.7, NULL, NULL, NULL, NULL FROM ({_B3})),
words AS (SELECT page_id, 0 AS b, ord, text AS t FROM el UNION ALL SELECT page_id, 1, ord, concat(label, ' ', value, ' ', name, ' ', id) FROM ff UNION ALL SELECT page_id, 2, 0, text FROM pt),
corpus AS (SELECT page_id, string_agg(t, ' ' ORDER BY b, ord) AS text FROM words GROUP BY page_id),
b4 AS (SELECT page_id, 4, 0, k, m, category, v, CAST(NULL AS VARCHAR), confidence, NULL, NULL, NULL, NULL FROM ({_B4})),
u AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, text_value ORDER BY branch, i, k, m) AS nth FROM u),
regions AS (SELECT *, 'pii-dom-' || row_number() OVER (PARTITION BY page_id ORDER BY branch, i, k, m) AS region_id, CASE WHEN category IN ({_BLACK}) THEN 'black_box' ELSE 'mask_text' END AS strategy FROM n WHERE branch <= 2 OR nth = 1),
vals AS (SELECT page_id, list(text_value ORDER BY branch, i, k, m) AS vals FROM (SELECT * FROM n WHERE nth = 1 AND text_value IS NOT NULL) GROUP BY page_id)"""
_SCRUB = "CASE WHEN vals IS NULL THEN {0} ELSE list_reduce(vals, lambda a, v: replace(a, v, '***'), {0}) END"


@query(f"WITH {_DETECTED} SELECT page_id, region_id, category, text_value, field_selector, CAST(confidence AS DOUBLE) AS confidence, strategy, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM regions")
def page_detector(spark, sf_dir):
    return _regions(spark, sf_dir).select("page_id", "region_id", "category", "text_value", "field_selector", "confidence", "strategy", *(F.col(f"rect.{c}").alias(c) for c in "xywh"))


@query(f"WITH {_DETECTED} SELECT category, strategy, count(*) AS n, count(DISTINCT page_id) AS pages, count_if(x IS NOT NULL) AS placed, round(avg(confidence), 6) AS confidence FROM regions WHERE confidence >= 0.8 GROUP BY ALL")
def regions_by_category(spark, sf_dir):
    found = d.all_regions(_regions(spark, sf_dir), threshold=0.8)
    return found.groupBy("category", "strategy").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.count("rect").alias("placed"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _masked(source: str, last: str) -> str:
    """`last` over `done` (id, masked), from rows (id, body) after the known values were scrubbed."""
    return _kept(f"WITH {_DETECTED} {source}", False) + f""", cuts AS (SELECT id, s, e, category, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS p FROM kept),
built AS (SELECT c.id, string_agg(substr(body, c.p + 1, c.s - c.p) || '[REDACTED:' || category || ']', '' ORDER BY c.s) AS head, max(e) AS last FROM cuts c JOIN src USING (id) GROUP BY c.id),
done AS (SELECT src.id AS id, CASE WHEN built.id IS NULL THEN body ELSE head || substr(body, last + 1) END AS masked FROM src LEFT JOIN built ON src.id = built.id) {last}"""


@query(_masked(f"SELECT page_id AS id, {_SCRUB.format('text')} AS body FROM pt LEFT JOIN vals USING (page_id)", f", g AS (WITH {_DETECTED} SELECT page_id, count(*) AS total, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies FROM regions GROUP BY page_id) SELECT id AS page_id, masked AS text, coalesce(total, 0) AS total, coalesce(categories, '') AS categories, coalesce(strategies, '') AS strategies FROM done LEFT JOIN g ON id = page_id"))
def sanitised_pages(spark, sf_dir):
    return d.sanitised_pages(derived(spark, sf_dir, PAGE_TEXTS, "customer"), _regions(spark, sf_dir))


@query(_masked(f"SELECT page_id * 100 + ord AS id, {_SCRUB.format('text')} AS body FROM el LEFT JOIN vals USING (page_id)", "SELECT id // 100 AS page_id, CAST(id % 100 AS INT) AS ord, masked AS label FROM done"))
def sanitised_elements(spark, sf_dir):
    return d.sanitised_elements(derived(spark, sf_dir, PAGE_ELEMENTS, "customer"), _regions(spark, sf_dir)).select("page_id", "ord", "label")


@query(_masked(f"SELECT page_id * 100 + ord AS id, {_SCRUB.format('label')} AS body FROM ff LEFT JOIN vals USING (page_id)", f", g AS (WITH {_DETECTED}, f1 AS (SELECT page_id, field_selector, arg_min(category, branch * 1000000 + i * 1000 + k * 10 + m) AS pii_category FROM regions WHERE field_selector IS NOT NULL GROUP BY ALL) SELECT ff.page_id, form_id, ord, type, value, required, pii_category FROM ff LEFT JOIN f1 ON f1.page_id = ff.page_id AND field_selector = {_SELECTOR}) SELECT page_id, form_id, ord, masked AS label, type, value <> '' AS has_value, required AS is_required, pii_category FROM g JOIN done ON id = page_id * 100 + ord"))
def sanitised_fields(spark, sf_dir):
    return d.sanitised_fields(form_fields(spark, sf_dir), _regions(spark, sf_dir))


@query(f"WITH {_DETECTED}, f1 AS (SELECT page_id, field_selector, arg_max(category, branch * 1000000 + i * 1000 + k * 10 + m) AS category FROM regions WHERE field_selector IS NOT NULL GROUP BY ALL), o AS (SELECT *, {_SELECTOR} AS selector FROM ff) SELECT o.page_id, form_id, ord, CASE WHEN label <> '' THEN label WHEN name <> '' THEN name ELSE id END AS label, selector, category, CASE WHEN type = 'password' THEN '' ELSE value END AS value, required, type FROM o LEFT JOIN f1 ON f1.page_id = o.page_id AND field_selector = selector WHERE type NOT IN ('checkbox', 'radio', 'submit', 'button', 'reset', 'image') AND selector IS NOT NULL AND (category IS NOT NULL OR value <> '')")
def review_fields(spark, sf_dir):
    return d.review_fields(form_fields(spark, sf_dir), _regions(spark, sf_dir))
