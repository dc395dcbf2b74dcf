"""Queries of traces, bodies, scores, roles, tiers and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.operators import detector as d
from privlake.operators import reports as r
from privlake.plans.detector import _DETECTED, _inputs, _regions
from privlake.plans.forms import _SELECTOR
from privlake.plans.registry import query
from privlake.sources.tables import FORM_FIELDS, PAGE_ELEMENTS, REQUESTS, derived, form_fields, table

_STEPS = "SELECT event_id, event_type AS phase, CAST(event_id % 101 AS DOUBLE) / 100 AS confidence, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk FROM events"


@query(f"WITH t AS ({_STEPS}), u AS (SELECT *, '[' || phase || ']' AS p, CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS q FROM t) SELECT event_id, CASE risk WHEN 'high' THEN '🔴' WHEN 'medium' THEN '🟡' ELSE '🟢' END || ' ' || rpad(p, CAST(greatest(18, length(p)) AS INT), ' ') || ' step (' || lpad(q, CAST(greatest(4, length(q)) AS INT), ' ') || ')' AS line FROM u")
def trace_lines(spark, sf_dir):
    return derived(spark, sf_dir, _STEPS, "events").select("event_id", r.trace_line(F.col("phase"), F.col("confidence"), F.col("risk"), F.lit("step")).alias("line"))


_ACTIONS = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' WHEN 3 THEN 'navigate' WHEN 4 THEN 'select' WHEN 5 THEN 'wait' ELSE 'hover' END AS kind, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS target, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN props ELSE concat(props, props, props, props) END AS value FROM events"


@query(f"""WITH t AS ({_ACTIONS}) SELECT event_id, CASE kind WHEN 'click' THEN 'Clicking "' || coalesce(nullif(target, ''), 'element') || '"' WHEN 'type' THEN 'Typing "' || substr(value, 1, 30) || CASE WHEN length(value) > 30 THEN '...' ELSE '' END || '" into "' || coalesce(nullif(target, ''), 'field') || '"'
 WHEN 'scroll' THEN 'Scrolling ' || coalesce(nullif(value, ''), 'down') WHEN 'navigate' THEN 'Navigating to ' || value WHEN 'select' THEN 'Selecting "' || value || '" from "' || target || '"' WHEN 'wait' THEN 'Waiting ' || coalesce(nullif(value, ''), 'for page') || '...' ELSE 'Executing ' || kind END AS line FROM t""")
def narrated_actions(spark, sf_dir):
    return derived(spark, sf_dir, _ACTIONS, "events").select("event_id", r.narrated(F.col("kind"), F.col("target"), F.col("value")).alias("line"))


_BODY_KINDS = "SELECT conv_id, turn, coalesce(text, '') AS text, role, CASE (conv_id + turn) % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'params' WHEN 2 THEN 'form' WHEN 3 THEN 'buffer' ELSE 'stream' END AS kind FROM conversations"


@query(f"WITH t AS ({_BODY_KINDS}) SELECT conv_id, turn, CASE kind WHEN 'text' THEN text WHEN 'params' THEN 'role=' || role || '&a+b=' || turn WHEN 'form' THEN 'role=' || role || '&photo=[file]' WHEN 'buffer' THEN text ELSE '' END AS body FROM t")
def body_texts(spark, sf_dir):
    rows = derived(spark, sf_dir, _BODY_KINDS, "conversations")
    part = lambda k, v, f: F.struct(k.alias("key"), v.alias("value"), F.lit(f).alias("is_file"))
    params = F.array(part(F.lit("role"), F.col("role"), False), part(F.lit("a b"), F.col("turn").cast("string"), False))
    form = F.array(part(F.lit("role"), F.col("role"), False), part(F.lit("photo"), F.lit("x.png"), True))
    parts = F.when(F.col("kind") == "params", params).otherwise(form)
    return rows.select("conv_id", "turn", r.body_text(F.col("kind"), F.col("text"), parts, F.encode("text", "UTF-8")).alias("body"))


_IMAGES = """SELECT conv_id, turn, concat('{"a":"data:image/png;base64,', repeat('QUJD', CAST(5 + conv_id % 9 * turn * 60 AS INT)), '","b":"data:image/x;base64,', repeat('Zm9v', CAST(turn * 300 AS INT)), '"}') AS body FROM conversations"""


@query(f"""WITH t AS ({_IMAGES}), p AS (SELECT *, '"data:image\\/[a-z+]+;base64,[A-Za-z0-9+/=]{{40,}}"' AS rx FROM t), s AS (SELECT conv_id, turn, string_split_regex(body, '"data:image\\/[a-z+]+;base64,[A-Za-z0-9+/=]{{40,}}"') AS g, regexp_extract_all(body, '"data:image\\/[a-z+]+;base64,[A-Za-z0-9+/=]{{40,}}"') AS m FROM p)
SELECT conv_id, turn, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN '"data:image/…;base64,<' || CAST(CAST(floor(length(m[i]) / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB of redacted image>"' ELSE '' END), '') AS body FROM s""")
def elided_bodies(spark, sf_dir):
    return derived(spark, sf_dir, _IMAGES, "conversations").select("conv_id", "turn", r.elided(F.col("body")).alias("body"))


@query(f"WITH rq AS ({REQUESTS}), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY origin ORDER BY ts DESC, request_id DESC) AS INT) AS place FROM rq) SELECT origin, place, request_id, substr(body, 1, 60000) AS body, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, length(body) > 60000 AS truncated FROM p WHERE place <= 5")
def last_payloads(spark, sf_dir):
    return r.payloads(derived(spark, sf_dir, REQUESTS, "conversations"))


@query("SELECT user_id, count_if(event_type = 'purchase') AS outbound, count_if(event_type = 'error') AS blocked, greatest(0, 100 - 10 * count_if(event_type = 'purchase')) AS score, greatest(0, 100 - 10 * count_if(event_type = 'error')) AS residual_score, count_if(event_type IN ('purchase', 'error')) = 0 AS clean FROM events GROUP BY user_id")
def session_scores(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("outbound"), F.count_if(F.col("event_type") == "error").alias("blocked"))
    return counts.select("*", r.penalty_score(F.col("outbound")).alias("score"), r.penalty_score(F.col("blocked")).alias("residual_score"), r.is_clean(F.col("outbound"), F.col("blocked")).alias("clean"))


@query(f"WITH ff AS ({FORM_FIELDS}) SELECT page_id, ord, CASE WHEN CASE WHEN type IN ('radio', 'checkbox') THEN checked ELSE value <> '' END THEN '✓' WHEN required THEN '⚠️ required' ELSE '○ optional' END AS status, CASE type WHEN 'select' THEN 'combobox' WHEN 'radio' THEN 'radio' ELSE 'textbox' END AS role FROM ff")
def field_status(spark, sf_dir):
    kind = F.col("type")
    filled = F.when(kind.isin("radio", "checkbox"), F.col("checked")).otherwise(F.col("value") != "")
    tag = F.when(kind.isin("select", "textarea"), kind).otherwise("input")
    return form_fields(spark, sf_dir).select("page_id", "ord", r.fill_status(filled, F.col("required")).alias("status"), r.role(tag, kind).alias("role"))


_TASKS = "SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN concat('Fill the FORM ', coalesce(text, '')) WHEN 1 THEN 'Open the page and submit' WHEN 2 THEN 'Complete it' WHEN 3 THEN text ELSE 'apply' END AS task, conv_id % 3 AS fields FROM conversations"


@query(f"WITH t AS ({_TASKS}), u AS (SELECT *, lower(coalesce(task, '')) AS low FROM t) SELECT conv_id, turn, ({' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in r.FORM_WORDS)}) AND NOT ({' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in r.OTHER_WORDS)}) AND fields > 0 AS eligible FROM u")
def form_tasks(spark, sf_dir):
    return derived(spark, sf_dir, _TASKS, "conversations").select("conv_id", "turn", r.form_task(F.col("task"), F.col("fields")).alias("eligible"))


@query(r"""WITH h AS (SELECT page_id, coalesce(html, '') AS html, coalesce(starts_with(url, 'https:'), false) AS is_secure FROM pages),
f AS (SELECT page_id, is_secure, CAST(len(regexp_extract_all(html, '(?i)<(a|button|input|select|textarea)\b')) AS INT) AS elements, CAST(len(regexp_extract_all(html, '(?i)<(a|button)\b[^>]*>[^<]*[^<\s][^<]*<')) AS INT) AS labelled, CAST(len(regexp_extract_all(html, '(?i)<form\b')) AS INT) AS forms,
 regexp_matches(html, '(?i)recaptcha|hcaptcha|turnstile|cf-challenge') AS has_captcha, regexp_matches(html, '(?i)payment|card number|cvv|expiry|billing') AS has_payment FROM h),
c AS (SELECT *, round(greatest(0.0, least(1.0, CAST(0.5 AS DOUBLE) + CASE WHEN elements > 5 THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN elements > 15 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN elements > 0 THEN labelled / elements * CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN forms > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN has_captcha THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN is_secure THEN CAST(0.05 AS DOUBLE) ELSE 0 END)), 6) AS confidence FROM f)
SELECT *, confidence >= 0.7 AND elements >= 2 AND NOT has_captcha AS sufficient FROM c""")
def page_confidence(spark, sf_dir):
    return r.page_facts(table(spark, sf_dir, "pages"))


@query("WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 9 IN (0, 4, 8) THEN 'A' WHEN c_custkey % 3 <> 0 AND c_custkey % 8 >= 4 AND c_custkey % 9 IN (0, 4, 8) THEN 'B' ELSE 'C' END AS tier FROM customer) SELECT c_custkey, tier, tier IN ('A', 'B') AS eligible FROM t")
def device_tiers(spark, sf_dir):
    key = F.col("c_custkey")
    memory = F.when(key % 9 == 0, 0).when(key % 9 == 4, 4).when(key % 9 == 8, 16).otherwise(2)
    rows = table(spark, sf_dir, "customer").select(key, r.tier(key % 4 == 0, key % 3 != 0, key % 8, memory).alias("tier"))
    return rows.withColumn("eligible", r.tier_rank(F.col("tier")) >= r.tier_rank(F.lit("B")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 1 AND event_id % 5 = 1 THEN true ELSE false END AS may_leave FROM events")
def pixel_gate(spark, sf_dir):
    key = F.col("event_id")
    known = lambda n, rest: F.when(key % n != 0, key % n == rest)  # noqa: E731  null where it is not known
    return table(spark, sf_dir, "events").select("event_id", r.pixels_may_leave(key % 2 == 0, known(3, 1), known(5, 1)).alias("may_leave"))


_STORED = "SELECT c.c_custkey AS page_id, t.name AS name, concat(t.name, CAST(c.c_custkey AS STRING)) AS value FROM customer c CROSS JOIN (VALUES ('model', 2), ('endpoint', 3)) AS t(name, m) WHERE c.c_custkey % t.m = 0"


@query(f"WITH s AS ({_STORED}), k AS (SELECT DISTINCT page_id FROM s), n AS (SELECT * FROM (VALUES ('model', 'small', NULL), ('endpoint', 'local', 'proxy'), ('key', '', NULL)) AS t(name, d, e)) SELECT k.page_id, n.name, coalesce(s.value, e, d) AS value, CASE WHEN s.value IS NOT NULL THEN 'stored' WHEN e IS NOT NULL THEN 'env' ELSE 'default' END AS source FROM k CROSS JOIN n LEFT JOIN s ON s.page_id = k.page_id AND s.name = n.name")
def settings(spark, sf_dir):
    defaults = spark.createDataFrame([("model", "small"), ("endpoint", "local"), ("key", "")], "name string, value string")
    return r.overlaid(defaults, derived(spark, sf_dir, _STORED, "customer"), spark.createDataFrame([("endpoint", "proxy")], "name string, value string"), "page_id")


@query(f"WITH ff AS ({FORM_FIELDS}), el AS ({PAGE_ELEMENTS}), e AS (SELECT page_id, ord, trim(CASE WHEN label <> '' THEN label ELSE text END) AS label FROM el), f AS (SELECT DISTINCT page_id, lower(label) AS low FROM ff) SELECT page_id, arg_min(label, ord) AS label, min(ord) AS ord FROM e WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.page_id = e.page_id AND f.low = lower(e.label)) GROUP BY page_id, lower(label)")
def standalone_labels(spark, sf_dir):
    fields, elements, _ = _inputs(spark, sf_dir)
    return r.standalone_labels(elements, fields)


_TARGETS = "SELECT c.c_custkey AS page_id, t.target AS target FROM customer c CROSS JOIN (VALUES ('#dob', 1), ('email', 2), ('GIVEN NAME', 3), ('[name=\"pan\"]', 2)) AS t(target, m) WHERE c.c_custkey % t.m = 0"


@query(f"WITH {_DETECTED}, f1 AS (SELECT page_id, field_selector, arg_max(category, branch * 1000000 + i * 1000 + k * 10 + m) AS category FROM regions WHERE field_selector IS NOT NULL GROUP BY ALL), o AS (SELECT *, {_SELECTOR} AS selector FROM ff), tg AS ({_TARGETS}) SELECT o.page_id, form_id, ord, selector, category FROM o LEFT JOIN f1 ON f1.page_id = o.page_id AND field_selector = selector WHERE type NOT IN ('checkbox', 'radio', 'submit', 'button', 'reset', 'image') AND selector IS NOT NULL AND (category IS NOT NULL OR value <> '') AND EXISTS (SELECT 1 FROM tg WHERE tg.page_id = o.page_id AND (target = selector OR target = regexp_replace(selector, '^#', '') OR lower(target) = lower(label)))")
def written_fields(spark, sf_dir):
    review = d.review_fields(form_fields(spark, sf_dir), _regions(spark, sf_dir))
    return r.written(review, derived(spark, sf_dir, _TARGETS, "customer")).select("page_id", "form_id", "ord", "selector", "category")


@query("SELECT l_orderkey, l_linenumber, CAST(least(l_partkey % 50, l_suppkey % 30, l_orderkey % 40) AS DOUBLE) AS x, CAST(least(l_linenumber, l_partkey % 20) AS DOUBLE) AS y, CAST(greatest(l_partkey % 50, l_suppkey % 30, l_orderkey % 40) - least(l_partkey % 50, l_suppkey % 30, l_orderkey % 40) AS DOUBLE) AS w, CAST(greatest(l_linenumber, l_partkey % 20) - least(l_linenumber, l_partkey % 20) AS DOUBLE) AS h FROM lineitem")
def bounding_boxes(spark, sf_dir):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    part, supp, order, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    box = r.bounding_box(F.array(at(part % 50, line), at(supp % 30, part % 20), at(order % 40, line)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 10 ELSE 0 END) AS v FROM embeddings) SELECT vec_id, round(list_sum(CASE WHEN list_min(v) >= -0.01 AND list_max(v) <= 1.01 THEN v ELSE list_transform(v, lambda x: 1 / (1 + exp(-x))) END), 6) AS total FROM p")
def logit_guard(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 2 == 0, 10).otherwise(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(r.probabilities(scaled), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_WORDS = "SELECT l_orderkey, l_linenumber, concat(' w', CAST(l_partkey AS STRING)) AS text, CAST(l_partkey % {0} AS DOUBLE) / 100 AS score FROM lineitem WHERE l_partkey % {1} <> 0"


@query(f"WITH a AS ({_WORDS.format(97, 5)}), b AS ({_WORDS.format(89, 3)}), j AS (SELECT l_orderkey, l_linenumber, a.text AS ta, a.score AS s1, b.text AS tb, b.score AS s2 FROM a FULL JOIN b USING (l_orderkey, l_linenumber)), c AS (SELECT l_orderkey, l_linenumber, s2 IS NOT NULL AND (s1 IS NULL OR (s1 < 0.55 AND s2 > s1)) AS other, ta, s1, tb, s2 FROM j) SELECT l_orderkey, l_linenumber, trim(CASE WHEN other THEN tb ELSE ta END) AS text, CASE WHEN other THEN s2 ELSE s1 END AS score FROM c WHERE CASE WHEN other THEN s2 ELSE s1 END >= 0.3")
def recognised_words(spark, sf_dir):
    one, two = (derived(spark, sf_dir, _WORDS.format(*x), "lineitem") for x in ((97, 5), (89, 3)))
    return r.recognised(one, two, "l_orderkey", "l_linenumber")
