"""Queries over plans, redaction and run times."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.operators import intents, planning, redaction, spatial
from privlake.plans.forms import _FOUND, _source_sql
from privlake.plans.registry import query
from privlake.plans.spatial import _IOU, _folded
from privlake.sources.tables import BOXES, FORM_FIELDS, derived, form_fields, table

_KEYS = ", ".join(f"('{s}')" for s in dict.fromkeys(s for s, _ in intents.DATA_SOURCES))
_SAVED = f"SELECT c.c_custkey AS page_id, t.k AS key, CASE WHEN c.c_custkey % 3 = 0 AND t.k = 'phone' THEN '' WHEN t.k = 'state' THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'KERALA' ELSE 'Goa' END ELSE c.c_name END AS value FROM customer c CROSS JOIN (VALUES {_KEYS}) AS t(k)"
_PLANNED = f"""WITH {_FOUND}, sv AS ({_SAVED}), a AS (SELECT *, lower(concat_ws(' ', label, name, id, '')) AS lx FROM d), b AS (SELECT *, string_split(lx, ' ') AS ws FROM a WHERE trim(value) = '' AND type NOT IN ('submit', 'button', 'hidden')),
r AS (SELECT *, {_source_sql().replace("regexp_matches(ctx", "regexp_matches(lx")} AS r FROM b), m AS (SELECT r.*, sv.value AS saved, CAST(split_part(r, '|', 2) AS DOUBLE) AS confidence FROM r JOIN sv ON sv.page_id = r.page_id AND sv.key = split_part(r, '|', 1) AND sv.value <> ''),
o AS (SELECT *, CASE WHEN type = 'select' THEN list_filter(string_split(opts, '|'), lambda x: lower(x) = lower(saved))[1] END AS opt FROM m),
s AS (SELECT *, unnest(CASE WHEN opt IS NULL THEN [0, 1] ELSE [2] END) AS k FROM o)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY form_id, ord, k) - 1 AS INT) AS step, ord, ['click', 'type', 'select'][k + 1] AS action,
 CASE WHEN k = 2 THEN CASE WHEN id <> '' THEN id WHEN name <> '' THEN name ELSE '[' || ord || ']' END WHEN id <> '' OR name = '' THEN '[' || ord || ']' ELSE name END AS target,
 CASE k WHEN 1 THEN saved WHEN 2 THEN opt END AS value, confidence, CASE WHEN k = 1 AND len(cats) > 0 THEN 'high' ELSE 'low' END AS risk FROM s"""


@query(_PLANNED)
def fill_plans(spark, sf_dir):
    return planning.fill_plan(form_fields(spark, sf_dir), derived(spark, sf_dir, _SAVED, "customer"))


@query(_PLANNED[: _PLANNED.index("\no AS (")].rstrip(",") + " SELECT page_id, form_id, ord, CASE WHEN label <> '' THEN label WHEN name <> '' THEN name ELSE id END AS field_name FROM b WHERE required AND NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = b.page_id AND m.form_id = b.form_id AND m.ord = b.ord)")
def unmapped_fields(spark, sf_dir):
    return planning.unmapped_fields(form_fields(spark, sf_dir), derived(spark, sf_dir, _SAVED, "customer"))


_BUTTONS = "SELECT c_custkey AS page_id, t.ord AS ord, t.tag AS tag, t.role AS role, CASE WHEN t.ord = 1 AND c_custkey % 3 = 0 THEN 'Save draft and continue' WHEN t.ord = 2 AND c_custkey % 4 = 0 THEN 'Read more' ELSE t.text END AS text, t.label AS label, t.id AS id FROM customer CROSS JOIN (VALUES (0, 'a', '', 'Submit a story', '', 'x'), (1, 'button', '', 'Go', 'confirm order', ''), (2, 'div', 'button', 'Proceed', '', 'p2')) AS t(ord, tag, role, text, label, id)"
_SUBMITS = "SELECT c_custkey AS page_id, 'f1' AS form_id, 1 AS ord, 'Submit' AS type, '' AS id, CASE WHEN c_custkey % 2 = 0 THEN 'send' ELSE '' END AS name, 'Send it' AS label FROM customer WHERE c_custkey % 5 = 0"


@query(f"""WITH e AS ({_BUTTONS}), f AS ({_SUBMITS}), t AS (SELECT page_id, arg_min(CASE WHEN id <> '' THEN id ELSE text END, ord) AS by_text FROM e WHERE (tag = 'button' OR role = 'button') AND regexp_matches(lower(concat_ws(' ', text, label)), '\\b(submit|send|confirm|proceed|continue)\\b') AND NOT regexp_matches(lower(concat_ws(' ', text, label)), '\\b(save\\s*draft|cancel|reset|back)\\b') GROUP BY page_id)
SELECT coalesce(f.page_id, t.page_id) AS page_id, CASE WHEN f.page_id IS NOT NULL THEN CASE WHEN name <> '' THEN name ELSE label END ELSE by_text END AS target FROM f FULL JOIN t ON f.page_id = t.page_id""")
def submit_targets(spark, sf_dir):
    return planning.submit_targets(derived(spark, sf_dir, _SUBMITS, "customer"), derived(spark, sf_dir, _BUTTONS, "customer"))


_RUNS = "SELECT o_orderkey, o_orderkey % 4 AS done, o_orderkey % 4 + o_orderkey % 2 AS total, o_custkey % 3 AS needs, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 2 END AS missing FROM orders"


@query(f"WITH r AS ({_RUNS}) SELECT o_orderkey, CASE WHEN total > 0 THEN done || '/' || total || ' steps done' ELSE 'nothing to do' END || ' — ' || CASE WHEN needs = 0 THEN 'nothing outstanding.' WHEN missing > 0 THEN needs || ' required field' || CASE WHEN needs = 1 THEN ' still needs' ELSE 's still need' END || ' a value from you.' ELSE needs || ' required field' || CASE WHEN needs = 1 THEN '' ELSE 's' END || ' still empty.' END AS outcome FROM r")
def run_outcomes(spark, sf_dir):
    runs = derived(spark, sf_dir, _RUNS, "orders")
    return runs.select("o_orderkey", planning.outcome_line(*(F.col(c) for c in ("done", "total", "needs", "missing"))).alias("outcome"))


_ANSWERS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('```json', chr(10), '{"steps": [{"action": {"type": "fill", "target": "[3] Given Name", "value": "', CAST(o_custkey AS STRING), '"}, "confidence": 0.5, "risk": "high"}, {"action": {"type": "click", "target": "Submit"}}]}', chr(10), '```')
 WHEN 1 THEN 'Sure: {"actions": [{"type": "input", "element": "mobile"}]} done' WHEN 2 THEN 'no plan' WHEN 3 THEN '{"steps": []}' ELSE '{"steps": [{"target": "[7]"}]}' END AS answer FROM orders"""


@query("""SELECT o_orderkey, CAST(t.k AS INT) AS step, t.action, t.target, CASE WHEN t.m = 0 AND t.k = 0 THEN CAST(o_custkey AS VARCHAR) END AS value, CAST(t.confidence AS DOUBLE) AS confidence, t.risk FROM orders
JOIN (VALUES (0, 0, 'type', '[3]', 0.5, 'high'), (0, 1, 'click', 'Submit', 0.8, 'low'), (1, 0, 'type', 'mobile', 0.8, 'low'), (4, 0, 'wait', '[7]', 0.8, 'low')) AS t(m, k, action, target, confidence, risk) ON o_orderkey % 5 = t.m""")
def parsed_plans(spark, sf_dir):
    rows = derived(spark, sf_dir, _ANSWERS, "orders").select("o_orderkey", F.posexplode(planning.plan_steps(F.col("answer"))).alias("step", "s"))
    return rows.select("o_orderkey", "step", "s.*")


@query(f"WITH {_FOUND} SELECT page_id, string_agg('[' || ord || '] ' || label || ' (' || type || ') ' || CASE WHEN trim(value) <> '' THEN 'FILLED' ELSE 'EMPTY' END || CASE WHEN required THEN ' REQUIRED' ELSE '' END || CASE WHEN len(cats) > 0 THEN ' [PII:' || cats[1] || ']' ELSE '' END, chr(10) ORDER BY ord) AS prompt FROM d GROUP BY page_id")
def prompt_texts(spark, sf_dir):
    return planning.prompt_lines(form_fields(spark, sf_dir))


_REGIONS = f"SELECT page_id, ord, CASE WHEN ord = 5 THEN NULL ELSE concat('#f', CAST(ord AS STRING)) END AS selector, CASE CAST(x AS INT) % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'blur' WHEN 2 THEN 'black_box' WHEN 3 THEN 'pixelate' WHEN 4 THEN 'mask_text' ELSE 'overlay' END AS strategy, x, y, CASE WHEN ord = 4 THEN NULL ELSE w END AS w, h FROM ({BOXES}) bx"


@query(f"""WITH r AS ({_REGIONS}), p AS (SELECT *, greatest(0, least(x + w, 300) - x) * greatest(0, least(y + h, 100) - y) AS px FROM r) SELECT page_id, count(*) AS total, count_if(w IS NULL) AS skipped, count_if(w IS NOT NULL) AS redacted, coalesce(sum(px) FILTER (w IS NOT NULL AND strategy IN ('blur', 'black_box', 'pixelate', 'mask_text')), 0) AS pixels,
 {", ".join(f"count_if(w IS NOT NULL AND strategy = '{s}') AS {s}" for s in redaction.STRATEGIES if s != "none")}, count_if(w IS NOT NULL AND strategy = 'none') AS "none", round(coalesce(sum(px) FILTER (w IS NOT NULL AND strategy IN ('blur', 'black_box', 'pixelate', 'mask_text')), 0) / 30000 * 100, 4) AS percent FROM p GROUP BY page_id""")
def redaction_stats(spark, sf_dir):
    return redaction.redaction_stats(derived(spark, sf_dir, _REGIONS, "lineitem"), 300.0, 100.0)


_CSS = " ".join("WHEN '" + s + "' THEN " + " || chr(10) || ".join(f"selector || '{a} {{ {b} }}'" for a, b in rules) for s, rules in redaction.RULES.items())


@query(f"WITH r AS ({_REGIONS}), c AS (SELECT page_id, ord, CASE strategy {_CSS} END AS css FROM r WHERE selector IS NOT NULL) SELECT page_id, string_agg(css, chr(10) ORDER BY ord) AS css FROM c WHERE css IS NOT NULL GROUP BY page_id")
def style_rules(spark, sf_dir):
    return redaction.style_rules(derived(spark, sf_dir, _REGIONS, "lineitem"))


@query("SELECT user_id, coalesce(arg_min(value, (ts, event_id)) FILTER (event_type = 'click'), 0) AS planning, coalesce(arg_min(value, (ts, event_id)) FILTER (event_type = 'purchase'), 0) AS execution, CAST(0 AS DOUBLE) AS capture, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total FROM events GROUP BY user_id")
def step_times(spark, sf_dir):
    return redaction.step_times(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["ts", "event_id"], {"planning": "click", "execution": "purchase", "capture": "capture"})


_KINDS = ", ".join(f"'{k}'" for k in spatial.SOURCES)
_SOURCED = BOXES.replace("CASE WHEN l_suppkey % 2 = 0 THEN 'dom' ELSE 'vision' END AS source", "0 AS none_")
_FUSED = _folded(
    f"list_position([{_KINDS}], source), ord",
    f"n.source <> 'dom' AND CASE WHEN n.source = 'ocr' THEN a.source = 'dom' AND {_IOU} > 0.5 ELSE {_IOU} > 0.4 END",
    source="CASE WHEN n.source = 'vit' THEN 'fused' ELSE a.source END",
    confidence="least(1.0, CASE n.source WHEN 'ocr' THEN a.confidence + 0.05 WHEN 'vit' THEN greatest(a.confidence, n.confidence) + 0.1 ELSE a.confidence END)",
    text="CASE WHEN n.source = 'ocr' THEN coalesce(nullif(a.text, ''), n.text) WHEN n.source = 'vit' AND length(n.text) > length(coalesce(a.text, '')) THEN n.text ELSE a.text END",
).replace(f"b AS ({BOXES})", f"b AS (SELECT * REPLACE (CASE WHEN source = 'dom' THEN {spatial.DOM_CONFIDENCE} ELSE confidence END AS confidence) FROM (SELECT *, [{_KINDS}][ord % 4 + 1] AS source FROM ({_SOURCED}) b1) b2)")


@query(f"SELECT page_id, ord, category, source, confidence, text FROM ({_FUSED}) fused_")
def source_fusion(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, spatial.SOURCES)), (F.col("ord") % 4 + 1).cast("int"))
    boxes = derived(spark, sf_dir, BOXES, "lineitem").withColumn("source", kinds)
    return spatial.fuse_sources(boxes).select("page_id", "ord", "category", "source", F.round("confidence", 6).alias("confidence"), "text")
