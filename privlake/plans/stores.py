"""Queries of the keyed store over events, and of snapshots compared over conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privlake.operators import snapshots, store
from privlake.plans.registry import query
from privlake.sources.tables import derived

#: Events as changes: three stores, some hundred keys, a delete in ten, and now and then a clear.
CHANGES = """SELECT CASE user_id % 3 WHEN 0 THEN 'tasks' WHEN 1 THEN 'sites' ELSE 'preferences' END AS store, CASE WHEN event_id % 397 <> 0 THEN concat(event_type, '/', CAST(user_id % 41 AS STRING)) END AS key,
 CASE WHEN event_id % 397 = 0 THEN 'clear' WHEN event_id % 10 = 3 THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_id % 397 = 0 OR event_id % 10 = 3 THEN NULL ELSE props END AS value, event_id AS version, event_id % 17 = 5 AS old FROM events"""
SECRETS = ("0123456789abcdef0123456789abcdef", "fedcba9876543210fedcba9876543210")
#: Versions after which the state is looked at; the last is beyond all.
PREFIXES = (97, 1200, 5003, 1 << 40)
_STATE = f"""c AS ({CHANGES}), p AS (SELECT upto FROM (VALUES {", ".join(f"({p})" for p in PREFIXES)}) AS v(upto)), gone AS (SELECT upto, store, max(version) AS cleared FROM c, p WHERE op = 'clear' AND version <= upto GROUP BY ALL),
last AS (SELECT upto, store, key, arg_max(op, version) AS op, arg_max(old, version) AS old, max(version) AS version FROM c, p WHERE op <> 'clear' AND version <= upto GROUP BY ALL),
live AS (SELECT last.* FROM last LEFT JOIN gone ON gone.upto = last.upto AND gone.store = last.store WHERE op = 'put' AND coalesce(version > cleared, true))"""


def _changes(spark, sf_dir) -> DataFrame:
    rows = derived(spark, sf_dir, CHANGES, "events")
    secret = F.when(F.col("old"), F.lit(SECRETS[1])).otherwise(F.lit(SECRETS[0]))
    return rows.withColumn("sealed", F.when(F.col("op") == "put", store.sealed(F.col("value"), secret))).drop("value", "old")


@query(f"WITH {_STATE} SELECT upto, live.store, live.key, live.version, c.value FROM live JOIN c ON c.version = live.version WHERE NOT live.old")
def stored_values(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    return reduce(DataFrame.unionByName, [store.read_all(store.live(rows, p), F.lit(SECRETS[0])).withColumn("upto", F.lit(p).cast("long")) for p in PREFIXES])


@query(f"WITH {_STATE} SELECT upto, store, count(*) AS keys, count_if(NOT old) AS readable, count_if(old) AS unreadable FROM live GROUP BY ALL")
def unreadable_values(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    return reduce(DataFrame.unionByName, [store.store_counts(store.live(rows, p), F.lit(SECRETS[0])).withColumn("upto", F.lit(p).cast("long")) for p in PREFIXES])


#: A turn is a snapshot of its conversation: how often each word occurs.
_WORDS_SPARK = "SELECT conv_id AS page_id, turn AS step, key, CAST(count(*) AS STRING) AS value FROM (SELECT conv_id, turn, explode(regexp_extract_all(lower(text), '[a-z]+', 0)) AS key FROM conversations) x GROUP BY conv_id, turn, key"
_WORDS = "SELECT conv_id AS page_id, turn AS step, key, CAST(count(*) AS VARCHAR) AS value FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM conversations) x GROUP BY ALL"


@query(f"""WITH w AS ({_WORDS}), s AS (SELECT page_id, step, lag(step) OVER (PARTITION BY page_id ORDER BY step) AS before FROM (SELECT DISTINCT page_id, step FROM w)),
k AS (SELECT DISTINCT s.page_id, s.step, s.before, w.key FROM s JOIN w ON w.page_id = s.page_id AND w.step IN (s.step, s.before) WHERE before IS NOT NULL)
SELECT k.page_id, k.step, k.key, CASE WHEN b.value IS NULL THEN 'added' WHEN a.value IS NULL THEN 'removed' WHEN a.value = b.value THEN 'kept' ELSE 'changed' END AS change, b.value AS before, a.value AS after
FROM k LEFT JOIN w b ON b.page_id = k.page_id AND b.step = k.before AND b.key = k.key LEFT JOIN w a ON a.page_id = k.page_id AND a.step = k.step AND a.key = k.key""")
def snapshot_changes(spark, sf_dir):
    return snapshots.changes(derived(spark, sf_dir, _WORDS_SPARK, "conversations"))


_STATES = "SELECT conv_id AS page_id, turn AS step, length(text) % 7 AS n_elements, role AS forms, substring(text, 1, 3) AS text FROM conversations"
#: What a turn should leave: a word so often, or once more than that in some; a step in nine is a click, one in eleven of a page that was not looked at.
_PLAN = "SELECT conv_id + CASE WHEN conv_id % 11 = 0 THEN 1000000 ELSE 0 END AS page_id, turn AS step, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'click' ELSE 'type' END AS action, CASE conv_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'of' ELSE 'nowhere' END AS target, CAST(1 + (conv_id + turn) % 2 AS STRING) AS value FROM conversations"


@query(f"""WITH w AS ({_WORDS}), st AS ({_STATES}), pl AS ({_PLAN}), ch AS (SELECT page_id, step, coalesce(n_elements IS DISTINCT FROM lag(n_elements) OVER o OR text IS DISTINCT FROM lag(text) OVER o OR forms IS DISTINCT FROM lag(forms) OVER o, false) AND row_number() OVER o > 1 AS changed FROM st WINDOW o AS (PARTITION BY page_id ORDER BY step)),
j AS (SELECT pl.*, changed FROM pl LEFT JOIN ch ON ch.page_id = pl.page_id AND ch.step = pl.step)
SELECT page_id, step, 'page' AS signal, true AS passed, CASE WHEN changed IS NULL THEN 0.5 WHEN changed THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN changed IS NULL THEN 'Verification skipped — could not re-perceive page' WHEN changed THEN 'Page state changed after action' ELSE 'Page unchanged (action may be visual only)' END AS details FROM j
UNION ALL SELECT j.page_id, j.step, 'field', w.value = j.value, CASE WHEN w.value = j.value THEN 0.95 ELSE 0.3 END::DOUBLE, CASE WHEN w.value = j.value THEN 'Field value matches: "' || j.value || '"' ELSE 'Field value mismatch: expected "' || j.value || '", got "' || w.value || '"' END
FROM j JOIN w ON w.page_id = j.page_id AND w.step = j.step AND w.key = j.target WHERE action = 'type' AND changed IS NOT NULL""")
def verified_steps(spark, sf_dir):
    words = derived(spark, sf_dir, _WORDS_SPARK, "conversations")
    fields = words.select("page_id", "step", F.lit(0).alias("ord"), F.col("key").alias("id"), F.lit("").alias("name"), "value")
    return snapshots.verify_steps(derived(spark, sf_dir, _PLAN, "conversations"), derived(spark, sf_dir, _STATES, "conversations"), fields)
