"""Queries over requests and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.functions.urls import privacy_score
from privlake.operators import ledger as l
from privlake.plans.registry import query
from privlake.plans.text import _BODIES, _kept
from privlake.sources.tables import REQUESTS, derived, table

_LEDGER = _kept(_BODIES.format(REQUESTS), False) + f""", rq AS ({REQUESTS}), hit AS (SELECT id, list(DISTINCT category) AS cats, string_agg(category, ',' ORDER BY s) AS run FROM kept GROUP BY id),
lg AS (SELECT request_id, origin, octet_length(encode(body)) AS bytes, CASE WHEN octet_length(encode(body)) > 262144 THEN 'unscanned' WHEN hit.id IS NULL THEN 'allowed' WHEN origin = 'page' THEN 'observed' ELSE 'blocked' END AS decision, coalesce(cats, []) AS cats, url FROM rq LEFT JOIN hit ON request_id = hit.id)"""


@query(_LEDGER + """ SELECT request_id, origin, CAST(bytes AS BIGINT) AS bytes, decision, array_to_string(list_sort(cats), ',') AS categories,
 CASE WHEN url LIKE 'http://localhost%' THEN 'http://localhost:3000/api/plan' WHEN url LIKE 'https://Api%' THEN 'https://api.example.com/v1/chat' WHEN url LIKE 'http://192%' THEN 'http://192.168.1.5/a' ELSE 'https://example.org:8443/' END AS url FROM lg""")
def egress_decisions(spark, sf_dir):
    rows = l.decide(derived(spark, sf_dir, REQUESTS, "conversations"))
    return rows.select("request_id", "origin", "bytes", "decision", F.array_join(F.sort_array("categories"), ",").alias("categories"), "url")


@query(_LEDGER + """ SELECT origin, count(*) AS total, count_if(decision = 'blocked') AS blocked, count_if(decision = 'observed') AS observed, count_if(decision = 'allowed') AS clean, count_if(decision = 'unscanned') AS unscanned, CAST(sum(bytes) AS BIGINT) AS bytes_inspected,
 CAST(coalesce(sum(bytes) FILTER (decision = 'blocked'), 0) AS BIGINT) AS bytes_blocked, coalesce(array_to_string(list_sort(list_distinct(flatten(list(cats) FILTER (decision = 'blocked')))), ','), '') AS blocked_categories FROM lg GROUP BY origin""")
def egress_ledger(spark, sf_dir):
    return l.totals(l.decide(derived(spark, sf_dir, REQUESTS, "conversations")), "origin")


@query(f"WITH rq AS ({REQUESTS}), h AS (SELECT lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM rq) SELECT host, count(*) AS requests, count_if(host NOT IN ('', 'localhost', '127.0.0.1', '::1') AND NOT starts_with(host, '192.168.') AND NOT starts_with(host, '10.')) AS outbound FROM h GROUP BY host")
def requests_by_host(spark, sf_dir):
    return l.by_host(derived(spark, sf_dir, REQUESTS, "conversations"))


@query("SELECT user_id, count(*) AS outbound, CASE WHEN count(*) = 0 THEN 100 WHEN count(*) <= 2 THEN 90 WHEN count(*) <= 5 THEN 70 ELSE 40 END AS score FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def privacy_scores(spark, sf_dir):
    counts = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("outbound"))
    return counts.withColumn("score", privacy_score(F.col("outbound")))


@query("SELECT * FROM (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events) WHERE place <= 5")
def last_n_events(spark, sf_dir):
    return l.last_n(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), 5, ["user_id"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def recent_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(latest), F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 DAY")).select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS entries FROM events GROUP BY event_type")
def phase_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("entries"))


@query("SELECT user_id, count(*) AS steps, count_if(event_type = 'click') AS actions, round(avg(value), 4) AS mean_value, CAST(date_diff('microsecond', min(ts), max(ts)) AS BIGINT) AS elapsed_us FROM events GROUP BY user_id")
def trace_summary(spark, sf_dir):
    micros = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    stamp = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stamp.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "click").alias("actions"), F.round(F.avg("value"), 4).alias("mean_value"), micros.alias("elapsed_us"))


_SIGNALS = "SELECT l_orderkey, CASE l_linenumber % 6 WHEN 0 THEN 'dom_diff' WHEN 1 THEN 'url_change' WHEN 2 THEN 'error_check' WHEN 3 THEN 'accessibility_tree' WHEN 4 THEN 'network_request' ELSE 'other' END AS type, l_returnflag <> 'R' AS passed, CAST(l_quantity AS DOUBLE) / 50 AS confidence FROM lineitem"


@query(f"WITH s AS ({_SIGNALS}), w AS (SELECT *, CAST(CASE type WHEN 'dom_diff' THEN 0.35 WHEN 'url_change' THEN 0.15 WHEN 'error_check' THEN 0.3 WHEN 'accessibility_tree' THEN 0.15 WHEN 'network_request' THEN 0.05 ELSE 0.1 END AS DOUBLE) AS weight FROM s), g AS (SELECT l_orderkey, floor(CAST(sum(CAST(weight * confidence * CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS DECIMAL(18,10))) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(18,10))) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS confidence, bool_or(type IN ('dom_diff', 'error_check') AND passed) AS k FROM w GROUP BY l_orderkey) SELECT l_orderkey, confidence, confidence > 0.6 AND k AS success FROM g")
def weighted_verification(spark, sf_dir):
    return l.verify(derived(spark, sf_dir, _SIGNALS, "lineitem"), "l_orderkey")


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM c")
def status_shares(spark, sf_dir):
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


_CHANGES = "SELECT conv_id, turn, length(text) <> length(before) OR text <> before AS changed, CAST(length(text) - length(before) AS BIGINT) AS grown FROM (SELECT conv_id, turn, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"


@query(_CHANGES)
def state_changes(spark, sf_dir):
    """Each snapshot against the one before it; nulls for the first."""
    return l.changes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
