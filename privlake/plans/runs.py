"""Queries of runs, progress, states, stores and severities."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.operators import runs as r
from privlake.plans.registry import query
from privlake.sources.tables import derived, table

_RUNS = "SELECT user_id, min(ts) + INTERVAL 10 DAYS AS started FROM events WHERE user_id % 5 <> 0 GROUP BY user_id"


@query(f"WITH runs AS ({_RUNS}) SELECT event_id, user_id FROM events JOIN runs USING (user_id) WHERE ts >= started")
def events_of_runs(spark, sf_dir):
    return r.since_start(table(spark, sf_dir, "events"), derived(spark, sf_dir, _RUNS, "events"), "user_id", "ts", "started").select("event_id", "user_id")


@query("SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(o_orderkey) AS n_steps, CASE WHEN count(o_orderkey) = 0 THEN 0 ELSE CAST(floor(100.0 * (count(o_orderkey) FILTER (WHERE o_orderstatus = 'F')) / count(o_orderkey) + 0.5) AS BIGINT) END AS percent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def task_progress(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return r.task_progress(table(spark, sf_dir, "customer"), steps, "c_custkey", F.col("o_orderstatus") == "F")


_STATES = "SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS o_orderstatus FROM lineitem WHERE l_linenumber > 4 GROUP BY l_orderkey"


@query(f"WITH u AS ({_STATES}) SELECT o.o_orderkey, coalesce(u.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN u USING (o_orderkey)")
def refreshed_states(spark, sf_dir):
    return r.refreshed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), derived(spark, sf_dir, _STATES, "lineitem"), "o_orderkey", "o_orderstatus")


@query("SELECT event_type AS store, count(*) AS n_rows, CAST(floor(2.0 * coalesce(sum(length(props)), 0) / 1024 + 0.5) AS BIGINT) AS kilobytes FROM events GROUP BY event_type")
def storage_stats(spark, sf_dir):
    return r.storage_stats(table(spark, sf_dir, "events"), F.col("event_type"), F.col("props"))


_GRADED = "SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'critical' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'none' END AS severity FROM lineitem"


@query(f"WITH g AS ({_GRADED}) SELECT l_orderkey, l_linenumber, severity, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, l_linenumber) AS INT) AS place FROM g")
def regions_by_severity(spark, sf_dir):
    return r.by_severity(derived(spark, sf_dir, _GRADED, "lineitem"), "l_orderkey", "severity", "l_linenumber")
