"""Ledger of outbound requests, and windows over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privlake.functions.text import mask_sample
from privlake.functions.urls import hostname, is_outbound, sanitize_url
from privlake.operators.scan import scan_spans

#: Bodies over this many bytes are not scanned, but counted.
MOST_BYTES = 256 * 1024


def decide(requests: DataFrame) -> DataFrame:
    """Requests (request_id, ts, origin, url, method, body) with url (sanitised), bytes, decision, categories and masked samples.

    An own request with matches is blocked, a page's is observed; others are allowed. A body over MOST_BYTES is `unscanned`. Null bodies are empty.
    Raw values never enter the ledger.
    """
    body = F.coalesce("body", F.lit(""))
    big = F.octet_length(body) > MOST_BYTES
    rows = requests.withColumn("m", F.when(big, F.array().cast("array<struct<s: int, e: int, category: string, matched_text: string, validated: boolean, confidence: double>>")).otherwise(scan_spans(body)))
    decision = F.when(big, "unscanned").when(F.size("m") == 0, "allowed").when(F.col("origin") == "page", "observed").otherwise("blocked")
    categories = F.array_distinct(F.transform("m", lambda x: x["category"]))
    return rows.select("request_id", "ts", "origin", sanitize_url(F.col("url")).alias("url"), "method", F.octet_length(body).cast("long").alias("bytes"), decision.alias("decision"), categories.alias("categories"), F.transform("m", lambda x: mask_sample(x["matched_text"])).alias("samples"))


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    """Counts and bytes per key, and the distinct categories of blocked requests."""
    is_ = lambda d: F.col("decision") == d
    blocked = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(is_("blocked"), F.col("categories"))))))
    return ledger.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(is_("blocked")).alias("blocked"), F.count_if(is_("observed")).alias("observed"), F.count_if(is_("allowed")).alias("clean"), F.count_if(is_("unscanned")).alias("unscanned"), F.sum("bytes").alias("bytes_inspected"), F.coalesce(F.sum(F.when(is_("blocked"), F.col("bytes"))), F.lit(0)).alias("bytes_blocked"), F.array_join(blocked, ",").alias("blocked_categories"))


def last_n(rows: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The last n rows of each key in descending `order`, with their place from 1. Spark keeps n rows per key and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def by_host(requests: DataFrame, url_col: str = "url") -> DataFrame:
    """Requests per host, and how many of them go out."""
    return requests.groupBy(hostname(F.col(url_col)).alias("host")).agg(F.count("*").alias("requests"), F.count_if(is_outbound(F.col(url_col))).alias("outbound"))


#: Weights of verification signals; others weigh 0.1, a failed one counts 0.3 of its confidence.
SIGNAL_WEIGHTS = {"dom_diff": 0.35, "url_change": 0.15, "error_check": 0.3, "accessibility_tree": 0.15, "network_request": 0.05}


def verify(signals: DataFrame, *keys: str) -> DataFrame:
    """Signals (type, passed, confidence) per key: weighted confidence, and success over 0.6 if a key signal passed."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SIGNAL_WEIGHTS.items() for x in kv)), F.col("type")), F.lit(0.1))
    exact = lambda x: F.sum(x.cast("decimal(18,10)")).cast("double")  # noqa: E731  sums that don't depend on the order
    mean = exact(weight * F.col("confidence") * F.when(F.col("passed"), 1.0).otherwise(0.3)) / exact(weight)
    mean = F.floor(mean * 1e6 + 0.5) / 1e6
    key = F.bool_or(F.col("type").isin("dom_diff", "error_check") & F.col("passed"))
    return signals.groupBy(*keys).agg(mean.alias("confidence"), ((mean > 0.6) & key).alias("success"))


def changes(snapshots: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Whether a snapshot's text differs from the one before it, and by how many characters it has grown. Null text is empty; the first snapshot has nulls."""
    now = F.coalesce(F.col(text), F.lit(""))
    rows = snapshots.select(key, order, now.alias("_now"), F.lag(now).over(Window.partitionBy(key).orderBy(order)).alias("_before"))
    return rows.select(key, order, (F.col("_now") != F.col("_before")).alias("changed"), (F.length("_now") - F.length("_before")).cast("long").alias("grown"))
