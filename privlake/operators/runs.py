"""Rows of runs: those since a run began, how far tasks are, refreshed states, what a store holds, and regions by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities, the gravest first.
SEVERITIES = ("critical", "high", "medium", "low")


def since_start(rows: DataFrame, runs: DataFrame, key: str, at: str, started: str) -> DataFrame:
    """Rows at or after the start of their key's run; rows of keys without a run go. `runs` has a row per key."""
    return rows.join(runs.select(key, F.col(started).alias("_started")), key).where(F.col(at) >= F.col("_started")).drop("_started")


def task_progress(tasks: DataFrame, steps: DataFrame, key: str, done: Column) -> DataFrame:
    """A row per task: n_done, n_steps and percent, rounded half up; 0 for a task without steps."""
    counts = steps.groupBy(key).agg(F.count_if(done).alias("n_done"), F.count("*").alias("n_steps"))
    out = tasks.select(key).join(counts, key, "left").fillna(0, ["n_done", "n_steps"])
    return out.withColumn("percent", F.when(F.col("n_steps") == 0, 0).otherwise(F.expr("(200 * n_done + n_steps) div (2 * n_steps)")))


def refreshed(rows: DataFrame, updates: DataFrame, key: str, state: str) -> DataFrame:
    """All rows, each with the state of the update of its key if there is one. `updates` has a row per key."""
    return rows.join(updates.select(key, F.col(state).alias("_new")), key, "left").withColumn(state, F.coalesce("_new", state)).drop("_new")


def storage_stats(rows: DataFrame, store: Column, body: Column) -> DataFrame:
    """A row per store: n_rows and kilobytes, at two bytes a character, rounded half up."""
    return rows.groupBy(store.alias("store")).agg(F.count("*").alias("n_rows"), F.floor(2 * F.coalesce(F.sum(F.length(body)), F.lit(0)) / 1024 + 0.5).alias("kilobytes"))


def by_severity(regions: DataFrame, page: str, severity: str, ordinal: str) -> DataFrame:
    """Regions with their place on their page, the gravest first, those of one severity in their order; unknown severities come last."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col(severity)), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(SEVERITIES) + 1)
    return regions.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(rank, ordinal)))
