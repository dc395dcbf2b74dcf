"""Positions of rows in the order of their groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with _pos, their position from 0 on within `group` in ascending `order` (nulls first), and _n, the group's rows.

    Rows are sorted by ranges of (group, order), which split groups of any size, and equal rows too; a range knows how many rows of its groups lie in earlier ranges from counts
    per range and group. `rows` should be durable: the sort reads them twice. Rows that are equal in `order` get different positions. `group` must not be null.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = durable(dealt.withColumn("_range", F.shiftright("_at", 33)))
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    all_, earlier = Window.partitionBy(group), Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_range", "_first", F.sum("_rows").over(all_).alias("_n"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    out = placed.join(small(durable(counts)), [group, "_range"])
    return out.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_first", "_before")
