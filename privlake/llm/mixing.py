"""Mixing sources to target weights: how often each document is taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable
from .ranks import ranked

#: A source with this share of all documents is joined by broadcast however many sources there are; at most 1 / HEAVY sources can have it.
HEAVY = 0.001


def words(text: Column) -> Column:
    """The number of runs of signs that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on `key` and `seed` alone: the first 52 bits of a SHA-256."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}|"), key), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Rows (_source, _docs, _size) with _target, the words that each source should give.

    Sources in the order of code points, null last, weigh `weights`, which repeat, and share the sum of all sizes. No target exceeds `most` times its source's size; what
    is over is shared again by weight among the others until none is above. Each round of that is one aggregate of a written table, compared in whole numbers.
    """
    name = F.col("_source").cast("string")
    rows = sources.withColumn("_all", F.lit("")).withColumn("_name", F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name)))
    rows = ranked(durable(rows), "_all", ["_name"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_pos") % len(weights) + 1).cast("int"))
    rows = durable(rows.select("_source", "_docs", "_size", weight.cast("decimal(38,0)").alias("_weight"), (F.col("_size") * most).cast("decimal(38,0)").alias("_cap")))
    total, over = int(rows.agg(F.sum("_size")).first()[0] or 0), F.lit(False)
    left = None
    while True:
        full, open_ = rows.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight")))).first()
        now = total - int(full or 0), int(open_ or 0)
        if now == left or not now[1]:
            break
        left = now
        over = F.col("_weight") * F.lit(str(left[0])).cast("decimal(38,0)") > F.col("_cap") * F.lit(str(left[1])).cast("decimal(38,0)")
    if left is None:
        return rows.select("_source", "_docs", "_size", F.lit(0.0).alias("_target"))
    share = (F.col("_weight") * F.lit(str(left[0])).cast("decimal(38,0)")).cast("double") / F.lit(float(left[1]))
    return rows.select("_source", "_docs", "_size", F.when(over, F.col("_cap").cast("double")).otherwise(share).alias("_target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 0, few: int = BROADCAST_ROWS) -> DataFrame:
    """All rows of `docs` with size (words), source_size, target (its source's, in words), rate (target by source_size) and copies.

    A document is taken floor(rate) times, and once more if draw() of its id (of its text, if that is null) is below what the rate has over that: so the same
    documents come on every run, and at most `most` times each. Rows that repeat an id are drawn alike. Null text has no words; a source without words has target and rate 0; a null source is
    a source. Columns of `docs` named like the new ones go. An empty table gives no rows.

    Sizes are added up per source before any shuffle. Up to `few` sources, which are counted, are broadcast, and no document moves. With more, those with a share of
    HEAVY of all documents are broadcast, 1 / HEAVY at most, and only documents of the others are joined by shuffle. emit() repeats the rows.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new)).alias("_row"), F.col(f"`{source_col}`").alias("_source"), words(F.col(f"`{text_col}`").cast("string")).alias("_words"), draw(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.lit("")), seed).alias("_draw"))
    sources = durable(rows.groupBy("_source").agg(F.count("*").alias("_docs"), F.sum("_words").alias("_size")))
    plan = durable(source_targets(sources, weights, most).withColumnRenamed("_source", "_of"))
    same = F.col("_source").eqNullSafe(F.col("_of"))
    n, all_docs = plan.agg(F.count("*"), F.sum("_docs")).first()
    if n <= few:
        out = rows.join(F.broadcast(plan), same)
    else:
        heavy = plan.where(F.col("_docs") >= HEAVY * all_docs)
        out = rows.join(F.broadcast(heavy), same).unionByName(rows.join(F.broadcast(heavy), same, "left_anti").join(plan.where(F.col("_docs") < HEAVY * all_docs), same))
    rate = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    out = out.withColumn("_rate", rate)
    copies = F.floor("_rate") + (F.col("_draw") < F.col("_rate") - F.floor("_rate")).cast("long")
    return out.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in new), F.col("_words").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.col("_rate").alias("rate"), copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of mix_sources(), each as often as its `copies` say, with `copy` from 1 on; narrow."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
