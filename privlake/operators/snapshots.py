"""Snapshots of pages compared: what was added, removed, changed or kept, and whether planned steps had their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How sure a check is that saw the page change, or saw it stay; and one that saw a field hold the value, or another.
PAGE_SURE, FIELD_SURE = (0.9, 0.6), (0.95, 0.3)


def compare(before: DataFrame, after: DataFrame, by: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Rows (by, key, change, before, after) for every key of either side: added, removed, changed or kept. Each side has a key once; nulls are values, and a null key is a key."""
    on = [*by, key]
    b = before.select(*(F.col(f"`{c}`").alias(f"b{k}") for k, c in enumerate(on)), F.col(f"`{value}`").alias("before"), F.lit(True).alias("was"))
    a = after.select(*(F.col(f"`{c}`").alias(f"a{k}") for k, c in enumerate(on)), F.col(f"`{value}`").alias("after"), F.lit(True).alias("is"))
    same = F.lit(True)
    for k in range(len(on)):
        same = same & F.col(f"b{k}").eqNullSafe(F.col(f"a{k}"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "kept").otherwise("changed")
    return b.join(a, same, "full").select(*(F.when(F.col("is"), F.col(f"a{k}")).otherwise(F.col(f"b{k}")).alias(c) for k, c in enumerate(on)), change.alias("change"), "before", "after")


def changes(snapshots: DataFrame, page: str = "page_id", step: str = "step", key: str = "key", value: str = "value") -> DataFrame:
    """compare() of each snapshot of a page with the one before it, whatever steps were left out: rows (page, step, key, change, before, after); the first snapshot has none.

    Snapshots are rows (page, step, key, value). A page's steps are numbered from one row for each; then rows meet those of the step before by page, number and key, in one join.
    """
    steps = snapshots.select(page, step).distinct()
    steps = steps.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(step))).withColumn("_next", F.lead(step).over(Window.partitionBy(page).orderBy(step)))
    rows = snapshots.select(page, step, key, value).join(steps, [page, step])
    earlier = rows.where("_next is not null").select(page, F.col("_next").alias(step), key, value)
    return compare(earlier, rows.where("_n > 1"), [page, step], key, value)


def page_changes(states: DataFrame, page: str = "page_id", step: str = "step") -> DataFrame:
    """Rows (page, step, n_elements, text, forms) with what differs from the snapshot before: elements_changed, text_changed, forms_changed, changed (any of them). A page's first snapshot has no changes."""
    before = Window.partitionBy(page).orderBy(step)
    first = F.row_number().over(before) == 1
    flags = {f"{c.removeprefix('n_')}_changed": ~first & ~F.lag(c).over(before).eqNullSafe(F.col(c)) for c in ("n_elements", "text", "forms")}
    out = states.select("*", *(flag.alias(name) for name, flag in flags.items()))
    return out.withColumn("changed", F.expr(" or ".join(flags)))


def _signal(passed: Column, sure: Column, details: Column) -> Column:
    return F.struct(passed.alias("passed"), sure.cast("double").alias("confidence"), details.alias("details"))


def verify_steps(plan: DataFrame, states: DataFrame, fields: DataFrame) -> DataFrame:
    """Steps (page_id, step, action, target, value) with the signals that the page gives after them: rows (page_id, step, signal, passed, confidence, details).

    Every step whose page was looked at after it has a signal of whether the page changed (page_changes()); a step that types a value has one more if a field has the target as its id or name, the first in order of
    `ord`: whether it holds the value. `fields` are rows (page_id, step, ord, id, name, value) after each step. A step of a page without a snapshot then has one signal: that it wasn't checked.
    """
    seen = page_changes(states).select("page_id", "step", F.coalesce("changed", F.lit(False)).alias("changed"), F.lit(True).alias("_seen"))
    steps = plan.select("page_id", "step", "action", "target", "value").join(seen, ["page_id", "step"], "left")
    asked = steps.where("action = 'type' and value <> '' and _seen").select("page_id", "step", "target", F.col("value").alias("planned"))
    after = fields.select("page_id", "step", "ord", F.explode(F.array_distinct(F.array("id", "name"))).alias("target"), "value").where("target <> ''")
    found = asked.join(after, ["page_id", "step", "target"]).groupBy("page_id", "step", "target", "planned").agg(F.min_by(F.struct("value"), "ord").alias("f"))
    found = found.select("page_id", "step", "target", "planned", F.coalesce("f.value", F.lit("")).alias("got"))
    holds = F.col("got") == F.col("planned")
    told = F.when(holds, F.concat(F.lit('Field value matches: "'), "planned", F.lit('"'))).otherwise(F.concat(F.lit('Field value mismatch: expected "'), "planned", F.lit('", got "'), "got", F.lit('"')))
    of_field = found.select("page_id", "step", F.lit("field").alias("signal"), _signal(holds, F.when(holds, FIELD_SURE[0]).otherwise(FIELD_SURE[1]), told).alias("s"))
    changed = F.when(F.col("changed"), F.lit("Page state changed after action")).otherwise("Page unchanged (action may be visual only)")
    page = F.when(F.col("_seen"), _signal(F.lit(True), F.when(F.col("changed"), PAGE_SURE[0]).otherwise(PAGE_SURE[1]), changed)).otherwise(_signal(F.lit(True), F.lit(0.5), F.lit("Verification skipped — could not re-perceive page")))
    of_page = steps.select("page_id", "step", F.lit("page").alias("signal"), page.alias("s"))
    return of_page.unionByName(of_field).select("page_id", "step", "signal", "s.*")
