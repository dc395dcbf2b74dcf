"""What redaction did to a page, as numbers and as style rules; how long the steps of a run took.

Region tables have page_id, ord, selector, strategy, x, y, w, h; a region without a box has a null width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All strategies, and those that change pixels.
STRATEGIES = ("blur", "black_box", "pixelate", "mask_text", "overlay", "none")
PAINTED = ("blur", "black_box", "pixelate", "mask_text")
#: The declarations of each strategy's rules, by the suffix of the selector that they hold for.
RULES = {
    "blur": (("", "filter: blur(8px); transition: filter 0.3s;"), (":hover", "filter: blur(4px);")),
    "black_box": (("", "color: transparent !important; background-color: #000 !important; text-shadow: none !important; -webkit-text-fill-color: transparent !important;"), ("::placeholder", "color: transparent !important;")),
    "mask_text": (("", "color: transparent !important; -webkit-text-fill-color: transparent !important; text-shadow: 0 0 8px #666 !important;"),),
    "pixelate": (("", "filter: url(#pixelate);"),),
}


def painted_pixels(wide: float, high: float) -> Column:
    """Pixels of a region's box within the page."""
    inside = lambda at, size, most: F.greatest(F.lit(0.0), F.least(F.col(at) + F.col(size), F.lit(most)) - F.greatest(F.col(at), F.lit(0.0)))
    return inside("x", "w", wide) * inside("y", "h", high)


def redaction_stats(regions: DataFrame, wide: float, high: float) -> DataFrame:
    """Per page: regions, those skipped for want of a box, the others, how many of them each strategy had, and the pixels painted, also as a share."""
    boxed = F.col("w").isNotNull()
    pixels = F.coalesce(F.sum(F.when(boxed & F.col("strategy").isin(*PAINTED), painted_pixels(wide, high))), F.lit(0.0))
    by = [F.count_if(boxed & (F.col("strategy") == s)).alias(s) for s in STRATEGIES]
    out = regions.groupBy("page_id").agg(F.count("*").alias("total"), F.count_if(~boxed).alias("skipped"), F.count_if(boxed).alias("redacted"), pixels.alias("pixels"), *by)
    return out.withColumn("percent", F.round(F.col("pixels") / (wide * high) * 100, 4))


def style_rules(regions: DataFrame) -> DataFrame:
    """A row per page with the style rules of its regions in order, one a line; regions without selector or strategy have none."""
    kinds = F.create_map(*(x for s, rules in RULES.items() for x in (F.lit(s), F.array(*(F.struct(F.lit(a).alias("suffix"), F.lit(b).alias("body")) for a, b in rules)))))
    rows = regions.where(F.coalesce("selector", F.lit("")) != "").withColumn("rules", F.try_element_at(kinds, F.col("strategy"))).where("rules is not null")
    lines = F.transform("rules", lambda r: F.concat("selector", r["suffix"], F.lit(" { "), r["body"], F.lit(" }")))
    return rows.groupBy("page_id").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", lines.alias("lines")))), lambda x: x["lines"])), "\n").alias("css"))


def step_times(steps: DataFrame, key: str, name: str, ms: str, order: list[str], wanted: dict[str, str]) -> DataFrame:
    """A row per `key`: for each output column of `wanted`, the time of the first step of that name, 0 without one; and the time of all steps."""
    first = [F.coalesce(F.min_by(F.when(F.col(name) == step, F.col(ms)), F.when(F.col(name) == step, F.struct(*order))), F.lit(0.0)).alias(out) for out, step in wanted.items()]
    return steps.groupBy(key).agg(*first, F.sum(F.col(ms).cast("decimal(18,6)")).cast("double").alias("total"))
