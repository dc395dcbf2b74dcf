"""What comes before and after models that read images: location codes, decoding of label sequences, and quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def location_boxes(text: Column, width: Column, height: Column) -> Column:
    """Boxes (x, y, w, h) of each four location codes: y1, x1, y2, x2 in thousandths of the image. Codes that don't make four are left out."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("<loc_([0-9]{1,4})>"), F.lit(1)), lambda c: c.cast("double") / 1000)
    groups = F.floor(F.size(codes) / 4).cast("int")
    at = lambda i, k: F.element_at(codes, (i - 1) * 4 + k)
    box = lambda i: F.struct((at(i, 2) * width).alias("x"), (at(i, 1) * height).alias("y"), ((at(i, 4) - at(i, 2)) * width).alias("w"), ((at(i, 3) - at(i, 1)) * height).alias("h"))
    return F.when(groups > 0, F.transform(F.sequence(F.lit(1), F.greatest(groups, F.lit(1))), box)).otherwise(F.array().cast("array<struct<x: double, y: double, w: double, h: double>>"))


def ctc_decode(steps: DataFrame, *keys: str) -> DataFrame:
    """Steps (t, best, probability, sign) per key: signs of steps that are neither blank (0) nor repeat the step before, and their mean probability."""
    before = F.lag("best").over(Window.partitionBy(*keys).orderBy("t"))
    kept = (F.col("best") != 0) & (before.isNull() | (F.col("best") != before))
    rows = steps.withColumn("kept", kept)
    signs = F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("t", "sign"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(signs, lambda s: s["sign"]), "").alias("text"), F.round(F.coalesce(F.avg(F.when(F.col("kept"), F.col("probability"))), F.lit(0.0)), 6).alias("confidence"))


def polygon_area(points: Column) -> Column:
    """Area of a polygon given as an array of structs x, y."""
    n = F.size(points)
    cross = lambda p, i: p["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(points, cross), F.lit(0.0), lambda a, x: a + x)) / 2


def polygon_perimeter(points: Column) -> Column:
    n = F.size(points)
    side = lambda p, i: F.hypot(p["x"] - F.element_at(points, (i + 1) % n + 1)["x"], p["y"] - F.element_at(points, (i + 1) % n + 1)["y"])
    return F.aggregate(F.transform(points, side), F.lit(0.0), lambda a, x: a + x)


def upper_median(values: Column) -> Column:
    """The middle value in order, the upper one of two."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
