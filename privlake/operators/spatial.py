"""Boxes on pages: merging, suppression, reading order and position.

Box tables have page_id, ord, category, source, x, y, w, h, confidence, text. The folds are greedy in a fixed order, so they run over a
page's boxes as one array; its size is a page's, whatever the corpus's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIELDS = ("category", "source", "x", "y", "w", "h", "confidence", "text", "ord")


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def over_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if that is 0."""
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def _pages(boxes: DataFrame, key: Column) -> DataFrame:
    row = F.struct(key.alias("_k"), *(F.col(c) for c in _FIELDS))
    return boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def merge_regions(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Boxes of one category that overlap a kept box by more than `threshold` of the smaller one are merged into it, in order of `ord`.

    The kept box stays where it is; the higher confidence counts, raised by 0.05 up to 1 with each merge, and its source becomes `combined`.
    """

    def step(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: (a["category"] == b["category"]) & (over_smaller(a, b) > threshold)), F.lit(True))
        merged = lambda a: F.struct(a["_k"], a["category"], F.lit("combined").alias("source"), a["x"], a["y"], a["w"], a["h"], F.least(F.lit(1.0), F.greatest(a["confidence"], b["confidence"]) + 0.05).alias("confidence"), F.when(b["confidence"] > a["confidence"], F.coalesce(F.nullif(b["text"], F.lit("")), a["text"])).otherwise(a["text"]).alias("text"), a["ord"])
        return F.when(at > 0, F.transform(acc, lambda a, i: F.when(i + 1 == at, merged(a)).otherwise(a))).otherwise(F.concat(acc, F.array(b)))

    return _fold(boxes, F.col("ord"), step)


def suppress(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Boxes in order of confidence, but for those that overlap a kept one by more than `threshold` of the smaller."""
    step = lambda acc, b: F.when(F.exists(acc, lambda a: over_smaller(a, b) > threshold), acc).otherwise(F.concat(acc, F.array(b)))
    return _fold(boxes, F.struct(-F.col("confidence"), F.col("ord")), step)


def dedupe_text_blocks(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Text blocks in order of `ord`; one whose IoU with a kept block is over `threshold` gives it its text if it is more confident, and goes."""

    def step(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: iou(a, b) > threshold), F.lit(True))
        better = lambda a: F.when(b["confidence"] > a["confidence"], F.struct(a["_k"], a["category"], a["source"], a["x"], a["y"], a["w"], a["h"], b["confidence"], b["text"], a["ord"])).otherwise(a)
        return F.when(at > 0, F.transform(acc, lambda a, i: F.when(i + 1 == at, better(a)).otherwise(a))).otherwise(F.concat(acc, F.array(b)))

    return _fold(boxes, F.col("ord"), step)


def _fold(boxes: DataFrame, key: Column, step) -> DataFrame:
    pages = _pages(boxes, key)
    kept = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return pages.select("page_id", F.explode(kept).alias("b")).select("page_id", *(F.col(f"b.{c}").alias(c) for c in _FIELDS))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes with line and place: by centre from top to bottom, a new line where the gap to the box before is over max(4, 0.6 x upper median height), then by x."""
    page, by = Window.partitionBy("page_id"), [F.col("y") + F.col("h") / 2, F.col("ord")]
    # the upper median is the box that has its place by height: one sort per page, and no array
    nth, number = F.row_number().over(page.orderBy("h", "ord")), F.count("*").over(page)
    middle = F.max(F.when(F.col("_nth") == F.floor(F.col("_number") / 2) + 1, F.col("h"))).over(page)
    rows = boxes.withColumn("_nth", nth).withColumn("_number", number).withColumn("limit", F.greatest(F.lit(4.0), 0.6 * middle)).withColumn("cy", by[0])
    rows = rows.withColumn("new", (F.col("cy") - F.lag("cy").over(page.orderBy("cy", "ord")) > F.col("limit")).cast("int"))
    rows = rows.withColumn("line", F.coalesce(F.sum("new").over(page.orderBy("cy", "ord").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    place = F.row_number().over(page.orderBy("line", "x", "cy", "ord"))
    return rows.select("page_id", "ord", F.col("line").cast("long").alias("line"), place.alias("place"))


def position_words(x: Column, y: Column, w: Column, h: Column, wide: float = 1440.0, high: float = 900.0) -> Column:
    """Where a box is, in thirds of the view, or above or below it."""
    cx, cy = x + w / 2, y + h / 2
    across = F.when(cx < wide / 3, "on the left").when(cx > wide * 2 / 3, "on the right").otherwise("in the centre")
    down = F.when(cy < high / 3, "near the top").when(cy > high * 2 / 3, "near the bottom").otherwise("in the middle")
    return F.when(cy < 0, F.concat(F.lit("above the current view — scroll up to reach it ("), across, F.lit(")"))).when(cy > high, F.concat(F.lit("below the current view — scroll down to reach it ("), across, F.lit(")"))).otherwise(F.concat(down, F.lit(" of the visible page, "), across))


#: Kinds of sources in the order in which they are fused, the confidence of the first, overlaps and increments.
SOURCES = ("dom", "ocr", "vit", "vit_text")
DOM_CONFIDENCE = 0.95


def fuse_sources(boxes: DataFrame) -> DataFrame:
    """Boxes of several detectors as one graph: page elements first, then recognised text, seen objects and seen text.

    Recognised text on an element (IoU over 0.5) raises it by 0.05 and fills its empty label. A seen object on any box (over 0.4) makes that
    `fused`, with the higher confidence and 0.1 more and the longer label. Seen text on any box goes. All others are boxes of their own; confidence ends at 1.
    """

    def step(acc: Column, b: Column) -> Column:
        ocr, vit = b["source"] == "ocr", b["source"] == "vit"
        meets = lambda a: F.when(ocr, (a["source"] == "dom") & (iou(a, b) > 0.5)).otherwise(iou(a, b) > 0.4) & (b["source"] != "dom")
        at = F.array_position(F.transform(acc, meets), F.lit(True))
        sure = lambda a: F.when(ocr, a["confidence"] + 0.05).when(vit, F.greatest(a["confidence"], b["confidence"]) + 0.1).otherwise(a["confidence"])
        label = lambda a: F.when(ocr, F.coalesce(F.nullif(a["text"], F.lit("")), b["text"])).when(vit & (F.length(b["text"]) > F.length(F.coalesce(a["text"], F.lit("")))), b["text"]).otherwise(a["text"])
        fused = lambda a: F.struct(a["_k"], a["category"], F.when(vit, "fused").otherwise(a["source"]).alias("source"), a["x"], a["y"], a["w"], a["h"], F.least(F.lit(1.0), sure(a)).alias("confidence"), label(a).alias("text"), a["ord"])
        return F.when(at > 0, F.transform(acc, lambda a, i: F.when(i + 1 == at, fused(a)).otherwise(a))).otherwise(F.concat(acc, F.array(b)))

    first = boxes.withColumn("confidence", F.when(F.col("source") == "dom", F.lit(DOM_CONFIDENCE)).otherwise(F.col("confidence")))
    phase = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return _fold(first, F.struct(phase, "ord"), step)
