"""Queries over boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from privlake.operators import ocr
from privlake.operators import spatial as s
from privlake.plans.registry import query
from privlake.sources.tables import BOXES, derived


def _boxes(spark, sf_dir):
    return derived(spark, sf_dir, BOXES, "lineitem")


def _out(rows):
    return rows.select("page_id", "ord", "category", "source", F.round("confidence", 6).alias("confidence"), "text")


_BOTH = "(greatest(0.0, least(a.x + a.w, n.x + n.w) - greatest(a.x, n.x)) * greatest(0.0, least(a.y + a.h, n.y + n.h) - greatest(a.y, n.y)))"
_SMALLER = f"coalesce({_BOTH} / nullif(least(a.w * a.h, n.w * n.h), 0), 0)"
_IOU = f"coalesce({_BOTH} / nullif(a.w * a.h + n.w * n.h - {_BOTH}, 0), 0)"
_COLUMNS = ("category", "source", "x", "y", "w", "h", "confidence", "text", "ord")


def _folded(order: str, meets: str, **new: str) -> str:
    """SQL of a fold over a page's boxes: the next box n goes to the first kept box a that it meets, whose columns become `new`, or else is kept; the state is a list, a step a round of recursion."""
    box = "{" + ", ".join(f"'{c}': {c}" for c in _COLUMNS) + "}"
    changed = "{" + ", ".join(f"'{c}': {new.get(c, f'a.{c}')}" for c in _COLUMNS) + "}"
    return f"""WITH RECURSIVE b AS ({BOXES}), p AS (SELECT page_id, list({box} ORDER BY {order}) AS boxes FROM b GROUP BY page_id),
f AS (SELECT page_id, boxes, 1 AS i, boxes[1:1] AS kept FROM p
 UNION ALL SELECT page_id, boxes, i + 1, CASE WHEN met IS NULL OR met = 0 THEN list_append(kept, n) ELSE list_transform(kept, lambda a, k: CASE WHEN k = met THEN {changed} ELSE a END) END
 FROM (SELECT *, list_position(list_transform(kept, lambda a: {meets}), true) AS met FROM (SELECT *, boxes[i + 1] AS n FROM f WHERE i < len(boxes)) g) h)
SELECT page_id, r.ord AS ord, r.category AS category, r.source AS source, round(r.confidence, 6) AS confidence, r.text AS text FROM (SELECT page_id, unnest(kept) AS r FROM f WHERE i = len(boxes)) o"""


@query(_folded("ord", f"a.category = n.category AND {_SMALLER} > 0.3", source="'combined'", confidence="least(1.0, greatest(a.confidence, n.confidence) + 0.05)", text="CASE WHEN n.confidence > a.confidence THEN coalesce(nullif(n.text, ''), a.text) ELSE a.text END"))
def region_merge(spark, sf_dir):
    return _out(s.merge_regions(_boxes(spark, sf_dir)))


@query(_folded("confidence DESC, ord", f"{_SMALLER} > 0.4"))
def face_suppression(spark, sf_dir):
    return _out(s.suppress(_boxes(spark, sf_dir)))


@query(_folded("ord", f"{_IOU} > 0.5", confidence="greatest(a.confidence, n.confidence)", text="CASE WHEN n.confidence > a.confidence THEN n.text ELSE a.text END"))
def text_block_dedupe(spark, sf_dir):
    return _out(s.dedupe_text_blocks(_boxes(spark, sf_dir)))


@query(f"""WITH b AS ({BOXES}), m AS (SELECT page_id, greatest(4.0, CAST(0.6 AS DOUBLE) * list_sort(list(h))[CAST(floor(count(*) / 2) AS BIGINT) + 1]) AS lim FROM b GROUP BY page_id),
c AS (SELECT b.*, y + h / 2 AS cy, lim FROM b JOIN m USING (page_id)), d AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, ord) > lim THEN 1 ELSE 0 END AS nw FROM c),
e AS (SELECT *, sum(nw) OVER (PARTITION BY page_id ORDER BY cy, ord ROWS UNBOUNDED PRECEDING) AS line FROM d)
SELECT page_id, ord, CAST(line AS BIGINT) AS line, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, x, cy, ord) AS INT) AS place FROM e""")
def reading_order(spark, sf_dir):
    return s.reading_order(_boxes(spark, sf_dir))


@query(f"WITH b AS ({BOXES}) SELECT page_id, list_sort(list(h))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS middle FROM b GROUP BY page_id")
def upper_median_height(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("page_id").agg(ocr.upper_median(F.collect_list("h")).alias("middle"))


_WIDE = BOXES.replace("l_partkey * 13 % 240", "l_partkey * 13 % 1400").replace("l_suppkey * 7 % 90", "l_partkey * 7 % 1300 - 200")


@query(f"""WITH b AS ({_WIDE}), c AS (SELECT page_id, ord, x + w / 2 AS cx, y + h / 2 AS cy FROM b), d AS (SELECT *, CASE WHEN cx < 480 THEN 'on the left' WHEN cx > 960 THEN 'on the right' ELSE 'in the centre' END AS across FROM c)
SELECT page_id, ord, CASE WHEN cy < 0 THEN 'above the current view — scroll up to reach it (' || across || ')' WHEN cy > 900 THEN 'below the current view — scroll down to reach it (' || across || ')' WHEN cy < 300 THEN 'near the top of the visible page, ' || across WHEN cy > 600 THEN 'near the bottom of the visible page, ' || across ELSE 'in the middle of the visible page, ' || across END AS place FROM d""")
def position_words(spark, sf_dir):
    rows = derived(spark, sf_dir, _WIDE, "lineitem")
    return rows.select("page_id", "ord", s.position_words(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("place"))


_CODES = "SELECT o_orderkey, concat('text<loc_', CAST(o_orderkey % 500 AS STRING), '><loc_', CAST(o_custkey % 400 AS STRING), '><loc_', CAST(500 + o_orderkey % 500 AS STRING), '><loc_', CAST(400 + o_custkey % 600 AS STRING), '>', CASE WHEN o_orderkey % 3 = 0 THEN 'b<loc_1><loc_2>' ELSE '' END) AS answer FROM orders"


@query(f"WITH c AS ({_CODES}), d AS (SELECT o_orderkey, list_transform(regexp_extract_all(answer, '<loc_([0-9]{{1,4}})>', 1), lambda x: CAST(x AS DOUBLE) / 1000) AS k FROM c) SELECT o_orderkey, round(k[2] * 1280, 3) AS x, round(k[1] * 720, 3) AS y, round((k[4] - k[2]) * 1280, 3) AS w, round((k[3] - k[1]) * 720, 3) AS h FROM d")
def location_codes(spark, sf_dir):
    rows = derived(spark, sf_dir, _CODES, "orders").select("o_orderkey", F.explode(ocr.location_boxes(F.col("answer"), F.lit(1280.0), F.lit(720.0))).alias("b"))
    return rows.select("o_orderkey", *(F.round(f"b.{c}", 3).alias(c) for c in "xywh"))


_STEPS = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t, l_suppkey % 3 AS best, l_quantity / 50 AS probability, substr('_ab', CAST(l_suppkey % 3 + 1 AS INT), 1) AS sign FROM lineitem"


@query(f"WITH s AS ({_STEPS}), p AS (SELECT *, lag(best) OVER (PARTITION BY l_orderkey ORDER BY t) AS b FROM s), q AS (SELECT *, best <> 0 AND (b IS NULL OR best <> b) AS kept FROM p) SELECT l_orderkey, coalesce(string_agg(sign, '' ORDER BY t) FILTER (kept), '') AS text, round(coalesce(avg(probability) FILTER (kept), 0), 6) AS confidence FROM q GROUP BY l_orderkey")
def label_sequences(spark, sf_dir):
    return ocr.ctc_decode(derived(spark, sf_dir, _STEPS, "lineitem"), "l_orderkey")


@query(f"WITH b AS ({BOXES}) SELECT page_id, ord, w * h AS area, 2 * w + 2 * h AS perimeter FROM b")
def quad_measures(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    quad = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))
    return _boxes(spark, sf_dir).select("page_id", "ord", ocr.polygon_area(quad).alias("area"), ocr.polygon_perimeter(quad).alias("perimeter"))
