from pyspark.sql import functions as F

from privlake.operators import ocr, spatial
from privlake.plans.catalogue import QUERIES
from privlake.plans.spatial import _boxes

SCHEMA = "page_id long, ord int, category string, source string, x double, y double, w double, h double, confidence double, text string"
SF = "/root/testdata/sf0.001"


def frame(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], SCHEMA)


def test_region_merge_keeps_the_first_box(spark):
    got = spatial.merge_regions(frame(spark, ("phone", "dom", 100.0, 200.0, 200.0, 30.0, 0.9, "a"), ("phone", "vision", 105.0, 202.0, 190.0, 28.0, 0.85, "b"))).collect()
    assert [(r.source, round(r.confidence, 2), r.x, r.text) for r in got] == [("combined", 0.95, 100.0, "a")]


def brute_merge(rows, threshold=0.3):
    kept = []
    for b in rows:
        for k in kept:
            w = min(k["x"] + k["w"], b["x"] + b["w"]) - max(k["x"], b["x"])
            h = min(k["y"] + k["h"], b["y"] + b["h"]) - max(k["y"], b["y"])
            small = min(k["w"] * k["h"], b["w"] * b["h"])
            if k["category"] == b["category"] and small > 0 and max(0, w) * max(0, h) / small > threshold:
                if b["confidence"] > k["confidence"]:
                    k["confidence"], k["text"] = b["confidence"], b["text"] or k["text"]
                k["confidence"], k["source"] = min(1.0, k["confidence"] + 0.05), "combined"
                break
        else:
            kept.append(dict(b))
    return kept


def test_region_merge_against_brute_force(spark):
    pages = {}
    for r in _boxes(spark, SF).orderBy("page_id", "ord").collect():
        pages.setdefault(r.page_id, []).append(r.asDict())
    expected = {(p, k["ord"], k["source"], round(k["confidence"], 6), k["text"]) for p, rows in pages.items() for k in brute_merge(rows)}
    got = {(r.page_id, r.ord, r.source, r.confidence, r.text) for r in QUERIES["region_merge"](spark, SF).collect()}
    assert got == expected


def test_suppression_prefers_confidence(spark):
    got = spatial.suppress(frame(spark, ("face", "v", 0.0, 0.0, 10.0, 10.0, 0.5, ""), ("face", "v", 1.0, 1.0, 10.0, 10.0, 0.9, ""), ("face", "v", 50.0, 50.0, 10.0, 10.0, 0.4, ""))).collect()
    assert sorted(r.ord for r in got) == [1, 2]


def test_text_blocks(spark):
    got = spatial.dedupe_text_blocks(frame(spark, ("t", "a", 0.0, 0.0, 10.0, 10.0, 0.5, "low"), ("t", "b", 0.0, 0.0, 10.0, 10.0, 0.9, "high"), ("t", "b", 9.0, 9.0, 10.0, 10.0, 0.9, "far"))).collect()
    assert sorted((r.ord, r.text) for r in got) == [(0, "high"), (2, "far")]


def test_boxes_without_area_never_merge(spark):
    got = spatial.merge_regions(frame(spark, ("p", "a", 0.0, 0.0, 0.0, 0.0, 0.5, ""), ("p", "a", 0.0, 0.0, 0.0, 0.0, 0.5, ""))).count()
    assert got == 2


def test_reading_order(spark):
    got = spatial.reading_order(frame(spark, ("t", "a", 50.0, 0.0, 10.0, 10.0, 1.0, ""), ("t", "a", 0.0, 2.0, 10.0, 10.0, 1.0, ""), ("t", "a", 0.0, 40.0, 10.0, 10.0, 1.0, ""))).collect()
    assert {r.ord: (r.line, r.place) for r in got} == {1: (0, 1), 0: (0, 2), 2: (1, 3)}


def test_location_codes_and_quads(spark):
    row = spark.createDataFrame([("x<loc_100><loc_200><loc_300><loc_400><loc_9>",)], "t string")
    (box,) = row.select(ocr.location_boxes(F.col("t"), F.lit(1000.0), F.lit(1000.0))).first()[0]
    assert [round(v, 6) for v in box] == [200.0, 100.0, 200.0, 200.0]
    quad = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (3, 0), (3, 4))))
    assert tuple(row.select(ocr.polygon_area(quad), ocr.polygon_perimeter(quad)).first()) == (6.0, 12.0)
    assert row.select(ocr.location_boxes(F.lit("none"), F.lit(1.0), F.lit(1.0))).first()[0] == []


def test_ctc(spark):
    steps = spark.createDataFrame([(1, t, b, 0.5, s) for t, (b, s) in enumerate([(1, "a"), (1, "a"), (0, "_"), (1, "a"), (2, "b")])], "k long, t int, best int, probability double, sign string")
    assert ocr.ctc_decode(steps, "k").first().text == "aab"
