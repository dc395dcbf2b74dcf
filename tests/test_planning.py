"""Plans, outcomes and fusion on small cases."""

from pyspark.sql import functions as F

from privlake.operators import planning, spatial


def test_fused_sources_equal_a_plain_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(p, i, "c", rng.choice(spatial.SOURCES), float(rng.randrange(40)), float(rng.randrange(20)), 50.0, 20.0, rng.randrange(50, 100) / 100, rng.choice(["", "a", "longer"])) for p in range(30) for i in range(8)]
    boxes = spark.createDataFrame(rows, "page_id long, ord int, category string, source string, x double, y double, w double, h double, confidence double, text string")

    def overlap(a, b):
        wide, high = min(a["x"], b["x"]) + 50 - max(a["x"], b["x"]), min(a["y"], b["y"]) + 20 - max(a["y"], b["y"])
        both = max(0, wide) * max(0, high)
        return both / (2000 - both)

    expected = []
    for p in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (spatial.SOURCES.index(r[3]), r[1])):
            b = dict(zip(boxes.columns, r, strict=True))
            if b["source"] == "dom":
                kept.append(b | {"confidence": 0.95})
                continue
            ocr = b["source"] == "ocr"
            hit = next((a for a in kept if (a["source"] == "dom" and overlap(a, b) > 0.5 if ocr else overlap(a, b) > 0.4)), None)
            if hit is None:
                kept.append(b)
            elif ocr:
                hit |= {"confidence": min(1.0, hit["confidence"] + 0.05), "text": hit["text"] or b["text"]}
            elif b["source"] == "vit":
                hit |= {"confidence": min(1.0, max(hit["confidence"], b["confidence"]) + 0.1), "text": max(hit["text"], b["text"], key=len), "source": "fused"}
        expected += [(p, a["ord"], a["source"], round(a["confidence"], 6), a["text"]) for a in kept]
    got = spatial.fuse_sources(boxes).select("page_id", "ord", "source", F.round("confidence", 6), "text").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_plan_steps(spark):
    rows = [('{"steps": [{"action": {"type": "fill", "target": "[12] x"}}]}',), ("nothing",), (None,), ("{broken}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(planning.plan_steps(F.col("t"))).collect()]
    assert [(s.action, s.target, s.value, s.confidence, s.risk) for s in got[0]] == [("type", "[12]", None, 0.8, "low")]
    assert got[1:] == [None, None, None]


def test_outcome_line(spark):
    line = lambda *a: spark.range(1).select(planning.outcome_line(*map(F.lit, a))).first()[0]
    assert line(5, 5, 0, 0) == "5/5 steps done — nothing outstanding."
    assert line(4, 5, 2, 2) == "4/5 steps done — 2 required fields still need a value from you."
    assert line(0, 0, 1, 1) == "nothing to do — 1 required field still needs a value from you."


def test_unmapped_fields(spark):
    schema = "page_id long, form_id string, ord int, name string, id string, type string, label string, value string, required boolean, max_length int, pattern string, options array<string>, checked boolean"
    row = lambda page, k, label, kind="text", value="", required=True, name="": (page, "f", k, name, "", kind, label, value, required, 0, "", [], False)
    fields = spark.createDataFrame([row(1, 0, "Email"), row(1, 1, "Given Name"), row(1, 2, "Colour"), row(1, 3, "Email", value="x"), row(1, 4, "Colour", required=None), row(1, 5, "Go", kind="submit"), row(None, 0, "Email"), row(2, 0, None, name="odd")], schema)
    saved = spark.createDataFrame([(1, "email", "a@b"), (1, "email", "c@d"), (1, "firstName", ""), (2, "email", "x")], "page_id long, key string, value string")
    got = {(r.page_id, r.ord, r.field_name) for r in planning.unmapped_fields(fields, saved).collect()}
    assert got == {(1, 1, "Given Name"), (1, 2, "Colour"), (None, 0, "Email"), (2, 0, "odd")}
    assert planning.unmapped_fields(fields.limit(0), saved).count() == 0 and planning.unmapped_fields(fields, saved.limit(0)).count() == 5


def test_region_summaries(spark):
    from privlake.operators import detector

    rows = [(1, 2, 0, 0, 0, "r3", "email", "high", "dom", 0.5), (1, 1, 0, 0, 0, "r1", "pan", "critical", "dom", 0.9), (1, 1, 1, 0, 0, "r2", "email", "high", "vision", 0.7), (1, 1, 1, 0, 0, "r2", "email", "high", "vision", 0.7), (2, 1, 0, 0, 0, "q", "odd", None, None, None)]
    regions = spark.createDataFrame(rows, "page_id long, branch int, i int, k int, m int, region_id string, category string, sensitivity string, source string, confidence double")
    got = {r.page_id: r for r in detector.summarise_regions(regions).collect()}
    assert (got[1].total, got[1].critical_count, got[1].high_count, got[1].by_category, got[1].by_source) == (4, 1, 3, {"pan": 1, "email": 3}, {"dom": 2, "vision": 2}) and abs(got[1].confidence - 0.7) < 1e-12
    assert (got[2].total, got[2].high_count, got[2].by_category, got[2].by_source, got[2].confidence) == (1, 0, {"odd": 1}, {}, None)
    lists = [(r.page_id, r.number, r.category, r.regions) for r in detector.region_lists(regions).orderBy("page_id", "number").collect()]
    assert lists == [(1, 0, "pan", ["r1"]), (1, 1, "email", ["r2", "r2", "r3"]), (2, 0, "odd", ["q"])]
    assert detector.summarise_regions(regions.limit(0)).count() == 0
