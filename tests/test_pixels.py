"""Blur, pixelation and warps against plain loops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from privlake.operators import geometry as g
from privlake.operators import pixels as p


def test_blur_and_pixelate_by_loops():
    r = np.random.default_rng(6)
    for h, w in ((1, 1), (2, 9), (9, 2), (17, 20)):
        a = r.integers(0, 256, (h, w)).astype(float)
        want = a
        for _ in range(3):
            want = np.array([[np.clip(np.rint(want[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].mean()), 0, 255) for x in range(w)] for y in range(h)])
        assert (np.abs(p.box_blur(a) - want) <= 0).all()
        blocks = np.array([[np.floor(a[y // 8 * 8 : y // 8 * 8 + 8, x // 8 * 8 : x // 8 * 8 + 8].mean() + 0.5) for x in range(w)] for y in range(h)])
        assert (p.pixelate(a) == blocks).all()


def test_warps():
    r = np.random.default_rng(8)
    a = r.random((12, 20))
    box = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
    assert np.allclose(p.warp(a, box(0, 0, 20, 12)), a, atol=1e-6) and np.allclose(p.warp(a, box(3, 2, 9, 7)), a[2:9, 3:12], atol=1e-6)
    turned = p.warp(a, np.array([[19, 0], [19, 12], [0, 12], [0, 0]], float))  # its top is the grid's right edge
    want = np.array([[p.bilinear(a, np.array(19.0 - j), np.array(float(i))) for i in range(12)] for j in range(19)])
    assert np.allclose(turned, np.rot90(want), atol=1e-6)
    assert np.allclose(p.warp(a, box(2, 1, 4, 9)), np.rot90(a[1:10, 2:6]), atol=1e-6) and p.warp(a, box(2, 1, 4, 9), upright=False).shape == (9, 4)
    plane = np.add.outer(np.arange(12) * 3.0, np.arange(20) * 2.0)  # bilinear sampling of a plane is exact
    quad = np.array([[2, 1], [15, 2], [17, 10], [1, 9]], float)
    got = p.warp(plane, quad)
    h, w = got.shape
    m = p.homography(np.array([[[0, 0], [w, 0], [w, h], [0, h]]], float), quad[None])[0]
    for j, i in ((0, 0), (3, 5), (h - 1, w - 1)):
        x, y, z = m.reshape(3, 3) @ [i, j, 1]
        assert abs(got[j, i] - (2 * x / z + 3 * y / z)) < 1e-6
    assert p.warp(a, box(1, 1, 0.2, 5)) is None and p.warp(a, np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]])) is None and p.warp(a, quad * np.nan) is None
    assert [float(p.bilinear(a, np.array(x), np.array(y))) for x, y in ((-5, -5), (99, 99))] == [a[0, 0], a[-1, -1]]


def test_grids_as_rows(spark):
    a = np.arange(12.0) * 10
    rows = [(1, a.tolist()), (2, [1.0]), (3, None), (4, [None] * 12), (None, a.tolist())]
    grids = spark.createDataFrame(rows, "page_id int, grid array<double>").withColumn("redacted", F.lit("clash"))
    regions = spark.createDataFrame(
        [(1, 0, "black_box", -1.2, 0.0, 2.0, 1.0), (1, 1, "mask_text", 3.0, 2.0, 9.0, 9.0), (1, 2, "blur", 9.0, 9.0, 1.0, 1.0), (1, 3, "none", 0.0, 0.0, 4.0, 3.0), (1, 4, "pixelate", 0.0, 1.0, 2.0, 1.0), (1, 5, "blur", None, 0.0, 1.0, 1.0), (2, 0, "blur", 0.0, 0.0, 1.0, 1.0), (3, 0, "blur", 0.0, 0.0, 1.0, 1.0), (None, 0, "blur", 0.0, 0.0, 1.0, 1.0), (4, 0, None, 0.0, 0.0, 1.0, 1.0)],
        "page_id int, ord int, strategy string, x double, y double, w double, h double",
    )
    got = {r.page_id: (r.grid, r.redacted) for r in p.redact_grids(grids, regions, 4, 3).collect()}
    want = a.copy()
    want[0], want[1], want[11], want[4], want[5] = 0, 0, 0, 45, 45
    assert got[1] == (want.tolist(), 3) and got[2] == ([1.0], 0) and got[3] == (None, 0) and got[4] == ([None] * 12, 0) and got[None] == (a.tolist(), 1)
    assert p.redact_grids(grids.limit(0), regions, 4, 3).count() == 0
    quads = grids.withColumn("quad", F.expr("transform(array(array(1d, 0d), array(3d, 0d), array(3d, 2d), array(1d, 2d)), p -> struct(p[0] as x, p[1] as y))")).withColumn("a.b", F.lit(1))
    crops = {r.page_id: r.crop and (r.crop.width, r.crop.height, [round(v, 6) for v in r.crop.pixels]) for r in p.warp_grids(quads, 4, 3).collect()}
    assert crops == {1: (2, 2, [10, 20, 50, 60]), 2: None, 3: None, 4: (2, 2, [0, 0, 0, 0]), None: (2, 2, [10, 20, 50, 60])}
    assert {r.crop for r in p.warp_grids(quads, 4, 3, most=3).collect()} == {None}


def test_painted_boxes_by_loops(spark):
    r = np.random.default_rng(3)
    boxes = [(int(k % 5), *(float(v) for v in r.uniform(-30, 130, 2)), *(float(v) for v in r.uniform(0, 60, 2)), float(r.random())) for k in range(60)]
    boxes += [(7, 21.0, 31.0, 2.0, 2.0, 0.5), (8, None, 0.0, 50.0, 50.0, 0.5), (8, 0.0, float("nan"), 50.0, 50.0, 0.5), (9, 0.0, 0.0, 50.0, 50.0, None), (9, 5.0, 5.0, 10.0, 0.0, -0.25), (None, 0.0, 0.0, 20.0, 10.0, 0.75)]
    rows = p.gather_boxes(spark.createDataFrame(boxes, "page_id int, x double, y double, w double, h double, v double"), 11, 7, 10, F.col("v"), ("x",))
    got = {r.page_id: r.grid for r in p.paint_grids(rows, 11, 7).collect()}

    def cell(page, cx, cy):
        held = [v for of, x, y, w, h, v in boxes if of == page and None not in (x, y, v) and x <= cx * 10 + 5 <= x + w and y <= cy * 10 + 5 <= y + h]
        return max(held, default=0.0)

    assert got == {page: [cell(page, cx, cy) for cy in range(7) for cx in range(11)] for page in {b[0] for b in boxes}}
    crowd = spark.range(20000).selectExpr("1 as page_id", "double(id % 3) as x", "0d as y", "50d as w", "20d as h", "id / 20000 as v")
    assert [len(r.boxes) for r in p.gather_boxes(crowd, 11, 7, 10, F.col("v")).collect()] == [1]  # equal ranges of cells are one


def test_no_grid_is_shuffled(spark):
    from privlake.plans.catalogue import QUERIES

    for name in ("painted_boxes", "quad_means", "redacted_grids"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = lambda *kinds: [k for k, line in enumerate(plan) if any(f"{kind} " in line for kind in kinds)]  # noqa: B023, E731
        assert "Generate " not in " ".join(plan) and max(at("MapInArrow")) < min(at("Join", "Aggregate", "Window")), name


def test_boxes_are_found_without_their_grids(spark):
    r = np.random.default_rng(11)
    value = lambda: float(r.choice([0.1, 0.3, 0.5, 0.7, 0.9, 1.5]))
    boxes = [(int(r.integers(0, 60)), *(float(v) for v in r.uniform(-30, 300, 2)), *(float(v) for v in r.uniform(0, 90, 2)), value()) for _ in range(400)]
    boxes += [(100, *(float(v) for v in r.uniform(0, 300, 2)), *(float(v) for v in r.uniform(0, 60, 2)), value()) for _ in range(200)]  # a page with many boxes
    boxes += [(101, 0.0, 0.0, 90.0, 90.0, 0.9), (101, 50.0, 50.0, 20.0, 20.0, float("nan")), (102, 0.0, 0.0, 90.0, 90.0, float("inf")), (103, None, 0.0, 50.0, 50.0, 0.5), (104, 0.0, 0.0, 50.0, 50.0, None), (None, 0.0, 0.0, 80.0, 70.0, 0.75)]
    boxes += [(105, 0.0, 0.0, 40.0, 40.0, 0.9), (105, 40.0, 40.0, 50.0, 50.0, 0.9), (105, 0.0, 200.0, 60.0, 60.0, 0.9), (105, 100.0, 150.0, 5.0, 5.0, 0.9)]  # by a corner; in the order of first cells
    frame = spark.createDataFrame(boxes, "page_id int, x double, y double, w double, h double, v double").repartition(3)
    width, height, size = 31, 29, (310, 300)
    maps = p.paint_grids(p.gather_boxes(frame, width, height, 10, F.col("v")), width, height).localCheckpoint()
    ranges = p.cell_ranges(frame, width, height, 10, F.col("v")).localCheckpoint()
    rows = lambda found: sorted((str(b.page_id), b.box, b.score, tuple(map(tuple, b.quad))) for b in found.collect())
    for rules in (g.BoxRules(), g.BoxRules(on=0.0, mean=0.2, side=2.0), g.BoxRules(on=0.6, mean=0.0, side=4.5, ratio=0.5, most=2), g.BoxRules(side=1.0, mean=0.1)):
        got = p.painted_text_boxes(ranges, width, height, *size, rules)
        want = g.text_boxes(maps, width, height, *size, rules=rules)
        assert got.schema == want.schema and rows(got) == rows(want) and got.count() > 10, rules
    assert p.painted_text_boxes(ranges.limit(0), width, height, *size).count() == 0
    want = rows(g.text_boxes(maps, width, height, *size))
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    try:
        assert rows(p.painted_text_boxes(ranges, width, height, *size, tasks=5)) == want
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForDistribution")


def test_hulls_of_ranges():
    r = np.random.default_rng(13)
    for width, height, most, side in ((40, 14, 6, 3.0), (40, 14, 40, 3.0), (9, 50, 25, 2.0), (5, 5, 12, 1.6)):
        row = np.sort(r.integers(0, 80, 80 * most // 2))
        x1, y1 = r.integers(0, width, len(row)), r.integers(0, height, len(row))
        x2, y2 = np.minimum(x1 + r.integers(0, width // 3 + 1, len(row)), width - 1), np.minimum(y1 + r.integers(0, height // 3 + 1, len(row)), height - 1)
        at = ((y1 * height + y2) * width + x1) * width + x2
        maps = p.painted(row, at, np.ones(len(row)), 80, width, height).reshape(-1, height, width)
        means = lambda which, quads: g.quad_means(maps, which, quads)  # noqa: B023, E731
        got, want = g.kept_boxes(*p._range_hulls(row, at, width, height, side), means, g.BoxRules(side=side, mean=0.0)), g.boxes_of_maps(maps, g.BoxRules(side=side, mean=0.0))
        assert len(got[0]) > 10 and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_pages_over_many_batches(monkeypatch):
    r = np.random.default_rng(12)
    for rows, batch, most in ((400, 7, 5), (400, 50, 16), (300, 300, 1 << 14), (0, 1, 4)):
        monkeypatch.setattr(p, "ROWS", most)
        page = np.sort(r.choice([0, 1, 2, 3, 7, 8], rows, p=[0.02, 0.5, 0.02, 0.4, 0.03, 0.03]))
        at, v = r.integers(0, 30, rows), r.random(rows)
        for ids in (pa.array(page, pa.int64(), mask=page == 7), pa.array([None if k == 7 else f"p{k}" for k in page], pa.string()), pa.array(np.where(page == 7, np.nan, page))):
            all_ = pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(v)], names=["page", "at", "v"])
            got, pages = {}, []
            for found, row, ats, vs in p._whole_pages(iter([all_.slice(k, batch) for k in range(0, rows, batch)])):
                names = [str(f) for f in found.to_pylist()]
                pages += names
                assert (np.diff(row) >= 0).all() and set(row) == set(range(len(found)))
                for k, a, x in zip(row, ats, vs, strict=True):
                    got.setdefault(names[k], []).append((a, x))
            want = {}
            for k, a, x in zip(ids.to_pylist(), at, v, strict=True):
                want.setdefault(str(k), []).append((a, x))
            assert len(pages) == len(set(pages)) and got == want


def test_no_grid_of_painted_boxes_leaves_its_task(spark):
    from privlake.plans.catalogue import QUERIES

    plan = QUERIES["painted_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("RepartitionByExpression") == 1 and "array_sort" not in plan and "collect_list" not in plan
