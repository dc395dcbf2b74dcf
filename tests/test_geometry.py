"""Hulls, rectangles, homographies and components against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from privlake.operators import geometry as g


def ragged(sets):
    return np.array([p for s in sets for p in s], float).reshape(-1, 2), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(int)


def cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def brute_hull(points):
    """Corners: points that are on no segment between others and from which all others lie within half a turn."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3 or all(cross(pts[0], pts[-1], p) == 0 for p in pts):
        return {pts[0], pts[-1]} if pts else set()
    out = set()
    for a, b in itertools.permutations(pts, 2):
        if all(cross(a, b, p) > 0 or (cross(a, b, p) == 0 and min(a, b) <= p <= max(a, b)) for p in pts):
            out |= {a, b}
    return out


def some_sets(n=300):
    r = np.random.default_rng(3)
    sets = [r.integers(0, int(r.integers(2, 12)), (int(r.integers(0, 15)), 2)).tolist() for _ in range(n)]
    return sets + [[], [(1, 1)], [(1, 1)] * 3, [(0, 0), (2, 2)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (0, 3), (0, 1)], [(0, 0), (4, 0), (4, 4), (0, 4), (2, 0), (2, 2)]]


def test_hulls_and_rectangles_by_brute_force(monkeypatch):
    sets = some_sets()
    for room in (1 << 21, 64):
        monkeypatch.setattr(g, "ROOM", room)
        xy, offsets = g.hulls(*ragged(sets))
        rects, area = g.rectangles(xy, offsets), g.areas(xy, offsets)
        for k, s in enumerate(sets):
            hull = [tuple(p) for p in xy[offsets[k] : offsets[k + 1]]]
            assert set(hull) == brute_hull(s) and len(hull) == len(set(hull))
            if len(hull) < 2:
                assert np.isnan(rects[k]).all() and area[k] == 0
                continue
            if len(hull) > 2:
                assert all(cross(hull[i - 2], hull[i - 1], hull[i]) > 0 for i in range(len(hull))) and area[k] > 0
            best = np.inf
            for a, b in itertools.permutations(hull, 2):
                u = np.subtract(b, a) / np.hypot(*np.subtract(b, a))
                q = np.array(s) @ np.array([u, [-u[1], u[0]]]).T
                edge = all(cross(a, b, p) >= -1e-9 for p in hull)
                best = min(best, np.prod(q.max(0) - q.min(0))) if edge else best
            assert abs(rects[k, 4] * rects[k, 5] - best) < 1e-9
            corners = rects[k, 6:].reshape(4, 2)
            assert all(cross(corners[i - 1], corners[i], p) >= -1e-6 for i in range(4) for p in hull) or best == 0
            assert np.allclose(corners.mean(0), rects[k, :2])


def test_homographies():
    r = np.random.default_rng(1)
    src = np.array([[0, 0], [9, 0], [9, 5], [0, 5]], float) + r.normal(0, 1, (200, 4, 2))
    dst = r.normal(0, 20, (200, 4, 2))
    h = g.homography(src, dst).reshape(-1, 3, 3)
    to = np.einsum("nij,nkj->nki", h, np.concatenate([src, np.ones((200, 4, 1))], axis=2))
    assert np.allclose(to[..., :2] / to[..., 2:], dst, atol=1e-5)
    line = np.array([[[0, 0], [1, 1], [2, 2], [3, 3]]], float)
    assert np.isnan(g.homography(line, dst[:1])).all() and np.isnan(g.homography(src[:1] * np.nan, dst[:1])).all()
    assert np.allclose(g.homography(src[:1], src[:1]), [1, 0, 0, 0, 1, 0, 0, 0, 1])


def flood(on):
    h, w = on.shape
    out, n = np.full(on.shape, -1), 0
    for start in zip(*np.nonzero(on), strict=True):
        if out[start] >= 0:
            continue
        todo, out[start] = [start], n
        while todo:
            y, x = todo.pop()
            for v, u in itertools.product(range(max(0, y - 1), min(h, y + 2)), range(max(0, x - 1), min(w, x + 2))):
                if on[v, u] and out[v, u] < 0:
                    out[v, u] = n
                    todo.append((v, u))
        n += 1
    return out


def test_labels_equal_a_flood_fill():
    r = np.random.default_rng(2)
    grids = np.array([r.random((9, 13)) < p for p in np.linspace(0, 1, 1000)])
    spiral = np.zeros((1, 9, 13), bool)
    spiral[0, ::2], spiral[0, 1::4, 0], spiral[0, 3::4, -1] = True, True, True
    for on in (grids, spiral, grids[:0]):
        got = g.labels(on)
        for k in range(len(on)):
            want = flood(on[k])
            assert ((got[k] >= 0) == (want >= 0)).all()
            pairs = set(zip(got[k][on[k]].tolist(), want[on[k]].tolist(), strict=True))
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_quad_means_by_points_in_polygons(monkeypatch):
    r = np.random.default_rng(4)
    grids = r.random((5, 8, 11))
    xy, offsets = g.hulls(r.uniform(-3, 13, (400, 2)), np.arange(0, 401, 8))
    quads = g.rectangles(xy, offsets)[:, 6:].reshape(-1, 4, 2)
    quads = np.concatenate([quads, [[[20, 20], [21, 20], [21, 21], [20, 21]]], [[[0, 0]] * 4]])
    which = np.arange(len(quads)) % 5
    for room in (1 << 21, 50):
        monkeypatch.setattr(g, "ROOM", room)
        got = g.quad_means(grids, which, quads)
        for q, k, mean in zip(quads, which, got, strict=True):
            low, high = np.floor(q.min(0)), np.ceil(q.max(0))
            cells = [grids[k, y, x] for y in range(8) for x in range(11) if low[0] <= x <= high[0] and low[1] <= y <= high[1] and (all(cross(q[i - 1], q[i], (x + 0.5, y + 0.5)) >= 0 for i in range(4)) or all(cross(q[i - 1], q[i], (x + 0.5, y + 0.5)) <= 0 for i in range(4)))]
            assert abs(mean - (np.mean(cells) if cells else 0)) < 1e-12


def test_rects_as_columns(spark):
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (1.0, 1.0)]), (2, None), (3, []), (4, [(1.0, 1.0)]), (5, [(0.0, 0.0), (float("nan"), 1.0), (3.0, 4.0)])]
    frame = spark.createDataFrame(rows, "id int, points array<struct<x: double, y: double>>").withColumn("rect", F.lit("clash")).withColumn("a.b", F.lit(1))
    out = g.rotated_rects(frame)
    assert out.columns == ["id", "points", "a.b", "hull", "hull_area", "rect"]
    got = {r.id: r for r in out.withColumn("wide", g.unclipped(F.col("rect"))).withColumn("quad", g.ordered_quad(F.col("wide.corners"))).collect()}
    assert got[1].hull_area == 8 and (got[1].rect.width, got[1].rect.height) == (4, 2) and (got[1].wide.width, got[1].wide.height) == (6, 4)
    assert [tuple(p) for p in got[1].quad] == [(-1, -1), (5, -1), (5, 3), (-1, 3)]
    assert [got[k].rect for k in (2, 3, 4)] == [None] * 3 and got[5].rect.width == 5 and got[2].hull == [] and got[4].wide is None
    assert g.rotated_rects(frame.limit(0)).count() == 0
    quads = out.where("id = 1").select("id", F.col("rect.corners").alias("src"), F.expr("transform(rect.corners, p -> struct(2 * p.x + 1 as x, p.y as y))").alias("dst")).union(spark.sql("select 9, null, null"))
    assert {r.id: r.homography and [round(x, 9) for x in r.homography] for r in g.homographies(quads).collect()} == {1: [2, 0, 1, 0, 1, 0, 0, 0, 1], 9: None}


def test_painted_boxes_are_found_again(spark):
    width, height = 60, 40
    boxes = {1: [(5, 5, 20, 8), (35, 20, 10, 15)], 2: [(0, 0, 60, 40)], 3: [(3, 3, 2, 2)], 4: []}
    rows = []
    for page, all_ in boxes.items():
        grid = np.zeros((height, width))
        for x, y, w, h in all_:
            grid[y : y + h, x : x + w] = 0.9
        rows.append((page, grid.ravel().tolist()))
    rows += [(5, None), (6, [0.5]), (7, [None] * (width * height)), (8, (np.ones(width * height) * 0.4).tolist())]
    frame = spark.createDataFrame(rows, "page_id int, grid array<double>").withColumn("box", F.lit(1))
    got = {}
    for r in g.text_boxes(frame, width, height, 120, 80).orderBy("page_id", "box").collect():
        got.setdefault(r.page_id, []).append((r.box, round(r.score, 3), [tuple(p) for p in r.quad]))
    assert set(got) == {1, 2} and [b[:2] for b in got[1]] == [(0, 0.9), (1, 0.9)]
    for (x, y, w, h), (_, _, quad) in zip(boxes[1], got[1], strict=True):
        by = (w - 1) * (h - 1) * 1.5 / (2 * (w + h - 2))
        want = [(x - by, y - by), (x + w - 1 + by, y - by), (x + w - 1 + by, y + h - 1 + by), (x - by, y + h - 1 + by)]
        assert all(abs(a - min(max(2 * b, 0), m)) <= 0.5 for p, q in zip(quad, want, strict=True) for a, b, m in zip(p, q, (120, 80), strict=True))
    quad = [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]
    means = g.grid_means(frame.withColumn("quad", F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in quad))).withColumn("mean", F.lit("clash")), width, height)
    assert {r.page_id: r["mean"] and round(r["mean"], 6) for r in means.collect()} == {1: 0.225, 2: 0.9, 3: 0.05625, 4: 0.0, 5: None, 6: None, 7: 0.0, 8: 0.4}
    assert got[2][0][2] == [(0, 0), (120, 0), (120, 80), (0, 80)]
    assert g.text_boxes(frame.limit(0), width, height, 120, 80).count() == 0


def test_quads_as_by_columns(spark):
    r = np.random.default_rng(9)
    turn = r.uniform(0, 2 * np.pi, 200)
    rects = np.column_stack([r.uniform(-5, 45, 200), r.uniform(-5, 25, 200), np.cos(turn), np.sin(turn), *r.integers(0, 12, (2, 200)), np.zeros((200, 8))])
    rects[:80, 2:4] = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])[r.integers(0, 4, 80)]
    rects[:80, :2] = np.round(rects[:80, :2])
    rows = [(k, dict(zip(("center_x", "center_y", "axis_x", "axis_y", "width", "height"), map(float, a[:6]), strict=True))) for k, a in enumerate(rects)]
    frame = spark.createDataFrame(rows, "id int, rect struct<center_x: double, center_y: double, axis_x: double, axis_y: double, width: double, height: double>")
    for ratio, source in ((1.5, (400, 140)), (0.7, (333, 77))):
        scaled = lambda p: F.struct(*(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.floor(p[c] * (most / n) + 0.5).cast("double"))).alias(c) for c, most, n in zip("xy", source, (40, 20), strict=True)))  # noqa: B023, E731
        want = {k: [tuple(q) for q in quad] for k, quad in frame.select("id", g.ordered_quad(F.transform(g.unclipped(F.col("rect"), ratio)["corners"], scaled))).collect()}
        got = g.box_rows(g.pa.array(range(200)), np.zeros(200), np.zeros(200), rects, (40, 20), source, g.BoxRules(ratio=ratio)).to_pylist()
        assert {b["_id"]: [(q["x"], q["y"]) for q in b["quad"]] for b in got} == want
