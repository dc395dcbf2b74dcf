"""Polygons and grids held as arrays: convex hulls, smallest rectangles, homographies, and text boxes found in probability maps. Numpy handles an Arrow batch of them at once, so a row never meets another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
RECT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("center_x", "center_y", "axis_x", "axis_y", "width", "height")] + [T.StructField("corners", POINTS)])
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
#: Places that one numpy step may hold: polygons times the most points of one, or boxes times cells.
ROOM = 1 << 21
#: Places of a step that is gone over many times.
CACHED = 1 << 16


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All points of an array column, and where each row's begin; null rows have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    xy = np.stack([np.asarray(flat.field(k).to_numpy(zero_copy_only=False), np.float64) for k in (0, 1)], axis=1) if len(flat) else np.zeros((0, 2))
    return xy, np.concatenate([[0], np.cumsum(sizes)])


def _arrays(xy: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT)))


def _padded(xy: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length, filled up with each row's last point, and how many are its own."""
    n = np.diff(offsets)
    at = offsets[:-1, None] + np.minimum(np.arange(max(1, n.max(initial=1))), np.maximum(n - 1, 0)[:, None])
    return (xy[np.minimum(at, len(xy) - 1)] if len(xy) else np.zeros((*at.shape, 2))), n


def _steps(offsets: np.ndarray) -> Iterator[slice]:
    """Slices of rows that fit in ROOM when padded."""
    first, n = 0, len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)
    while first < n:
        most = np.maximum.accumulate(sizes[first:])
        fits = int(np.searchsorted(most * np.arange(1, n - first + 1), ROOM, side="right"))
        yield slice(first, first := first + max(1, fits))


def _alike(*sizes: np.ndarray) -> Iterator[np.ndarray]:
    """All rows, in steps of such that are alike in every size (within a factor of 1.5) and fit in a core's cache, and in ROOM, when padded."""
    sizes = [np.maximum(a, 1) for a in sizes]
    kind = np.zeros(len(sizes[0]), np.int64)
    for a in sizes:
        kind = kind * 128 + np.ceil(2 * np.log2(a)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        step = max(1, min(ROOM, CACHED) // int(np.prod([a[rows].max(initial=1) for a in sizes])))
        yield from (rows[k : k + step] for k in range(0, len(rows), step))


def _chain(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One half of a hull for many rows of sorted points at once: a stack of places per row, from which points that don't turn left go when a further one comes."""
    rows, stack, top = np.arange(len(p)), np.zeros(p.shape[:2], np.int64), np.zeros(len(p), np.int64)
    for k in range(p.shape[1]):
        live = rows[k < n]
        back = live[top[live] >= 2]
        while len(back):
            o, a, q = p[back, stack[back, top[back] - 2]], p[back, stack[back, top[back] - 1]], p[back, k]
            turns = (a[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (a[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0])
            back = back[turns <= 0]
            top[back] -= 1
            back = back[top[back] >= 2]
        stack[live, top[live]] = k
        top[live] += 1
    return stack, top


def hulls(xy: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex hulls of many sets of points, each counter-clockwise from its leftmost point, without points on edges. Equal points count once; points that aren't finite don't count."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = np.isfinite(xy).all(axis=1)
    distinct = np.unique(np.column_stack([row[good], xy[good]]), axis=0)  # sorted by row, x, y
    return sorted_hulls(distinct[:, 1:], np.searchsorted(distinct[:, 0], np.arange(len(offsets))))


def sorted_hulls(xy: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hulls() of points that are finite, different within their row, and sorted by row, x and y."""
    # the lower half is one of each column's lowest points, the upper half one of its highest
    change = np.diff(xy[:, 0]) != 0
    change[offsets[(offsets > 0) & (offsets < len(xy))] - 1] = True
    low, high = np.flatnonzero(np.append(True, change)[: len(xy)]), np.flatnonzero(np.append(change, True)[: len(xy)])
    offsets = np.searchsorted(low, offsets)
    back = np.repeat(offsets[:-1] + offsets[1:] - 1, np.diff(offsets)) - np.arange(len(low))
    out, sizes = [np.zeros((0, 2))], [np.zeros(0, np.int64)]
    for part in _steps(offsets):
        rows, k = offsets[part.start : part.stop + 1], np.arange(max(1, np.diff(offsets[part.start : part.stop + 1]).max(initial=1)))
        (p, n), (q, _) = _padded(xy[low], rows), _padded(xy[high[back]], rows)
        (p_at, a), (q_at, b) = _chain(p, n), _chain(q, n)
        p, q = np.take_along_axis(p, p_at[:, :, None], axis=1), np.take_along_axis(q, q_at[:, :, None], axis=1)
        # a half's end that is the other's beginning counts once
        every = np.arange(len(n))
        first = (p[every, np.maximum(a - 1, 0)] == q[:, 0]).all(axis=1).astype(np.int64)
        end = b - (q[every, np.maximum(b - 1, 0)] == p[:, 0]).all(axis=1)
        out.append(np.concatenate([p, q], axis=1)[np.concatenate([k < a[:, None], (k >= first[:, None]) & (k < end[:, None])], axis=1)])
        sizes.append(a + np.maximum(end - first, 0))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def areas(xy: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed areas of polygons."""
    p, n = _padded(xy, offsets)
    q = np.roll(p, -1, axis=1)
    return np.where(n > 0, (p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(axis=1) / 2, 0.0)


def rectangles(xy: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest rectangle around each hull, which lies along one of its edges, the first of equal ones: rows of center, axis, size and four corners (14 numbers), NaN for hulls of less than two points."""
    out = np.full((len(offsets) - 1, 14), np.nan)
    n = np.diff(offsets)
    for part in _alike(n, n):
        m = n[part]
        at = offsets[part, None] + np.minimum(np.arange(max(1, m.max())), np.maximum(m - 1, 0)[:, None])
        p = xy[np.minimum(at, len(xy) - 1)] if len(xy) else np.zeros((*at.shape, 2))
        last = np.arange(p.shape[1]) == np.maximum(m - 1, 0)[:, None]
        edge = np.where(last[:, :, None], p[:, :1], np.roll(p, -1, axis=1)) - p
        length = np.hypot(edge[..., 0], edge[..., 1])
        own = (np.arange(p.shape[1]) < m[:, None]) & (length >= 1e-9)
        u = edge / np.where(own, length, 1)[:, :, None]
        v = np.stack([-u[..., 1], u[..., 0]], axis=-1)
        du, dv = np.einsum("bed,bpd->bep", u, p), np.einsum("bed,bpd->bep", v, p)
        low_u, high_u, low_v, high_v = du.min(2), du.max(2), dv.min(2), dv.max(2)
        best = np.argmin(np.where(own, (high_u - low_u) * (high_v - low_v), np.inf), axis=1)
        rows = np.arange(len(best))
        a, b, c, d = (x[rows, best] for x in (low_u, high_u, low_v, high_v))
        u, v = u[rows, best], v[rows, best]
        at = lambda s, t: s[:, None] * u + t[:, None] * v  # noqa: B023, E731
        found = np.column_stack([at((a + b) / 2, (c + d) / 2), u, b - a, d - c, at(a, c), at(b, c), at(b, d), at(a, d)])
        out[part] = np.where(own.any(axis=1)[:, None], found, np.nan)
    return out


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For rows of four points each (n, 4, 2): the nine numbers, the last of them 1, that take `src` to `dst`; NaN where no three of four points may lie on a line and do."""
    n = len(src)
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, no = np.ones_like(x), np.zeros_like(x)
    m = np.stack([np.stack([x, y, one, no, no, no, -u * x, -u * y, u], axis=-1), np.stack([no, no, no, x, y, one, -v * x, -v * y, v], axis=-1)], axis=2).reshape(n, 8, 9)
    rows, bad = np.arange(n), ~np.isfinite(m).all(axis=(1, 2))
    m[bad] = 0
    for c in range(8):
        pivot = c + np.argmax(np.abs(m[:, c:, c]), axis=1)
        held = m[rows, pivot].copy()
        m[rows, pivot] = m[:, c]
        bad |= np.abs(held[:, c]) < 1e-12
        m[:, c] = held / np.where(bad, 1, held[:, c])[:, None]
        others = m[:, :, c].copy()
        others[:, c] = 0
        m -= others[:, :, None] * m[:, c][:, None, :]
    return np.where(bad[:, None], np.nan, np.column_stack([m[:, :, 8], np.ones(n)]))


def _rect_array(rects: np.ndarray) -> pa.Array:
    none = pa.array(np.isnan(rects[:, 0]))
    corners = _arrays(np.nan_to_num(rects[:, 6:]).reshape(-1, 2), np.arange(0, 4 * len(rects) + 1, 4))
    return pa.StructArray.from_arrays([*(pa.array(np.nan_to_num(rects[:, k])) for k in range(6)), corners], names=[f.name for f in RECT], mask=none)


def rotated_rects(polygons: DataFrame, points: str = "points") -> DataFrame:
    """All columns, and hull (counter-clockwise), hull_area, and rect, the smallest rectangle around the points: center, axis, size, corners. Rows of less than two different points have no rect; null or empty ones an empty hull. Narrow."""
    schema = T.StructType([T.StructField("_row", polygons.select(F.struct("*")).schema[0].dataType), T.StructField("hull", POINTS), T.StructField("hull_area", T.DoubleType()), T.StructField("rect", RECT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy, offsets = hulls(*_points(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(xy, offsets), pa.array(areas(xy, offsets)), _rect_array(rectangles(xy, offsets))], names=["_row", "hull", "hull_area", "rect"])

    out = polygons.select(F.struct("*").alias("_row"), F.col(points).cast(POINTS).alias("_points")).mapInArrow(run, schema)
    return out.select(*(F.col(f"_row.`{c}`") for c in polygons.columns if c not in ("hull", "hull_area", "rect")), "hull", "hull_area", "rect")


def unclipped(rect: Column, ratio: float = 1.5) -> Column:
    """A rectangle with every edge pushed out by area * ratio / perimeter; one without a perimeter stays."""
    w, h = rect["width"], rect["height"]
    by = F.when(2 * (w + h) < 1e-9, F.lit(0.0)).otherwise(w * h * ratio / (2 * (w + h)))
    half_w, half_h = w / 2 + by, h / 2 + by
    corner = lambda s, t: F.struct((rect["center_x"] + s * half_w * rect["axis_x"] - t * half_h * rect["axis_y"]).alias("x"), (rect["center_y"] + s * half_w * rect["axis_y"] + t * half_h * rect["axis_x"]).alias("y"))
    moved = F.struct(*(rect[c].alias(c) for c in ("center_x", "center_y", "axis_x", "axis_y")), (w + 2 * by).alias("width"), (h + 2 * by).alias("height"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("corners"))
    return F.when(rect.isNotNull(), moved)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def ordered_quad(corners: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: the two leftmost, then the two others, each by height."""
    by_x = F.array_sort(F.transform(corners, lambda p, i: F.struct(p["x"].alias("k"), i.alias("i"), p.alias("p"))))
    by_y = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["p"]["y"].alias("k"), s["k"].alias("j"), s["i"].alias("i"), s["p"].alias("p")))), lambda s: s["p"])
    sides = lambda a: F.struct(by_y(F.slice(a, 1, 2)).alias("left"), by_y(F.slice(a, 3, 2)).alias("right"))
    return _let(by_x, lambda a: _let(sides(a), lambda s: F.array(s["left"][0], s["right"][0], s["right"][1], s["left"][1])))


def homographies(quads: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All columns, and homography: nine numbers that take the four points of `src` to those of `dst`, row by row of the matrix; null if they can't, or if either hasn't four points. Narrow."""
    schema = T.StructType([T.StructField("_row", quads.select(F.struct("*")).schema[0].dataType), T.StructField("homography", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at), (b, bt) = _points(batch.column(1)), _points(batch.column(2))
            good = np.flatnonzero((np.diff(at) == 4) & (np.diff(bt) == 4))
            four = np.arange(4)
            h = homography(a[at[good][:, None] + four], b[bt[good][:, None] + four]) if len(good) else np.zeros((0, 9))
            out = [None] * batch.num_rows
            for k, row in zip(good.tolist(), h.tolist(), strict=True):
                out[k] = None if row[0] != row[0] else row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["_row", "homography"])

    out = quads.select(F.struct("*").alias("_row"), F.col(src).cast(POINTS).alias("_a"), F.col(dst).cast(POINTS).alias("_b")).mapInArrow(run, schema)
    return out.select(*(F.col(f"_row.`{c}`") for c in quads.columns if c != "homography"), "homography")


def labels(on: np.ndarray) -> np.ndarray:
    """8-connected components of many grids (n, h, w) at once: each cell that is on gets the least place in the whole array of its component's cells, others -1.

    Each round takes the least label around and then the label of that label's cell, which doubles how far labels travel.
    """
    n, h, w = on.shape
    far = n * h * w
    label = np.where(on, np.arange(far).reshape(on.shape), far)
    while True:
        around = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        low = np.minimum(np.minimum(around[:, :-2], around[:, 1:-1]), around[:, 2:])
        low = np.minimum(np.minimum(low[:, :, :-2], low[:, :, 1:-1]), low[:, :, 2:])
        low = np.where(on, low, far)
        jumped = np.append(low.ravel(), far)[low]
        if (jumped == label).all():
            return np.where(on, label, -1)
        label = jumped


def quad_means(grids: np.ndarray, which: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """The mean of the cells of grid `which` whose centers lie in each convex quad (m, 4, 2), edges included; 0 if there are none."""
    n, h, w = grids.shape
    finite = np.where(np.isfinite(quads), quads, 0.0)
    low = np.clip(np.floor(finite.min(axis=1)).astype(np.int64), 0, None)
    high = np.minimum(np.ceil(finite.max(axis=1)).astype(np.int64), [w - 1, h - 1])
    size = np.maximum(high - low + 1, 0)
    out, flat = np.zeros(len(quads)), grids.ravel()
    for part in _alike(size[:, 1], size[:, 0]):
        q, (wide, high) = quads[part], size[part].max(axis=0, initial=0)
        i, j = np.arange(wide), np.arange(high)
        x, y = low[part, 0, None] + i + 0.5, low[part, 1, None] + j + 0.5
        left = right = np.zeros((len(q), high, wide), dtype=bool)
        for e in range(4):
            # the side of an edge on which a cell lies is a number of its line against one of its column
            a, b = q[:, e, :, None], q[:, (e + 1) % 4, :, None]
            down, over = ((b[:, 0] - a[:, 0]) * (y - a[:, 1]))[:, :, None], ((b[:, 1] - a[:, 1]) * (x - a[:, 0]))[:, None, :]
            left, right = left | (down > over), right | (down < over)
        of, line, column = np.nonzero(~(left & right) & (j < size[part, 1, None])[:, :, None] & (i < size[part, 0, None])[:, None, :])
        at = ((which[part] * h + low[part, 1]) * w + low[part, 0])[of] + line * w + column
        sums, count = np.bincount(of, flat[at], len(q)), np.bincount(of, minlength=len(q))
        out[part] = np.divide(sums, count, out=np.zeros(len(q)), where=count > 0)
    return out


def grid_means(grids: DataFrame, width: int, height: int, grid: str = "grid", quad: str = "quad") -> DataFrame:
    """All columns, and mean: the mean of those cells of the grid, an array of height * width numbers line by line, whose centers lie in the convex quad; 0 if there are none, null if the grid has another length or the quad not four points. Narrow."""
    schema = T.StructType([T.StructField("_row", grids.select(F.struct("*")).schema[0].dataType), T.StructField("mean", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy, offsets = _points(batch.column(2))
            fits = np.array([n == width * height for n in batch.column(1).value_lengths().to_pylist()], dtype=bool) & (np.diff(offsets) == 4)
            rows = np.flatnonzero(fits)
            cells = np.asarray(batch.column(1).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False), np.float64)
            means = quad_means(np.nan_to_num(cells).reshape(len(rows), height, width), np.arange(len(rows)), xy[offsets[rows][:, None] + np.arange(4)]) if len(rows) else np.zeros(0)
            out = np.full(batch.num_rows, np.nan)
            out[rows] = means
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=~fits)], names=["_row", "mean"])

    out = grids.select(F.struct("*").alias("_row"), F.col(grid).cast("array<double>").alias("_grid"), F.col(quad).cast(POINTS).alias("_quad")).mapInArrow(run, schema)
    return out.select(*(F.col(f"_row.`{c}`") for c in grids.columns if c != "mean"), "mean")


@dataclass(frozen=True)
class BoxRules:
    """From where a cell counts as text, the least mean of a box, how far boxes are pushed out, their least side before and two less than after that, and the most components looked at."""

    on: float = 0.3
    mean: float = 0.6
    ratio: float = 1.5
    side: float = 3.0
    most: int = 1000


def _components(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge cells (x, y) of each component, where each component's begin, and its grid: of components with four edge cells or more, in the order of their first cells."""
    n, h, w = on.shape
    around = np.pad(on, ((0, 0), (1, 1), (1, 1)))
    edge = on & ~(around[:, :-2, 1:-1] & around[:, 2:, 1:-1] & around[:, 1:-1, :-2] & around[:, 1:-1, 2:])
    at = np.flatnonzero(edge.ravel())
    label = labels(on).ravel()[at]
    order = np.argsort(label, kind="stable")
    at, label = at[order], label[order]
    first, count = np.unique(label, return_index=True, return_counts=True)[1:]
    kept = np.repeat(count >= 4, count)
    offsets = np.concatenate([[0], np.cumsum(count[count >= 4])])
    return np.column_stack([at[kept] % w, at[kept] // w % h]).astype(np.float64), offsets, label[first[count >= 4]] // (h * w)


def text_boxes(grids: DataFrame, width: int, height: int, source_width: int, source_height: int, id_col: str = "page_id", grid_col: str = "grid", rules: BoxRules = BoxRules()) -> DataFrame:
    """Boxes of text in probability maps: rows (`id_col`, box, score, quad), quads in source pixels from the top left corner clockwise.

    A map is an array of height * width probabilities, line by line. Cells above rules.on make 8-connected components, whose edge cells are put in their smallest rectangle; those that are too small,
    or whose mean probability inside is too low, go; the others are pushed out, scaled and held within the source. box is the component's number among those kept. A map of another length,
    or null, has no boxes; null or NaN cells count as 0. A row per map goes through a task by itself; an empty table gives no rows. Maps that are painted from boxes need not be made: pixels.painted_text_boxes().
    """
    step = max(1, ROOM // (width * height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                fits = np.array([n == width * height for n in batch.column(1).value_lengths().to_pylist()])
                rows = np.flatnonzero(fits)
                cells = batch.column(1).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
                maps = np.nan_to_num(np.asarray(cells, np.float64)).reshape(len(rows), height, width)
                of, *found = boxes_of_maps(maps, rules)
                yield box_rows(batch.column(0).take(pa.array(rows[of])), *found, (width, height), (source_width, source_height), rules)

    found = grids.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{grid_col}`").cast("array<double>").alias("_grid"))
    return found.mapInArrow(run, box_schema(found.schema["_id"])).withColumnRenamed("_id", id_col)


def boxes_of_maps(maps: np.ndarray, rules: BoxRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of maps (n, h, w): their map, number, score and smallest rectangle."""
    xy, offsets, of = _components(maps > rules.on)
    return kept_boxes(hulls(xy, offsets), of, lambda which, quads: quad_means(maps, which, quads), rules)


def kept_boxes(hull: tuple[np.ndarray, np.ndarray], of: np.ndarray, mean: Callable[[np.ndarray, np.ndarray], np.ndarray], rules: BoxRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of components, given by their hulls and, in order, their maps: map, number, score and rectangle of those that `rules` keep. `mean` of maps and quads is asked for those that are large enough."""
    rects = rectangles(*hull)
    less = np.minimum(rects[:, 4], rects[:, 5])
    out = 2 * rects[:, 4] * rects[:, 5] * rules.ratio / np.maximum(2 * (rects[:, 4] + rects[:, 5]), 1e-9)
    large = np.flatnonzero((less >= rules.side) & (less + out >= rules.side + 2))
    score = mean(of[large], rects[large, 6:].reshape(-1, 4, 2)) if len(large) else np.zeros(0)
    good, score = large[score >= rules.mean], score[score >= rules.mean]
    # of each map the first components alone are looked at, until enough boxes are kept
    number = np.arange(len(good)) - np.searchsorted(of[good], of[good])
    first = number < rules.most
    return of[good][first], number[first], score[first], rects[good][first]


def box_schema(id_field: T.StructField) -> T.StructType:
    return T.StructType([id_field, T.StructField("box", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("quad", POINTS)])


def box_rows(ids: pa.Array, number: np.ndarray, score: np.ndarray, rects: np.ndarray, grid: tuple[int, int], source: tuple[int, int], rules: BoxRules) -> pa.RecordBatch:
    """Boxes as a batch of box_schema(): rectangles on a grid (width, height) are pushed out, scaled to a source, held within it, and ordered. The same numbers as those of unclipped() and ordered_quad()."""
    cx, cy, ux, uy, w, h = rects[:, :6].T
    round_ = 2 * (w + h)
    by = np.where(round_ < 1e-9, 0.0, w * h * rules.ratio / np.where(round_ < 1e-9, 1.0, round_))
    half_w, half_h = w / 2 + by, h / 2 + by
    corners = np.array([[cx + s * half_w * ux - t * half_h * uy, cy + s * half_w * uy + t * half_h * ux] for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))]).transpose(2, 0, 1)
    corners = np.clip(np.floor(corners * [source[0] / grid[0], source[1] / grid[1]] + 0.5), 0.0, [float(source[0]), float(source[1])])
    by_x = np.take_along_axis(corners, np.argsort(corners[..., 0], axis=1, kind="stable")[:, :, None], axis=1)
    pairs = by_x.reshape(-1, 2, 2, 2)
    pairs = np.where((pairs[:, :, :1, 1] > pairs[:, :, 1:, 1])[..., None], pairs[:, :, ::-1], pairs)
    quad = pairs.reshape(-1, 4, 2)[:, [0, 2, 3, 1]].reshape(-1, 2)
    return pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(score, pa.float64()), _arrays(quad, np.arange(0, len(quad) + 1, 4))], names=["_id", "box", "score", "quad"])
