"""Unions and repairs of polygons against fine rasters, and the polygon operators against those of boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from muralis.functions import rings
from muralis.plans import catalog

DATA = "/root/testdata/sf0.001"


def box(x, y, w, h):
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)


def covered(points, polygon):
    q, inside = np.roll(polygon, -1, axis=0), np.zeros(len(points), bool)
    for (ax, ay), (bx, by) in zip(polygon, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= ((ay > points[:, 1]) != (by > points[:, 1])) & (points[:, 0] < (bx - ax) * (points[:, 1] - ay) / (by - ay) + ax)
    return inside


def test_unions_equal_rasters():
    """Concave stars in any position, that overlap, touch or lie apart; their unions as their parts say."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        stars = []
        for _ in range(rng.integers(1, 6)):
            k = rng.integers(5, 10)
            angle = 2 * np.pi * (np.arange(k) + rng.uniform(0, 0.8, k)) / k
            stars.append(np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(2, 10, k)[:, None] + rng.uniform(-8, 8, 2))
        shapes = [rings.cleaned(p) for p in stars]
        assert all(s is not None and abs(rings.area(s) - abs(rings.signed_area(p))) < 1e-3 for s, p in zip(shapes, stars))
        lo, hi = np.min([p.min(axis=0) for p in stars], axis=0), np.max([p.max(axis=0) for p in stars], axis=0)
        xs, ys = (lo[i] + (np.arange(400) + 0.5) * (hi[i] - lo[i]) / 400 for i in (0, 1))
        cells = np.stack(np.meshgrid(xs, ys), axis=-1).reshape(-1, 2)
        found = rings.union(shapes)
        expected = np.logical_or.reduce([covered(cells, p) for p in stars]).mean() * np.prod(hi - lo)
        assert abs(rings.area(found) - expected) < 0.01 * expected
        assert abs(sum(map(rings.area, rings.parts(found))) - rings.area(found)) < 1e-6


def test_union_in_golden_cases():
    side = rings.union([[box(0, 0, 2, 2)], [box(2, 0, 2, 2)]])
    assert len(side) == 1 and sorted(map(tuple, side[0])) == [(0, 0), (0, 2), (4, 0), (4, 2)]
    assert [rings.area(p) for p in rings.parts(rings.union([[box(0, 0, 2, 2)], [box(2, 2, 3, 3)]]))] == [9, 4]
    frame = rings.parts(rings.union([[box(0, 0, 10, 2)], [box(0, 8, 10, 2)], [box(0, 0, 2, 10)], [box(8, 0, 2, 10)]]))
    assert len(frame) == 1 and len(frame[0]) == 2 and rings.area(frame[0]) == 64
    assert rings.area(rings.union([[box(0, 0, 4, 4)], [box(1, 1, 2, 2)], [box(0, 0, 4, 4)]])) == 16
    assert rings.union([]) == [] and rings.cleaned(None) is None and rings.cleaned(np.zeros((2, 2))) is None
    bow = rings.cleaned(np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float))
    assert rings.area(bow) == 4
    assert rings.area(rings.cleaned(box(0, 0, 3, 2)[::-1])) == 6  # clockwise


def test_union_by_key_over_tasks(spark):
    rows = [(k % 3, [{"x": float(x), "y": float(y)} for x, y in box(k % 50, 0, 1.5, 2)]) for k in range(300)] + [(7, None), (8, [{"x": 0.0, "y": 0.0}])]
    df = spark.createDataFrame(rows, "g int, polygon array<struct<x:double,y:double>>").repartition(5)
    got = {r.g: (r.n_parts, None if r.area is None else round(r.area, 6), r.total_area) for r in rings.union_by(df, "g").collect()}
    assert got[7] == got[8] == (0, None, None)
    for g in range(3):
        starts = sorted({k % 50 for k in range(300) if k % 3 == g})
        assert got[g][0] == 1 and got[g][1] == 2 * (starts[-1] + 1.5)


@pytest.mark.parametrize(("ours", "boxes"), [("polygon_id_match", "crack_id_match"), ("polygon_eval", "eval_confusion")])
def test_turned_polygons_give_what_boxes_give(spark, ours, boxes):
    a, b = (catalog.QUERIES[n](spark, DATA) for n in (ours, boxes))
    assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_convex_overlaps_equal_those_by_slabs():
    """Triangles to octagons, either way round, apart, within and side by side; and a star, which is repaired, not taken as convex."""
    from muralis.functions import polygons

    rng, shapes = np.random.default_rng(1), []
    for _ in range(400):
        k = rng.integers(3, 9)
        angle = 2 * np.pi * (np.arange(k) + rng.uniform(0, 0.7, k)) / k
        shapes.append((np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(2, 9) + rng.uniform(-9, 9, 2))[:: rng.choice((1, -1))])
    shapes += [box(0, 0, 2, 2), box(2, 0, 2, 2), box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)]
    lists = pa.array([rings.plain(p) for p in shapes])
    other = lists.take(pa.array(np.roll(np.arange(len(shapes)), 1)))
    others = [shapes[-1], *shapes[:-1]]
    got = polygons._iou(lists, other).to_pylist()
    assert all(abs(g - polygons.iou(p, q)) < 1e-9 for g, p, q in zip(got, shapes, others, strict=True))
    star = [{"x": float(np.cos(4 * np.pi * k / 5)), "y": float(np.sin(4 * np.pi * k / 5))} for k in range(5)]
    back = polygons._clean(pa.array([None, star, rings.plain(box(0.1234567891, 0, 3, 2)[::-1]), [{"x": 0.0, "y": 0.0}], [{"x": float("nan"), "y": 0.0}] * 3]))
    assert back[0].as_py() is None and len(back[1]) == 10 and back[3].as_py() is None and back[4].as_py() is None
    assert sorted((p["x"], p["y"]) for p in back[2].as_py()) == sorted(map(tuple, box(0.1234567891, 0, 3, 2)))  # not snapped


def test_polygons_at_a_limit_go_by_the_boxes(spark):
    """Boxes that touch, but for the last bits of their sums: SQL counts what overlap those leave, polygons alone cannot tell."""
    from muralis.operators import cracks
    from muralis.plans import catalog_shapes as cs

    rows = [(1, 1, 0.9, 0.1, 0.0, 0.2, 10.0), (2, 2, 0.8, 0.3, 0.0, 5.0, 10.0), (3, 3, 0.7, 40.0, 0.0, 10.0, 10.0), (4, 4, 0.6, 45.0, 0.0, 10.0, 10.0)]
    b = spark.createDataFrame(rows, "id long, image_id long, conf double, x0 double, y0 double, w double, h double")
    p = cracks.with_bounds(b.withColumn("polygon", cs._box()).withColumn("box", F.struct("x0", "y0", "w", "h")))
    by_sql = lambda df, f: sorted((r.a, r.b) for r in f(df).collect())
    assert 0.1 + 0.2 > 0.3
    assert by_sql(p, lambda x: cracks.duplicates_across_images(x, settle=cs.by_boxes)) == by_sql(b, cracks.duplicates_across_images) == [(1, 2), (3, 4)]


def test_centres_of_polygons_at_the_limit_go_by_the_boxes(spark):
    """Centres exactly 40 apart: SQL's subtractions leave the first pair beyond the limit and the second within it."""
    from muralis.operators import cracks
    from muralis.plans import catalog_shapes as cs

    near, far = (556.0, 545.7, 36.1, 28.0), (588.0, 571.7, 36.1, 24.0)
    rows = [(1, 1, 0.9, *near), (2, 2, 0.8, *far), (4, 1, 0.9, near[0], near[1] + 300, *near[2:]), (3, 2, 0.8, far[0], far[1] + 300, *far[2:])]
    b = spark.createDataFrame(rows, "id long, image_id long, conf double, x0 double, y0 double, w double, h double")
    p = cracks.with_bounds(b.withColumn("polygon", cs._box()).withColumn("box", F.struct("x0", "y0", "w", "h")))
    found = sorted((r.a, r.b) for r in cracks.duplicates_across_images(p, settle=cs.by_boxes, settle_centre=cs.centre_gap_by_boxes).collect())
    assert found == [(r.a, r.b) for r in cracks.duplicates_across_images(b).collect()] == [(3, 4)]


def test_common_areas_by_parts_of_edges():
    """Pairs apart are told from pairs that touch, and edges along each other count once."""
    from muralis.functions import polygons

    rng = np.random.default_rng(3)
    angle = lambda n: np.sort(rng.uniform(0, 2 * np.pi, (2000, n)), axis=1)
    p, q = ((np.stack([np.cos(a), np.sin(a)], -1) * rng.uniform(2, 9, (2000, 1, 1)) + rng.uniform(-9, 9, (2000, 1, 2))) for a in (angle(4), angle(6)))
    fine = (rings.turns(p) > 0) & (rings.turns(q) > 0)
    p, q = p[fine], q[fine]
    got, expected = polygons.common_areas(p.transpose(2, 1, 0), q.transpose(2, 1, 0)), polygons.convex_overlaps(p, q)
    assert len(got) > 1000 and 0.2 < np.isnan(got).mean() < 0.8
    assert np.abs(np.nan_to_num(got) - expected).max() < 1e-9
    squares = np.array([box(0, 0, 2, 2), box(0, 0, 2, 2), box(0, 0, 2, 2), box(0, 0, 2, 2)]).transpose(2, 1, 0)
    others = np.array([box(0, 0, 2, 2), box(0, 1, 2, 2), box(2, 0, 2, 2), box(2.1, 0, 2, 2)]).transpose(2, 1, 0)
    np.testing.assert_allclose(polygons.common_areas(squares, others), [4, 2, 0, np.nan])


def test_polygons_of_a_full_cell_meet_in_tiles(spark, monkeypatch):
    """All pairs of a cell that holds more polygons than meet at once, found once each; bent shapes, shapes over several cells, and groups apart."""
    from muralis.functions import polygons
    from muralis.operators import cracks, overlaps

    monkeypatch.setattr(overlaps, "TILE", 16)
    rng, shapes = np.random.default_rng(4), []
    for k in range(150):
        n = rng.integers(3, 7)
        a = 2 * np.pi * (np.arange(n) + rng.uniform(0, 0.7, n)) / n
        r = rng.uniform(0.3, 1, n) if k % 5 == 0 else 1.0  # some are not convex
        shapes.append(np.c_[np.cos(a) * r, np.sin(a) * r] * rng.uniform(2, 9) + rng.uniform(0, 40, 2))
    rows = [(k, k % 2, rings.plain(p)) for k, p in enumerate(shapes)]
    placed = cracks.with_bounds(spark.createDataFrame(rows, f"id long, face long, polygon {polygons.POLYGON}"))
    found = {(r.a_id, r.b_id): r.iou for r in overlaps.polygon_pairs(placed, cell=32.0).collect()}
    iou = {(a, b): polygons.iou(shapes[a], shapes[b]) for a in range(150) for b in range(a + 1, 150)}
    expected = {k: v for k, v in iou.items() if v > overlaps.SLIVER}
    assert set(found) == set(expected) and max(abs(found[k] - expected[k]) for k in found) < 1e-9
    rest = overlaps.polygon_pairs(placed, cell=32.0, within=["face"], least=0.2, emits=["id"])
    got = [tuple(r[:2]) for r in rest.collect()]
    assert rest.columns == ["a_id", "b_id", "iou"] and sorted(got) == sorted(k for k, v in expected.items() if v >= 0.2 and k[0] % 2 == k[1] % 2)


def test_greedy_matches_over_batches(spark):
    """Left rows in order, each its best free right row; groups apart, and more rows than a batch holds."""
    from muralis.operators import cracks

    rng = np.random.default_rng(2)
    rows = [(int(g), int(l), int(r), float(s)) for g, l, r, s in zip(rng.integers(0, 3, 3000), rng.integers(0, 90, 3000), rng.integers(0, 90, 3000), rng.integers(0, 9, 3000) / 10, strict=True)]
    rows = [(g, l, r, s) for (g, l, r), s in {(g, l, r): s for g, l, r, s in rows}.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = sorted(map(tuple, cracks.greedy_matches(spark.createDataFrame(rows, "g int, left_ord long, right_ord long, score double"), "g", 0.3).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    taken, done, expected = set(), set(), []
    for g, l, r, s in sorted(rows, key=lambda x: (x[0], x[1], -x[3], x[2])):
        if s >= 0.3 and (g, l) not in done and (g, r) not in taken:
            done.add((g, l))
            taken.add((g, r))
            expected.append((g, l, r, s))
    assert got == sorted(expected)


def test_canvas_masks_equal_single_fills(spark):
    """Stars and boxes on, across and off the canvas, as masks of 64 pixels and one by one; and shares against sets of cells."""
    from muralis.functions import polygons
    from muralis.operators import walls

    rng, shapes = np.random.default_rng(3), [box(-5, -5, 300, 4), box(60, 3, 10, 2), box(500, 500, 3, 3)]
    for _ in range(80):
        k = rng.integers(3, 8)
        angle = 2 * np.pi * np.sort(rng.uniform(0, 1, k))
        shapes.append(np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(1, 40, k)[:, None] + rng.uniform(-20, 170, 2))
    df = spark.createDataFrame([*((i, rings.plain(p)) for i, p in enumerate(shapes)), (99, None)], "id int, polygon array<struct<x:double,y:double>>")
    wall = {(y, x) for y in range(0, 100, 2) for x in range(0, 150, 3)}
    got = {r.id: (r.pixels, r.on_wall) for r in walls.on_wall_shares(df, spark.createDataFrame(sorted(wall), "y int, x int"), 150, 100).collect()}
    for i, p in enumerate(shapes):
        cells = set(zip(*(v.tolist() for v in polygons.filled(p, 150, 100)), strict=True))
        assert got[i] == (len(cells), len(cells & wall))
    assert got[99] == (0, 0)


def test_nearest_by_growing_distances(spark):
    """Crowds, copies of one place and rows far out: as brute force, ties to the smaller key."""
    from muralis.operators import spatial

    rng = np.random.default_rng(4)
    xy = np.round(np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(0, 30, (60, 2)), np.zeros((40, 2)), [[500.0, 500.0]]]), 1)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, 1.0)], "id int, x double, y double")
    got = {(r.a, r.b) for r in spatial.nearest_neighbours(points, key="id", axes=["x", "y"], radius=20.0, k=4).collect()}
    far = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    expected = {(a, b) for a in range(len(xy)) for b in sorted((b for b in range(len(xy)) if b != a and far[a, b] <= 20), key=lambda b: (far[a, b], b))[:4]}
    assert got == expected


def test_rasterised_polygons(spark):
    from muralis.functions import polygons

    polygons.register(spark)
    shapes = spark.createDataFrame([(1, [{"x": 1.0, "y": 1.0}, {"x": 5.0, "y": 1.0}, {"x": 1.0, "y": 5.0}]), (2, None), (3, [{"x": -3.0, "y": 2.0}, {"x": 1.0, "y": 2.0}, {"x": 1.0, "y": 3.0}, {"x": -3.0, "y": 3.0}])], "id int, p array<struct<x:double,y:double>>")
    got = spark.sql("SELECT s.id, r.y, r.x FROM {s} s, LATERAL rasterise(s.p, 10, 10) r", s=shapes).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert {r.id: r.n for r in got} == {1: 15, 3: 4}
