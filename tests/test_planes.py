"""Quantiles, directions, bands and hulls against numpy, with groups that hold most of the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralis.operators import planes as pl
from muralis.operators import quantiles as qt


@pytest.fixture(scope="module")
def points(spark):
    """A flat wall, a wall before far terrain (most of its points), a line, and a handful of points."""
    rng = np.random.default_rng(11)
    wall = np.c_[rng.uniform(0, 60, 900), rng.normal(0, 0.4, 900), rng.uniform(0, 30, 900)]
    wall = np.concatenate([wall, np.c_[rng.uniform(-900, 900, 60), rng.uniform(50, 1500, 60), rng.uniform(0, 90, 60)]])
    far = np.concatenate([np.c_[rng.uniform(0, 20, 430), rng.normal(0, 0.3, 430), rng.uniform(0, 40, 430)], np.c_[rng.uniform(-200, 200, 570), rng.uniform(20, 320, 570), rng.uniform(0, 100, 570)]])
    line = np.c_[np.arange(50.0), 2 * np.arange(50.0), np.zeros(50)]
    few = rng.normal(size=(4, 3))
    return {1: wall, 2: far, 3: line, 4: few, 5: np.ones((30, 3))}


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(g, *map(float, p), k) for g, ps in points.items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, "g long, x double, y double, z double, n long").repartition(6, "n")


def bounds(v, k=3.0):
    q1, q3 = np.percentile(v, [25, 75])
    if q3 - q1 <= 1e-9:
        return v.min(), v.max()
    inside = v[(v >= q1 - k * (q3 - q1)) & (v <= q3 + k * (q3 - q1))]
    return (inside.min(), inside.max()) if len(inside) else (v.min(), v.max())


def test_quantiles_and_bounds(spark, table, points):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in qt.group_quantiles(table, ["g"], "y", shares).collect()}
    assert set(got) == set(points)
    for g, p in points.items():
        assert got[g].n == len(p) and np.allclose(got[g].q, np.quantile(p[:, 1], shares), rtol=1e-12, atol=1e-12)
    for r in qt.robust_bounds(table, ["g"], "y").collect():
        assert np.allclose((r.lo, r.hi), bounds(points[r.g][:, 1])) and r.n == len(points[r.g])
    nulls = table.withColumn("y", F.when(F.col("g") != 1, F.col("y")))
    assert {r.g for r in qt.group_quantiles(nulls, ["g"], "y", [0.5]).collect()} == {2, 3, 4, 5}
    assert qt.group_quantiles(table.limit(0), ["g"], "y", [0.5]).collect() == []


def test_one_group_and_one_value(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 10007).cast("double")).alias("v"))
    v = np.array([5.0 if i % 3 == 0 else float(i * 7919 % 10007) for i in range(20_000)])
    assert np.allclose(qt.group_quantiles(rows, ["g"], "v", [0.01, 0.3, 0.77]).first().q, np.quantile(v, [0.01, 0.3, 0.77]))
    best = qt.densest_ranges(rows, ["g"], "v", 50.0).first()
    order = np.sort(v)
    counts = np.searchsorted(order, order + 50.0, "right") - np.searchsorted(order, order, "left")
    assert best.n == counts.max() and best.start == order[counts.argmax()]


def trimmed_axis(p, k=3.0, rounds=5):
    subset = p
    for _ in range(rounds):
        mean = subset.mean(axis=0)
        axis = np.linalg.svd(subset - mean, full_matrices=False)[2][0]
        at = (p - mean) @ axis
        lo, hi = bounds(at, k)
        inside = p[(at >= lo) & (at <= hi)]
        if len(inside) == len(subset) or len(inside) < 2:
            break
        subset = inside
    return axis


def test_principal_directions(table, points):
    got = {r.g: np.array(r.axis) for r in pl.principal_directions(table, "g").collect()}
    assert set(got) == set(points)
    for g, p in points.items():
        if g != 5:  # equal points have no direction
            assert abs(abs(got[g] @ trimmed_axis(p)) - 1) < 1e-9, g


def near_plane(p, normal):
    mean = subset_mean = p.mean(axis=0)
    subset = p
    for _ in range(3):
        at = (p - mean) @ normal
        lo, hi = bounds(at)
        inside = p[(at >= lo) & (at <= hi)]
        if len(inside) == len(subset) or len(inside) < 10:
            break
        subset, mean = inside, inside.mean(axis=0)
    subset_mean = mean
    own = (subset - subset_mean) @ normal
    if np.percentile(own, 90) - np.percentile(own, 10) > 5:
        at = (p - mean) @ normal
        order = np.sort(at)
        counts = np.searchsorted(order, order + 3.0, "right") - np.arange(len(order))
        k = int(counts.argmax())
        if counts[k] >= 0.25 * len(p):
            seed = p[(at >= order[k]) & (at <= order[k] + 3.0)].mean(axis=0)
            for _ in range(3):
                near = np.abs((p - seed) @ normal) <= 1.5
                if near.sum() < 10 or np.allclose(p[near].mean(axis=0), seed):
                    break
                seed = p[near].mean(axis=0)
            return p[np.abs((p - seed) @ normal) <= 1.5], seed, True
    return subset, subset_mean, False


def test_wall_points(spark, table, points):
    normals = spark.createDataFrame([(g, [0.0, 1.0, 0.0]) for g in points], "g long, normal array<double>")
    near, middle = pl.wall_points(table, normals, "g")
    got = {r.g: r for r in middle.collect()}
    kept = {}
    for r in near.collect():
        kept.setdefault(r.g, []).append((r.x, r.y, r.z))
    assert near.columns == table.columns
    for g, p in points.items():
        rows, mean, reseeded = near_plane(p, np.array([0.0, 1.0, 0.0]))
        assert got[g].reseeded == reseeded == (g == 2) or g == 3
        assert np.allclose(got[g].mean, mean) and got[g].n_in == len(rows)
        assert np.allclose(sorted(kept[g]), sorted(map(tuple, rows)))


def test_hulls_of_many_points(spark):
    """A million points of one photo, in many tasks."""
    many = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("image"), (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"))
    other = spark.createDataFrame([(2, 0.0, 0.0), (2, 4.0, 0.0), (2, 4.0, 4.0), (2, 1.0, 1.0), (2, 2.0, 0.0), (3, 1.0, 1.0), (2, None, 3.0)], "image int, x double, y double")
    got = {r.image: [(p.x, p.y) for p in r.hull] for r in pl.convex_hulls(many.unionByName(other), "image").collect()}
    assert got == {1: [(0, 0), (999, 0), (999, 999), (0, 999)], 2: [(0, 0), (4, 0), (4, 4)], 3: [(1, 1)]}


def test_wall_region(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(x), float(y), 0.1) for x, y in rng.uniform(20, 60, (200, 2))] + [(1, 5000.0, 30.0, 0.0), (1, 30.0, 5.0, 3.0)] + [(2, 1.0, 1.0, 0.0)] * 19
    hulls = pl.wall_hulls(spark.createDataFrame(rows, "image int, x double, y double, off double"), "image")
    found = hulls.collect()
    assert [(r.image, r.n) for r in found] == [(1, 200)]
    h = [0.5, 0.1, 4.0, -0.05, 0.6, 3.0, 0.0, 0.0005, 1.0]
    t = spark.createDataFrame([(1, h, 100.0, 80.0), (2, h, 100.0, 80.0)], "image int, h array<double>, w double, h_px double")
    got = {(r.y, r.x) for r in pl.wall_region(hulls, t, "image", 60, 50).collect()}
    p = np.array([(v.x, v.y) for v in found[0].hull])
    reach = 0.01 * np.hypot(100, 80)
    expected = set()
    back = np.linalg.inv(np.array(h).reshape(3, 3))
    for y in range(50):
        for x in range(60):
            s = back @ (x, y, 1)
            s = s[:2] / s[2]
            if not (0 <= s[0] < 100 and 0 <= s[1] < 80):
                continue
            q = np.roll(p, -1, axis=0)
            cross = (q[:, 0] - p[:, 0]) * (s[1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (s[0] - p[:, 0])
            off = min(np.linalg.norm(a + np.clip((s - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1) * (b - a) - s) for a, b in zip(p, q))
            if (cross >= 0).all() or off <= reach:
                expected.add((y, x))
    assert got == expected and len(got) > 100


def test_bounds_of_few_groups_sort_no_group(spark):
    """A few groups' quartiles meet their values where these are: sorted by group, a face's values would all be in one task."""
    from muralis.operators.quantiles import robust_bounds

    values = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50 + F.when(F.col("id") % 400 == 0, 1e4).otherwise(0.0)).alias("v"))
    found = robust_bounds(values, ["g"], "v")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.g, r.n, r.lo, r.hi) for r in found.collect()) == [(g, n, 0.0, 49.0) for g, n in ((0, 667), (1, 667), (2, 666))]


def test_a_task_hands_on_a_cell_of_the_region_once(spark):
    square = [(x, y) for x, y in ((5.0, 5.0), (25.0, 5.0), (25.0, 25.0), (5.0, 25.0))]
    rows = [(k, [{"x": x, "y": y} for x, y in square], [1.0, 0.0, float(k % 2), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 40.0, 30.0) for k in range(20)]
    both = spark.createDataFrame(rows, "image int, hull array<struct<x:double,y:double>>, h array<double>, w double, h_px double").coalesce(1)
    found = pl.wall_region(both.select("image", "hull"), both.select("image", "h", "w", "h_px"), "image", 60, 50)
    cells = [(r.y, r.x) for r in found.collect()]
    assert len(cells) == len(set(cells)) and {(15, x) for x in range(5, 27)} <= set(cells)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
