"""Lines and planes through points of faces: the trimmed principal direction, the band around a wall, the hulls of what is on it.

Every round is a few aggregates per face over all points; a face's points are never together in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.operators.quantiles import densest_ranges, group_quantiles, robust_bounds, within
from muralis.storage import materialise

AXES = ("x", "y", "z")

# The wall is not the dominant cluster if the distances of its points spread by more than this (m); the slab that it is then
# sought by, the share of all points that this must hold, half the band around it, and the least points of a refit.
WIDE_M, SLAB_M, SLAB_SHARE, BAND_M, LEAST_POINTS = 5.0, 3.0, 0.25, 1.5, 10
# Points nearer to the plane than this are on the wall (m), and the least of them that make a region.
ON_WALL_M, LEAST_ON_WALL = 0.8, 20
# Share of the photo's diagonal by which a region reaches beyond its points.
REACH_SHARE = 0.01


def _along(axis: str, mean: str) -> Column:
    """Signed distance of a point from ``mean`` along ``axis``."""
    return sum((F.col(a) - F.col(mean)[k]) * F.col(axis)[k] for k, a in enumerate(AXES))


def _means(points: DataFrame, group: str) -> DataFrame:
    return points.groupBy(group).agg(F.count("*").alias("n"), F.array(*(F.avg(a) for a in AXES)).alias("mean"))


def _main_axis(cov: pd.Series) -> pd.Series:
    """Eigenvector of the largest eigenvalue, its first component that is not zero positive."""
    out = []
    for c in cov:
        xx, xy, xz, yy, yz, zz = c
        v = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))[1][:, -1]
        lead = v[np.argmax(np.abs(v) > 1e-12)]
        out.append((v if lead > 0 else -v).tolist())
    return pd.Series(out)


def fitted_axes(points: DataFrame, group: str) -> DataFrame:
    """group, n, mean, axis: the direction of the largest variance; deviations are from the mean, so sums stay small."""
    means = _means(points, group)
    d = [F.col(a) - F.col("mean")[k] for k, a in enumerate(AXES)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = points.join(means, group).groupBy(group).agg(F.array(*(F.avg(d[i] * d[j]) for i, j in pairs)).alias("cov"))
    return means.join(cov, group).select(group, "n", "mean", F.pandas_udf(_main_axis, "array<double>")("cov").alias("axis"))


def principal_directions(points: DataFrame, group: str, *, k: float = 3.0, rounds: int = 5) -> DataFrame:
    """group, axis, n: the direction along which a group's points (group, x, y, z) spread most, without those that lie more than k
    interquartile ranges beyond the quartiles along it; fitted anew until their number n stays, or for ``rounds`` rounds."""
    points = materialise(points.select(group, *AXES), "points")
    subset, done = points, None
    for turn in range(rounds):
        fit = materialise(fitted_axes(subset, group), "axes")
        placed = points.join(fit, group).withColumn("at", _along("axis", "mean"))
        bounds = materialise(robust_bounds(placed, [group], "at", k).select(group, "lo", "hi"), "bounds")
        inside = placed.join(bounds, group).filter(within(F.col("at")))
        state = materialise(fit.join(inside.groupBy(group).agg(F.count("*").alias("n_in")), group), "axes")
        settled = (F.col("n_in") == F.col("n")) | (F.col("n_in") < 2)
        ended = state if turn == rounds - 1 else state.filter(settled)
        done = ended if done is None else done.unionByName(ended)
        going = state.filter(~settled).select(group)
        if turn == rounds - 1 or going.isEmpty():
            break
        subset = materialise(inside.join(going, group, "left_semi").select(group, *AXES), "points")
        points = materialise(points.join(going, group, "left_semi"), "points")
    return done.select(group, "axis", "n")


def wall_points(points: DataFrame, normals: DataFrame, group: str, *, k: float = 3.0, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """The points (group, x, y, z, and others) near their group's plane, and group, mean, n_in, reseeded of these. ``normals`` has a unit
    normal (array) for each group.

    Distances are from the mean; those that lie k interquartile ranges beyond the quartiles go, and the mean is taken anew, until nothing
    goes or fewer than ten would stay. Where what stays still spreads widely, the densest slab is the wall if it holds a quarter of all
    points: then the points in a band around it stay, whose middle is moved to their mean until it rests.
    """
    points = materialise(points, "points")
    start = _means(points, group).join(normals.select(group, F.col("normal").alias("axis")), group)
    state = materialise(start.select(group, "axis", "mean", "n", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.col("mean").alias("from"), F.lit(True).alias("going")), "planes")
    inner = [group, "axis", "from", "lo", "hi"]
    for _ in range(rounds):
        open_ = state.filter("going")
        if open_.isEmpty():
            break
        placed = points.select(group, *AXES).join(open_.select(group, "axis", "mean"), group).withColumn("at", _along("axis", "mean"))
        # Written: a row a group, so that the points meet them where they are, not sorted by group.
        bounds = materialise(robust_bounds(placed, [group], "at", k).select(group, F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "bounds")
        kept = placed.join(bounds, group).filter(F.col("at").between(F.col("lo2"), F.col("hi2")))
        fresh = kept.groupBy(group).agg(F.count("*").alias("n2"), F.array(*(F.avg(a) for a in AXES)).alias("mean2")).join(bounds, group)
        joined = open_.join(fresh, group, "left")
        moves = (F.col("n2") != F.col("n")) & (F.col("n2") >= LEAST_POINTS)
        pick = lambda new, old: F.when(moves, F.col(new)).otherwise(F.col(old))
        after = joined.select(group, "axis", pick("mean2", "mean").alias("mean"), pick("n2", "n").alias("n"), pick("lo2", "lo").alias("lo"), pick("hi2", "hi").alias("hi"), pick("mean", "from").alias("from"), F.coalesce(moves, F.lit(False)).alias("going"))
        state = materialise(after.unionByName(state.filter(~F.col("going"))), "planes")
    # What a group kept in its last round, measured from where that round stood.
    columns = points.columns
    at = points.join(state.select(*inner, "mean"), group).withColumn("was", _along("axis", "from")).withColumn("at", _along("axis", "mean"))
    own = at.filter(F.col("was").between(F.col("lo"), F.col("hi")))
    spread = group_quantiles(own, [group], "at", [0.1, 0.9]).select(group, (F.col("q")[1] - F.col("q")[0]).alias("spread"))
    wide = materialise(spread.filter(F.col("spread") > WIDE_M).select(group), "wide")
    slab = densest_ranges(at.join(wide, group, "left_semi"), [group], "at", SLAB_M)
    total = at.groupBy(group).agg(F.count("*").alias("all"))
    slab = materialise(slab.join(total, group).filter(F.col("n") >= SLAB_SHARE * F.col("all")).select(group, "start"), "slabs")
    in_slab = at.join(slab, group).filter(F.col("at").between(F.col("start"), F.col("start") + SLAB_M))
    seeds = materialise(_means(in_slab, group).join(state.select(group, "axis"), group).select(group, "axis", "mean", F.lit(True).alias("going")), "seeds")
    for _ in range(rounds):
        if seeds.filter("going").isEmpty():
            break
        near = points.select(group, *AXES).join(seeds.filter("going"), group).filter(F.abs(_along("axis", "mean")) <= BAND_M)
        fresh = near.groupBy(group).agg(F.count("*").alias("n2"), F.array(*(F.avg(a) for a in AXES)).alias("mean2"))
        still = F.forall(F.zip_with("mean2", "mean", lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)), lambda ok: ok)
        moves = (F.col("n2") >= LEAST_POINTS) & ~still
        after = seeds.filter("going").join(fresh, group, "left").select(group, "axis", F.when(moves, F.col("mean2")).otherwise(F.col("mean")).alias("mean"), F.coalesce(moves, F.lit(False)).alias("going"))
        seeds = materialise(after.unionByName(seeds.filter(~F.col("going"))), "seeds")
    banded = points.join(seeds.select(group, "axis", "mean"), group).filter(F.abs(_along("axis", "mean")) <= BAND_M)
    near = own.join(seeds.select(group), group, "left_anti").select(*columns).unionByName(banded.select(*columns))
    middle = state.join(seeds.select(group, F.col("mean").alias("seed")), group, "left")
    middle = middle.select(group, F.coalesce("seed", "mean").alias("mean"), F.col("seed").isNotNull().alias("reseeded"))
    near = materialise(near, "wall-points")
    return near, middle.join(near.groupBy(group).agg(F.count("*").alias("n_in")), group, "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))


# ---- hulls ----


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, anticlockwise from the leftmost; points on its edges are none."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: Iterable[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """key, hull (polygon) of the points (key, x, y). Each task hands on the corners of its own points only, so that a key with very many
    points reaches its last task as a few corners per task."""
    kind = dict(points.dtypes)[key]
    corner = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        of = pa.null()
        for batch in batches:
            of = batch.column(0).type
            frame = pd.DataFrame({"k": pd.Series(batch.column(0).to_pylist(), dtype=object), "x": batch.column(1).to_numpy(zero_copy_only=False), "y": batch.column(2).to_numpy(zero_copy_only=False)})
            for k, own in frame.groupby("k", sort=False, dropna=False):
                own = own[["x", "y"]].to_numpy(float)
                held[k] = hull(np.concatenate([held[k], own]) if k in held else own)
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, h in held.items() for _ in h], of), *(pa.array(np.concatenate([h[:, i] for h in held.values()])) for i in (0, 1))], [key, "x", "y"])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, h in held.items() for _ in h], of), *(pa.array(np.concatenate([h[:, i] for h in held.values()])) for i in (0, 1))], [key, "x", "y"])

    def finish(table: pa.Table) -> pa.Table:
        h = hull(np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], axis=1))
        return pa.table([table.column(key).slice(0, 1), pa.array([[{"x": x, "y": y} for x, y in h.tolist()]], pa.list_(corner))], names=[key, "hull"])

    known = points.filter("x is not null and y is not null").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    corners = known.mapInArrow(partial, f"`{key}` {kind}, x double, y double")
    return corners.groupBy(key).applyInArrow(finish, f"`{key}` {kind}, hull array<struct<x:double,y:double>>")


def wall_hulls(observations: DataFrame, image: str) -> DataFrame:
    """image, n, hull of the observations (image, x, y, off: distance of the point to the plane) that are on the wall, without those far
    out along x or y; images with too few of them, before or after, have no row."""
    near = materialise(observations.filter(F.abs("off") < ON_WALL_M).select(image, "x", "y"), "on-wall")
    enough = near.groupBy(image).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ON_WALL).select(image)
    near = near.join(enough, image, "left_semi")
    bounds = [robust_bounds(near, [image], a).select(image, F.col("lo").alias(f"{a}_lo"), F.col("hi").alias(f"{a}_hi")) for a in ("x", "y")]
    kept = materialise(near.join(bounds[0], image).join(bounds[1], image).filter(within(F.col("x"), "x_") & within(F.col("y"), "y_")).select(image, "x", "y"), "on-wall")
    counted = kept.groupBy(image).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ON_WALL)
    return counted.join(convex_hulls(kept, image), image)


#: Corners of hulls times cells that are compared at once, and cells of the canvas that a task remembers as bytes.
COMPARED, HELD_CELLS = 1 << 20, 1 << 26


def region_cells(p: np.ndarray, h: np.ndarray, width: float, height: float, reach: float, canvas_w: int, canvas_h: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """y, x and mask (rows of the canvas from y on, cells from x on) of the cells that a photo's region covers: the cell, taken back into the photo by
    the inverse of h, lies in the photo and in the hull p or within ``reach`` pixels of it."""
    m = h.reshape(3, 3)
    wide = np.concatenate([p + d for d in reach * np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]])])
    wide = np.clip(wide, 0, (width, height))
    on = np.c_[wide, np.ones(len(wide))] @ m.T
    if (on[:, 2] <= 0).any() and (on[:, 2] >= 0).any():
        lo, hi = np.zeros(2, int), np.array([canvas_w - 1, canvas_h - 1])  # beyond the horizon: all cells are tried
    else:
        q = on[:, :2] / on[:, 2:]
        lo, hi = np.maximum(np.floor(q.min(axis=0)).astype(int), 0), np.minimum(np.ceil(q.max(axis=0)).astype(int), (canvas_w - 1, canvas_h - 1))
    if (hi < lo).any():
        return
    back = np.linalg.inv(m)
    a, b = p, np.roll(p, -1, axis=0)
    along = b - a
    length = np.maximum((along**2).sum(axis=1), 1e-300)
    xs = np.arange(lo[0], hi[0] + 1)
    high = max(1, COMPARED // (len(xs) * len(p)))
    for y in range(lo[1], hi[1] + 1, high):
        ys = np.arange(y, min(y + high, hi[1] + 1))
        r = np.stack([np.tile(xs, len(ys)), np.repeat(ys, len(xs)), np.ones(len(xs) * len(ys))], axis=1) @ back.T
        s = r[:, :2] / r[:, 2:]
        seen = (s[:, 0] >= 0) & (s[:, 0] < width) & (s[:, 1] >= 0) & (s[:, 1] < height)
        inside = ((b[:, 0] - a[:, 0]) * (s[:, None, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (s[:, None, 0] - a[:, 0]) >= 0).all(axis=1)
        rim = np.flatnonzero(seen & ~inside)
        t = np.clip(((s[rim, None] - a) * along).sum(axis=2) / length, 0, 1)
        off = np.sqrt((((a + t[..., None] * along) - s[rim, None]) ** 2).sum(axis=2)).min(axis=1)
        covered = seen & inside
        covered[rim[off <= reach]] = True
        yield y, int(lo[0]), covered.reshape(len(ys), len(xs))


def wall_region(hulls: DataFrame, transforms: DataFrame, image: str, canvas_w: int, canvas_h: int) -> DataFrame:
    """y, x: the cells of the canvas that any photo's region covers. ``transforms`` has h (photo to canvas), w and h_px per photo; a region
    reaches beyond its hull by a share of the photo's diagonal. A task hands on each cell once, however many of its photos cover it."""
    canvas_w, canvas_h = int(canvas_w), int(canvas_h)

    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def cells() -> Iterator[pa.RecordBatch]:
            for y, row in held.items():
                xs = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), y, np.int32)), pa.array(xs.astype(np.int32))], ["y", "x"])
            held.clear()

        for batch in batches:
            for corners, *facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, width, height, reach = facts
                for y, x, mask in region_cells(np.array([(v["x"], v["y"]) for v in corners], float), np.array(h, float), width, height, reach, canvas_w, canvas_h):
                    for k, row in enumerate(mask):
                        held.setdefault(y + k, np.zeros(canvas_w, bool))[x : x + len(row)] |= row
                if len(held) * canvas_w > HELD_CELLS:
                    yield from cells()
        yield from cells()

    placed = hulls.join(transforms, image).select("hull", "h", F.col("w").cast("double").alias("w"), F.col("h_px").cast("double").alias("t"))
    placed = placed.withColumn("reach", F.lit(REACH_SHARE) * F.sqrt(F.col("w") * F.col("w") + F.col("t") * F.col("t")))
    return placed.mapInArrow(cover, "y int, x int").distinct()
