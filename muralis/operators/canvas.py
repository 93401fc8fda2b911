"""Points, tiles and cells on a facade's canvas: measures, windows, placement, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.functions import linalg
from muralis.storage import materialise

# Margin of the roof window and height of its zone (m), share of observed cells of a tile, share of unreliable cells of a
# corner column, and how much farther than the depth map a point must lie to be hidden (share and m).
EDGE_MARGIN_M, ROOF_ZONE_M = 2.0, 1.0
OBSERVED_SHARE = 0.5
CORNER_SHARE = 0.15
HIDDEN_SHARE, HIDDEN_M = 1.03, 0.15


def millimetres(pixels: Column, px_per_m: Column, calibrated: Column, power: int = 1) -> Column:
    """Pixels in mm, or square pixels in mm2 with ``power`` 2; null without a calibrated scale."""
    factor = F.when(calibrated & (px_per_m != 0), 1000.0 / px_per_m)
    return pixels * (factor if power == 1 else factor * factor)


def metres(pixels: Column, px_per_m: Column) -> Column:
    return F.try_divide(pixels, px_per_m)


def windows(size: Column, tile: int, overlap: int) -> Column:
    """[lo, hi) windows of ``tile`` along ``size`` that overlap, the last one shifted back to end with it; none twice."""
    stride = max(1, tile - overlap)
    last = F.greatest(F.lit(0), F.ceil((size - tile) / stride)).cast("int")
    ends = F.transform(F.sequence(F.lit(0), last), lambda k: F.least(k * stride + tile, size))
    return F.array_distinct(F.transform(ends, lambda e: F.struct(F.greatest(e - tile, F.lit(0)).alias("lo"), e.alias("hi"))))


def subdivided(boxes: DataFrame, max_area: float) -> DataFrame:
    """``boxes`` (x0, y0, x1, y1 integers, and others) cut into cells of at most ``max_area``: squares, less at the far edges."""
    side = max(1, int(max_area**0.5))
    fits = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= max_area
    starts = lambda a, b: F.when(fits | (F.col(b) <= F.col(a)), F.array(a)).otherwise(F.sequence(F.col(a), F.col(b) - 1, F.lit(side).cast("long")))
    rest = [x for x in boxes.columns if x not in ("x0", "y0", "x1", "y1")]
    cut = boxes.withColumn("fits", fits).withColumn("xs", starts("x0", "x1")).withColumn("ys", starts("y0", "y1"))
    cells = cut.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys"))
    end = lambda at, b: F.when(F.col("fits"), F.col(b)).otherwise(F.least(F.col(at) + side, F.col(b)))
    return cells.select(*rest, F.col("cx").alias("x0"), F.col("cy").alias("y0"), end("cx", "x1").alias("x1"), end("cy", "y1").alias("y1"))


def clamped(value: Column, size: Column) -> Column:
    """A pixel coordinate within an image of ``size``."""
    return F.least(F.greatest(value, F.lit(0.0)), size - 1)


def observed_tiles(cells: DataFrame, tile: int, share: float = OBSERVED_SHARE) -> DataFrame:
    """tile_x, tile_y, observed_ratio of the tiles whose ``cells`` (x, y, observed) are observed to ``share`` or more."""
    tiles = cells.groupBy(F.floor(F.col("x") / tile).alias("tile_x"), F.floor(F.col("y") / tile).alias("tile_y")).agg(F.avg(F.col("observed").cast("int")).alias("observed_ratio"))
    return tiles.filter(F.col("observed_ratio") >= share)


def corner_columns(cells: DataFrame, group: str, column: str, flag: str, share: float = CORNER_SHARE) -> DataFrame:
    """The columns of cells of which more than ``share`` are flagged."""
    return cells.groupBy(group, column).agg(F.avg(F.col(flag).cast("int")).alias("flagged")).filter(F.col("flagged") > share)


def coverage_ratio(cells: DataFrame, group: str, total: Column) -> DataFrame:
    """Distinct observed cells (x, y) of each group over the canvas's ``total``."""
    return cells.select(group, "x", "y").distinct().groupBy(group).agg(F.count("*").alias("n")).select(group, (F.col("n") / total).alias("coverage"))


def roof_window(points: DataFrame, group: str, band: float, px_per_m: float, width: int, height: int) -> DataFrame:
    """x_lo, x_hi, y_hi in canvas pixels of the zone below a roof's edge, from the points (u, v, off) near the wall's plane. The top is a
    low quantile, not the least: stray points stand above it."""
    near = points.filter(F.abs("off") <= band).groupBy(group).agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.percentile("v", 0.05).alias("top"))
    px = lambda m: (m * px_per_m).cast("int")  # noqa: E731 - towards zero
    return near.select(group, F.greatest(F.lit(0), px(F.col("lo") + EDGE_MARGIN_M)).alias("x_lo"), F.least(F.lit(width), px(F.col("hi") - EDGE_MARGIN_M)).alias("x_hi"), F.least(F.lit(height), px(F.col("top") + ROOF_ZONE_M)).alias("y_hi"))


def mixed_placement(vertices: DataFrame, polygon: str) -> DataFrame:
    """x, y and method of every vertex (polygon, ord, fx, fy by the flat transform; dx, dy by depth, or null). Where half of a polygon's
    vertices or more have depth, those without take their flat place, shifted by the median shift of the others; else all are flat."""
    valid = F.col("dx").isNotNull()
    shift = vertices.groupBy(polygon).agg(F.median(F.when(valid, F.col("dx") - F.col("fx"))).alias("sx"), F.median(F.when(valid, F.col("dy") - F.col("fy"))).alias("sy"), F.count_if(valid).alias("n_valid"), F.count("*").alias("n"))
    joined = vertices.join(shift, polygon)
    method = F.when(F.col("n_valid") == F.col("n"), "depth").when(F.col("n_valid") * 2 < F.col("n"), "flat").otherwise("depth+flat")
    at = lambda k: F.when(method == "flat", F.col(f"f{k}")).otherwise(F.coalesce(F.col(f"d{k}"), F.col(f"f{k}") + F.col(f"s{k}"))).alias(k)
    return joined.select(polygon, "ord", at("x"), at("y"), method.alias("method"))


def hidden(z: Column, depth: Column) -> Column:
    """Whether something nearer hides a point at ``z``; where the depth map has no value nothing does."""
    return F.coalesce(z > depth * HIDDEN_SHARE + HIDDEN_M, F.lit(False))


def depth_samples(points: DataFrame, cells: DataFrame, image: str, radius: int = 2) -> DataFrame:
    """depth of each point (image, id, x, y; width, height of its map): the median of the valid cells (image, cx, cy, depth > 0) around
    it; null outside of the map, or if fewer than most cells of the window are valid. Windows are clipped at the border."""
    steps = F.array(*(F.lit(k) for k in range(-radius, radius + 1)))
    clip = lambda v, size: F.least(F.greatest(v, F.lit(0)), F.col(size) - 1).cast("long")
    around = points.withColumn("ox", F.explode(steps)).withColumn("oy", F.explode(steps))
    around = around.withColumn("cx", clip(clip(F.rint("x"), "width") + F.col("ox"), "width")).withColumn("cy", clip(clip(F.rint("y"), "height") + F.col("oy"), "height"))
    found = around.join(cells.filter("depth > 0"), [image, "cx", "cy"], "left").groupBy(image, "id").agg(F.median("depth").alias("middle"), F.count("depth").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("width").alias("width"), F.first("height").alias("height"))
    inside = F.col("x").between(0, F.col("width") - 1) & F.col("y").between(0, F.col("height") - 1)
    most = (2 * radius + 1) ** 2 // 2 + 1
    return found.select(image, "id", F.when(inside & (F.col("n") >= most), F.col("middle")).alias("depth"))


def composed_transforms(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """node, h: the homography from each node of ``tree`` (node, parent, hops) to its root, composed along the tree level by level.
    ``edges`` (a, b, h) map a to b, and are inverted where the tree goes the other way."""
    forward = edges.select(F.col("a").alias("parent"), F.col("b").alias("node"), linalg.inverse(F.col("h")).alias("step"))
    steps = materialise(tree.join(forward.unionByName(edges.select(F.col("b").alias("parent"), F.col("a").alias("node"), F.col("h").alias("step"))), ["node", "parent"]).select("node", "parent", "hops", "step"), "steps")
    one = F.array(*(F.lit(float(k % 4 == 0)) for k in range(9)))
    level = materialise(tree.filter("parent is null").select("node", one.alias("h")), "transforms")
    whole = level
    for hops in range(1, (steps.agg(F.max("hops")).first()[0] or 0) + 1):
        above = level.toDF("parent", "above")
        level = materialise(steps.filter(F.col("hops") == hops).join(above, "parent").select("node", linalg.product(F.col("above"), F.col("step")).alias("h")), "transforms")
        whole = whole.unionByName(level)
    return whole


def camera_distance(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column) -> Column:
    """Distance of a point to its camera: the nearest camera owns a cell."""
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))
