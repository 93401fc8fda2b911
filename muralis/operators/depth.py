"""Depth and raster tables: filling, nearest camera, z-buffer, coverage, tiles, keypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muralis.config import DEFAULT, Config
from muralis.graph import connected_components
from muralis.operators.spatial import radius_pairs


def filled_along(df: DataFrame, group: str, order: str, value: str, *, tolerance: float = 0.3, reach: int = 150) -> DataFrame:
    """Unknown values take the mean of the known ones before and after, if those agree and the gap between them is short."""
    w = Window.partitionBy(group).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("pos").alias("p")))
    ranked = df.withColumn("pos", F.row_number().over(w))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = ranked.withColumn("b", before).withColumn("a", after)
    fits = (F.abs(F.col("b.v") - F.col("a.v")) <= tolerance) & (F.col("a.p") - F.col("b.p") - 1 <= reach)
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(fits, (F.col("b.v") + F.col("a.v")) / 2)
    return out.withColumn("filled", filled).drop("pos", "a", "b")


def nearest_depth(samples: DataFrame, pixel: list[str]) -> DataFrame:
    """Per pixel the photo of the least depth, the smallest id of equals."""
    return samples.groupBy(*pixel).agg(F.min(F.struct("depth", "image_id")).alias("m")).select(*pixel, F.col("m.image_id").alias("image_id"), F.col("m.depth").alias("depth"))


def nearest_camera(pixels: DataFrame, cameras: DataFrame, key: str) -> DataFrame:
    """The nearest of one face's cameras (camera, cx, cy) for each pixel (x, y)."""
    d = F.pow(F.col("x") - F.col("cx"), 2.0) + F.pow(F.col("y") - F.col("cy"), 2.0)
    near = pixels.join(F.broadcast(cameras)).groupBy(key).agg(F.min(F.struct(d.alias("d"), "camera")).alias("m"))  # a face's cameras
    return near.select(key, F.col("m.camera").alias("camera"), F.sqrt("m.d").alias("distance"))


def covered_cells(rects: DataFrame, cell: float, least: int = 2) -> DataFrame:
    """cx, cy, n: cells that at least so many rectangles (x0, y0, x1, y1) touch."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    return rects.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")).groupBy("cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def tiles(images: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """tile_id, x, y, w, h of the tiles of every image (image_id, width, height): a fixed stride, as long as more than the
    overlap is left; the last ones are clamped."""
    stride = cfg.tile_px - cfg.tile_overlap_px
    starts = lambda side: F.explode(F.sequence(F.lit(0), F.greatest(F.col(side) - cfg.tile_overlap_px - 1, F.lit(0)).cast("long"), F.lit(stride)))
    out = images.filter("width > 0 and height > 0").withColumn("x", starts("width")).withColumn("y", starts("height"))
    size = lambda at, side: F.least(F.lit(cfg.tile_px), F.col(side) - F.col(at)).cast("long")
    return out.select("image_id", F.format_string("T%06d_%06d", "y", "x").alias("tile_id"), "x", "y", size("x", "width").alias("w"), size("y", "height").alias("h"))


def merged_keypoints(points: DataFrame, radius: float = 3.0) -> DataFrame:
    """Keypoints (id, image_id, x, y) of an image that lie together, as their centroid and number."""
    near = radius_pairs(points, key="id", axes=["x", "y"], radius=radius, within=["image_id"]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    of = points.join(connected_components(near), "id", "left").withColumn("point", F.coalesce("component", "id"))
    return of.groupBy("image_id", "point").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("support"))


def capped_keypoints(points: DataFrame, *, cell: float, per_cell: int, cap: int) -> DataFrame:
    """At most ``cap`` points (id, image_id, x, y, support) per image: the best of every cell first, then the rest cell by cell."""
    placed = points.withColumn("cell", F.floor(F.col("y") / cell) * 100_000 + F.floor(F.col("x") / cell))
    in_cell = F.row_number().over(Window.partitionBy("image_id", "cell").orderBy(F.desc("support"), "id"))
    ranked = placed.withColumn("in_cell", in_cell)
    order = F.row_number().over(Window.partitionBy("image_id").orderBy((F.col("in_cell") > per_cell).cast("int"), "cell", F.desc("support"), "id"))
    return ranked.withColumn("order", order).filter(F.col("order") <= cap).select("id", "image_id", "cell", "in_cell")


def canvas_bounds(corners: DataFrame) -> DataFrame:
    """Least and greatest of the warped corners (x, y)."""
    return corners.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


def folded_profile(df: DataFrame, position: str, value: str, pitch: int) -> DataFrame:
    """Mean value by position modulo the pitch."""
    return df.groupBy(F.pmod(F.col(position), F.lit(pitch)).alias("phase")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def parabola_peak(left: Column, middle: Column, right: Column) -> Column:
    """Offset of the peak from the middle sample, within half a step."""
    d = left - 2 * middle + right
    return F.when(F.abs(d) < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / d)))


def smoothstep(x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return t * t * (3 - 2 * t)


def raised_cosine(x: Column, size: Column, margin: Column) -> Column:
    """Weight of a pixel by its distance from the tile's edge."""
    edge = F.least(x + 0.5, size - x - 0.5)
    return F.when(edge >= margin, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(F.pi() * edge / margin))


def autocorrelation(df: DataFrame, position: str, value: str, lags: tuple[int, int]) -> DataFrame:
    """lag, corr, n: covariance of a row profile with itself shifted by each lag, over its variance. The profile joins itself once, on the
    shifted position."""
    mean = df.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    centred = df.join(F.broadcast(mean)).select(F.col(position).alias("p"), (F.col(value) - F.col("m")).alias("x"), "v")  # one row
    shifted = centred.select(F.explode(F.sequence(F.lit(lags[0]), F.lit(lags[1]))).alias("lag"), "p", F.col("x").alias("y")).select("lag", (F.col("p") - F.col("lag")).alias("p"), "y")
    both = centred.join(shifted, "p")
    return both.groupBy("lag").agg(F.try_divide(F.avg(F.col("x") * F.col("y")), F.max("v")).alias("corr"), F.count("*").alias("n"))


def strongest_lag(correlations: DataFrame) -> DataFrame:
    """The lag of the highest correlation, the smallest of equals, refined by a parabola through its neighbours."""
    best = correlations.agg(F.max(F.struct("corr", (-F.col("lag")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("lag"), F.col("m.corr").alias("corr"))
    side = lambda k, name: correlations.select((F.col("lag") + k).alias("lag"), F.col("corr").alias(name))
    joined = best.join(side(1, "left"), "lag", "left").join(side(-1, "right"), "lag", "left")
    return joined.select("lag", "corr", (F.col("lag") + F.coalesce(parabola_peak(F.col("left"), F.col("corr"), F.col("right")), F.lit(0.0))).alias("refined"))


def brightest(pixels: DataFrame, at: list[str], value: str) -> DataFrame:
    """Greatest value per pixel over all layers."""
    return pixels.groupBy(*at).agg(F.max(value).alias(value), F.count("*").alias("layers"))


def owners_merged(known: DataFrame, cameras: DataFrame) -> DataFrame:
    """camera, label: known labels stay; unseen cameras follow them in order of their names."""
    last = known.agg(F.coalesce(F.max("label"), F.lit(0)).alias("last"))
    fresh = cameras.join(known.select("camera"), "camera", "left_anti").distinct()
    # One face's cameras.
    numbered = fresh.join(F.broadcast(last)).select("camera", (F.col("last") + F.row_number().over(Window.orderBy("camera"))).cast("int").alias("label"))
    return known.select("camera", "label").unionByName(numbered)
