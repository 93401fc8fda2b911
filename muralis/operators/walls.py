"""What of a polygon, or of a photo, lies on the wall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.config import DEFAULT, Config
from muralis.functions import polygons


def on_wall_shares(shapes: DataFrame, wall: DataFrame, width: int, height: int, cfg: Config = DEFAULT) -> DataFrame:
    """id, pixels, on_wall, share, kept of polygons (id, polygon) on a canvas: the share of their pixels that are among the wall's cells
    (y, x). Pixels off the canvas count for nothing; a polygon without pixels has share 0. Ids are unique.

    Pixels meet the wall as masks of up to 64 of a row, so neither a pixel is a row nor a raster one.
    """
    x = F.col("x").cast("long")
    bit = F.expr("shiftleft(1L, CAST(pmod(x, 64) AS INT))")
    cells = wall.select("y", x.alias("x")).filter("x is not null").groupBy("y", F.floor(F.col("x") / 64).cast("int").alias("block")).agg(F.bit_or(bit).alias("on_wall"))
    marked = polygons.canvas_masks(shapes, int(width), int(height)).join(cells, ["y", "block"], "left")
    counted = marked.groupBy("id").agg(F.sum(F.bit_count("mask")).alias("pixels"), F.sum(F.bit_count(F.coalesce(F.col("mask").bitwiseAND(F.col("on_wall")), F.lit(0)))).alias("on_wall"))
    zero = F.lit(0).cast("long")
    out = shapes.select("id").join(counted, "id", "left").select("id", F.coalesce("pixels", zero).alias("pixels"), F.coalesce("on_wall", zero).alias("on_wall"))
    share = F.when(F.col("pixels") > 0, F.col("on_wall") / F.col("pixels")).otherwise(0.0)
    return out.withColumn("share", share).withColumn("kept", F.col("share") >= cfg.min_on_wall)
