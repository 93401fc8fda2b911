"""Training labels: parsing annotations, splits, label text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.config import DEFAULT, Config

REGIONS = "array<struct<region_id:string,polygon:array<struct<x:double,y:double>>,box:struct<x:double,y:double,w:double,h:double>,kind:string>>"


def hash_split(source: Column, cfg: Config = DEFAULT) -> Column:
    """train or val by the first 32 bits of the source's SHA-1, so that a source never changes sides."""
    share = F.conv(F.substring(F.sha1(source), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(share < cfg.validation_share, "val").otherwise("train")


def parsed_regions(annotations: DataFrame, json: str) -> DataFrame:
    """A row per region of an annotation: its polygon, or its box as one, if that has three corners; unnamed regions are numbered."""
    regions = annotations.select("*", F.posexplode(F.from_json(F.regexp_replace(F.col(json), "^\ufeff", ""), REGIONS)).alias("ord", "region"))
    b = F.col("region.box")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.when(b.isNotNull(), F.array(corner(b.x, b.y), corner(b.x + b.w, b.y), corner(b.x + b.w, b.y + b.h), corner(b.x, b.y + b.h)))
    polygon = F.when(F.size("region.polygon") >= 3, F.col("region.polygon")).otherwise(box)
    return regions.select(*annotations.columns, F.coalesce(F.nullif(F.col("region.region_id"), F.lit("")), F.col("ord").cast("string")).alias("region_id"), polygon.alias("polygon"), F.coalesce("region.kind", F.lit("crack")).alias("label_kind")).filter("polygon is not null")


def yolo_line(label: Column, polygon: Column, width: Column, height: Column) -> Column:
    """class x1 y1 x2 y2 ... with coordinates as shares of the picture, six decimals."""
    points = F.transform(polygon, lambda v: F.format_string("%.6f %.6f", v["x"] / width, v["y"] / height))
    return F.concat_ws(" ", label.cast("string"), F.array_join(points, " "))


def crack_number(crack_id: Column) -> Column:
    """The number at the end of F001_C000012; null without one."""
    return F.nullif(F.regexp_extract(crack_id, r"_C(\d+)$", 1), F.lit("")).cast("long")


def split_counts(df: DataFrame, split: str, *by: str) -> DataFrame:
    return df.groupBy(split, *by).agg(F.count("*").alias("n"))
