"""Fragments of cracks in single photos, on the canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.functions import linalg


def projected_fragments(fragments: DataFrame, transforms: DataFrame, image: str) -> DataFrame:
    """``fragments`` (image, polygon, and others) with ``on_canvas``, their polygon through their photo's homography (``transforms``: image, h); those of
    photos without one go."""

    def through(h: Column) -> Column:
        def point(p: Column) -> Column:
            x, y = linalg.apply(h, p["x"], p["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform("polygon", point)

    return fragments.join(transforms.select(image, "h"), image).withColumn("on_canvas", through(F.col("h"))).drop("h")


def at_level(log: DataFrame, *levels: str) -> DataFrame:
    """The rows of a log of the wanted levels, compared without case."""
    return log.filter(F.upper("level").isin(*(x.upper() for x in levels)))


def ignoring_case(name: str) -> list[Column]:
    """The order of names without case; of names that differ in case only that of their characters."""
    return [F.lower(name), F.col(name)]
